"""Tables sorted over their files, for pages and look-ups that read a few files of many.

Ranked tables have a sparse index, every n-th sort key with its rank, so any page is a range read. Clustered
tables are sorted by a key, with Bloom filters for other columns that are looked up; both let the files' own
statistics leave out row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = 1_000


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partitioned and sorted; ``shard`` numbers the partitions in this order."""
    return (df.repartitionByRange(*order).withColumn("shard", F.spark_partition_id())
            .sortWithinPartitions("shard", *order))


def write_ranked(df: DataFrame, path: str, order: dict[str, Column], step: int = STEP) -> None:
    """Store a table sorted by the ``order`` columns, which are added to it (ascending, nulls first, distinct together).

    The index has a row for every ``step``-th rank and the first of each file folder.
    """
    place = F.monotonically_increasing_id()
    placed = _sorted(df.withColumns(order), list(order)).withColumn("place", place)
    placed.write.partitionBy("shard").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    running = Window.orderBy("shard")  # one row for each file folder
    firsts = stored.groupBy("shard").agg(F.count("*").alias("n"), F.min("place").alias("first")).select(
        "shard", "first", (F.sum("n").over(running) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place") - F.col("first")
    (stored.select("shard", "place", *order).join(firsts, "shard").withColumn("rank", rank)
     .where((F.col("rank") % step == 0) | (F.col("place") == F.col("first"))).select("rank", "shard", *order)
     .repartitionByRange("rank").sortWithinPartitions("rank").write.parquet(f"{path}/index"))


def read_page(spark: SparkSession, path: str, schema: T.StructType, order: list[str], skip: int, limit: int,
              step: int = STEP) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in order, as a table of ``schema``.

    Reads the index between the two, then the folders it names; with the ``step`` the table was stored with.
    """
    index = spark.read.parquet(f"{path}/index")
    # at most limit / step entries and three more, and those of the folders between
    near = index.where(F.col("rank").between(skip - step, skip + limit + step)).orderBy("rank").collect()
    start = [e for e in near if e["rank"] <= skip][-1:]
    if not start:
        return spark.createDataFrame([], schema)
    kinds = [index.schema[c] for c in order]
    stored = spark.read.schema(T.StructType([*schema, *kinds, T.StructField("shard", T.IntegerType())])).parquet(f"{path}/rows")
    end = [e for e in near if e["rank"] >= skip + limit][:1]
    rows = stored.where(F.col("shard") >= start[0]["shard"])
    first = order[0]

    def at_least(entry, column: Column) -> Column:
        return F.lit(True) if entry[first] is None else column >= F.lit(entry[first])

    def key(entry) -> Column:
        return F.struct(*[F.lit(entry[c]).cast(stored.schema[c].dataType).alias(c) for c in order])

    whole = F.struct(*order)
    rows = rows.where(at_least(start[0], F.col(first)) & (whole >= key(start[0])))
    if end:
        rows = rows.where(F.col("shard") <= end[0]["shard"])
        if end[0][first] is not None:
            rows = rows.where(F.col(first).isNull() | (F.col(first) <= F.lit(end[0][first])))
        rows = rows.where(whole < key(end[0]))
    return rows.orderBy(*order).offset(skip - start[0]["rank"]).limit(limit).select(*schema.fieldNames())


def write_clustered(df: DataFrame, path: str, key: str, blooms: tuple[str, ...] = (), distinct: int = 1_000_000,
                    row_group_bytes: int = 32 << 20) -> None:
    """Store a table sorted by ``key`` over its files, with Bloom filters for other look-up columns.

    ``distinct`` is about the number of different values that one file has in such a column; the filter's size follows it.
    """
    writer = df.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.size", str(row_group_bytes))
    for column in blooms:
        writer = (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct)))
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store a table in hash buckets of ``key``; tables of as many buckets join on it without a shuffle.

    ``table`` names it in the session's catalogue while its bucketing is read; the files stay when the name goes.
    """
    spark = df.sparkSession
    # one file for each bucket: rows are dealt like the buckets before they are written
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored
