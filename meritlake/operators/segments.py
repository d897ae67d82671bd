"""Ordered work inside groups of any size.

Rows are range-partitioned by group and order, so a group holding a third of the table lies with a third of the
tasks, in order. What has to cross from one partition to the next is carried by one row for each of them. The same
plan serves groups of every size, and nothing runs before the action.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(ts: str) -> Column:
    """Ascending key for 'newest first, null before all'."""
    return -F.unix_micros(F.col(ts).cast("timestamp"))


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add ``previous_<column>`` from the row before in the same group; nulls in the keys are a group.

    ``order`` must be unique within a group, nulls come first. The sorted rows are kept on disk while the
    result is in use, since range borders are drawn from samples and must be the same for both who read them;
    a lost executor's share is sorted again within the same borders.
    """
    by = [*keys, *[c for c in order if c not in keys]]
    placed = (df.repartitionByRange(*by).sortWithinPartitions(*by)
              .withColumn("_place", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
              .withColumn("_shard", F.shiftrightunsigned("_place", 33)))
    carried, group = F.struct(*columns), F.struct(*keys)
    # one row for each partition, so at most spark.sql.shuffle.partitions rows
    borders = (placed.groupBy("_shard").agg(F.max_by(F.struct(group.alias("group"), carried.alias("row")), "_place").alias("_last"))
               .select("_shard", F.lag("_last").over(Window.orderBy("_shard")).alias("_border")))
    within = Window.partitionBy("_shard", *keys).orderBy("_place")
    goes_on = F.col("_border").isNotNull() & F.col("_border.group").eqNullSafe(group)
    return (
        placed.withColumn("_lagged", F.lag(carried).over(within))
        .join(F.broadcast(borders), "_shard")
        .withColumn("_previous", F.coalesce("_lagged", F.when(goes_on, F.col("_border.row"))))
        .select(*df.columns, *[F.col(f"_previous.{c}").alias(f"previous_{c}") for c in columns])
    )


def arrays_in_order(df: DataFrame, keys: list[str], order: list[Column], item: Column, name: str) -> DataFrame:
    """Groups as whole arrays in the given order: keys and the array. An array has to fit a cell, as it does in the result."""
    places = [column.alias(f"_{number}") for number, column in enumerate(order)]
    entry = F.struct(*places, item.alias("_item"))
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["_item"]).alias(name))
