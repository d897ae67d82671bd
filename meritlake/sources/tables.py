"""Entity tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlake.operators.nested import parse_workflow
from meritlake.schemas import ENTITY_SCHEMAS


def read_entity(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored entity table. Only columns a query names are read from the files."""
    return spark.read.schema(ENTITY_SCHEMAS[name]).parquet(path)


# rows of a task, where the work of a row costs far more than moving it
ROWS_OF_A_TASK = 200_000


def spread_few_splits(scan: DataFrame) -> DataFrame:
    """Give a scan with few splits one task per core, and no task more than about ``ROWS_OF_A_TASK`` rows.

    For work that costs far more per row than a shuffle, such as chains of patterns over long
    texts. Splits are cut by bytes, so narrow rows come many to a split, and tasks would grow with the table; tables with
    enough splits are left as they are. Rows are counted in the files' footers. Filters and
    column choice still reach the files through the exchange. ``scan`` must be a plain read.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    wanted = max(cores, -(-scan.count() // ROWS_OF_A_TASK))
    return scan if splits >= wanted else scan.repartition(wanted)


def list_view(table: DataFrame) -> DataFrame:
    """Without file bytes and extracted text."""
    return table.drop("file_content", "ocr_output")


def read_entity_jdbc(spark: SparkSession, name: str, url: str, properties: dict[str, str],
                     partition_column: str | None = None, lower: str | None = None,
                     upper: str | None = None, partitions: int = 1) -> DataFrame:
    """The same table from a database, read in ranges of a numeric, date or time column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **properties)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
                                numPartitions=str(partitions))
    columns = [part.strip().split(" ")[0] for part in ENTITY_SCHEMAS[name].split(",")]
    return reader.load().select(*columns)


def read_workflow_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored nested evaluation files, one JSON document each."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.input_file_name().alias("path"), parse_workflow(F.col("value")).alias("workflow"))


def workflow_column(decisions: DataFrame) -> DataFrame:
    """The workflow JSON kept on decisions, parsed."""
    return decisions.select("certificate_id", parse_workflow(F.col("ai_workflow_json")).alias("workflow"))


def write_decision_records(decisions: DataFrame, path: str) -> None:
    """Append flat decisions, partitioned by the month they were made.

    The rebalance hint gathers each month into few files and lets adaptive execution split a
    month that is too large for one task.
    """
    (
        decisions.withColumn("decision_month", F.date_format("created_at", "yyyy-MM"))
        .hint("rebalance", "decision_month")
        .write.mode("append").partitionBy("decision_month").parquet(path)
    )
