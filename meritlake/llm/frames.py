"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritlake.session import work_folder


def with_fields(schema: T.StructType, ddl: str, drop_last: bool = False) -> T.StructType:
    """A schema, without its last field if asked, followed by further fields; any name and type goes."""
    fields = schema.fields[:-1] if drop_last else schema.fields
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts its lineage, survives lost executors."""
    folder = work_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


# Rows of a table with one row a task that may be sent to all tasks: at 130 bytes each some 64 MB.
MOST_SENT_ROWS = 500_000


def beside_each_task(rows: DataFrame, starts: DataFrame, purpose: str, shard: str = "shard") -> DataFrame:
    """``rows`` joined with ``starts``, which has one row for each task that wrote them.

    The starts are written first and counted: up to ``MOST_SENT_ROWS`` they go to the rows, which then stay
    where they lie; more tasks than that are joined like any two tables.
    """
    starts = written(starts, purpose)
    return rows.join(F.broadcast(starts) if starts.count() <= MOST_SENT_ROWS else starts, shard)


def numbered(rows: DataFrame, group: list[str], order: list[Column], purpose: str) -> DataFrame:
    """The rows with ``number``, their place from 0 in the order within their group, and the group's ``size``.

    Rows are range-partitioned by group and order and written; offsets of the partitions come from one
    row for each partition and group in it, so a group of any size is numbered by all its tasks.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "place", F.monotonically_increasing_id()), purpose).withColumn("shard", F.shiftrightunsigned("place", 33))
    within = Window.partitionBy(*group)
    offsets = placed.groupBy(*group, "shard").agg(F.count("*").alias("n"), F.min("place").alias("first")).select(
        *group, "shard", (F.sum("n").over(within.orderBy("shard")) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(within).alias("size"))
    return placed.join(offsets, [*group, "shard"]).withColumn("number", F.col("place") + F.col("shift")).drop(
        "place", "shard", "shift")


# What empties the tables that this Python worker remembers between tasks, by step.
_remembered: dict[str, Callable[[], None]] = {}


def remember_only(step: str, forget: Callable[[], None] = lambda: None) -> None:
    """A worker's first call in a task: what it remembers of other steps is emptied by their own ``forget``.

    Workers live on from stage to stage; without this a pipeline's worker holds the tables of all its stages.
    """
    others = [other for other in _remembered if other != step]
    for other in others:
        _remembered.pop(other)()
    _remembered[step] = forget
    if others:
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()
