"""Arriving certificates: evaluated once each, and their status as decisions arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meritlake.operators.applications import status_fields
from meritlake.sources.keyed_store import KeyedStore

STATUS_FIELDS = ("decision_id", "ai_decision", "ai_justification", "total_working_hours", "credits_awarded",
                 "training_duration", "training_institution")


def read_arrivals(spark: SparkSession, schema, path: str, pattern: str = "*.parquet",
                  files_per_batch: int = 1000) -> DataFrame:
    """A growing folder of parquet files as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


ALL_THERE_IS = {"availableNow": True}


def stream_evaluate(arrivals: DataFrame, evaluate: Callable[[DataFrame], DataFrame], output: KeyedStore, checkpoint: str,
                    trigger: dict | None = None) -> StreamingQuery:
    """Evaluate arriving certificates and store their decisions, each certificate once.

    No watermark: a certificate may arrive at any time. Only the store's buckets of a batch's
    certificates are read, and of these only the keys; repeats, a batch that is run again and a lost
    checkpoint find their keys there and add nothing. The new certificates of a batch are kept while it
    lasts, as ``evaluate`` may read them several times.
    """
    def write(batch: DataFrame, _batch_id: int) -> None:
        stored = output.read(output.buckets_of(batch)).select("certificate_id")
        new = batch.dropDuplicates(["certificate_id"]).join(stored, "certificate_id", "left_anti").persist()
        try:
            output.add(evaluate(new))
        finally:
            new.unpersist()

    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_THERE_IS)).start()
    )


def status_changes(certificates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The certificates and decisions of two streams as one stream of what is known of each certificate.

    A row comes out whenever something new is known: a certificate or decision that was not seen before. The
    state holds a key for each event, and the newest decision (by time, then id) of each certificate; with a
    RocksDB state store it lies on disk and a batch costs what its own keys cost. No watermark:
    a decision may come before its certificate or years after it.
    """
    known = F.struct("created_at", *STATUS_FIELDS)
    given = decisions.select("certificate_id", *STATUS_FIELDS, "created_at")
    events = certificates.select("certificate_id", F.lit(True).alias("arrived"), F.lit(None).cast(
        given.select(known.alias("decision")).schema["decision"].dataType).alias("decision")).unionByName(
        given.select("certificate_id", F.lit(False).alias("arrived"), known.alias("decision")))
    # the same event again, after a restart of its source or from a second file, is no news
    news = events.withColumn("event", F.xxhash64("arrived", "decision")).dropDuplicates(["certificate_id", "event"])
    return news.groupBy("certificate_id").agg(
        F.max("arrived").alias("arrived"),
        F.max_by("decision", F.when(F.col("decision").isNotNull(), F.struct("decision.created_at", "decision.decision_id")))
        .alias("decision"))


def stream_status(certificates: DataFrame, decisions: DataFrame, output: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Every change of status of arriving certificates: processing, then completed when their decision arrives.

    Each batch goes to a folder of its own, so one that is run again replaces what it wrote. A
    certificate whose decision came first is completed at once; an event that tells nothing new gives no
    row. :func:`last_status` has the last row of each.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.where("arrived").select("certificate_id", "decision.*")
        status_fields(arrived).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        status_changes(certificates, decisions).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_THERE_IS)).start()
    )


def last_status(changes: DataFrame) -> DataFrame:
    """The newest status of each certificate, from what :func:`stream_status` wrote."""
    fields = [c for c in changes.columns if c not in ("certificate_id", "batch")]
    return changes.groupBy("certificate_id").agg(
        F.max_by(F.struct(*fields), "batch").alias("last")).select("certificate_id", "last.*")
