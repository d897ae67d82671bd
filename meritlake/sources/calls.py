"""Caller-supplied functions (text extraction, model calls), run per partition.

This is the only Python code on the data path.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.session import work_folder
from meritlake.sources.keyed_store import KeyedStore

Call = Callable[[object], str]
# values and answers that a worker holds as Python objects at a time
ROWS_AT_A_TIME = 256


def map_with_caller(df: DataFrame, column: str, keep: list[str],
                    factories: list[tuple[str, Callable[[], Call]]],
                    partitions: int | None = None, in_flight: int = 1, per_second: float | None = None,
                    retries: int = 0, first_wait: float = 1.0) -> DataFrame:
    """Apply a call to each value: answer, success, error, elapsed seconds, caller.

    ``factories``: (name, function building the call). A call is built once per partition, when
    first needed. A quota or rate-limit error moves the partition on to the next caller for
    good; any other error, or a quota error of the last caller, stays with its row after ``retries``
    more attempts, each after twice the wait of the one before.

    Each partition has up to ``in_flight`` calls under way at a time (a call has to bear that if it is more
    than one) and starts at most ``per_second``. Rows keep their order.
    """
    source = df.select(*keep, F.col(column).alias("_input"))
    if partitions:
        source = source.repartition(partitions)
    schema = source.select(*keep).schema
    for field in ("answer string", "success boolean", "error string", "elapsed double", "caller string"):
        schema = schema.add(field.split(" ")[0], field.split(" ")[1])

    quota_phrases, rows_at_a_time = tuple(K.QUOTA_PHRASES), max(ROWS_AT_A_TIME, in_flight)

    # stands on its own, so workers need no copy of this package
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import threading
        from concurrent.futures import ThreadPoolExecutor

        lock = threading.Lock()
        built: dict[int, Call] = {}
        now = {"caller": 0, "start": 0.0}

        def caller(number: int) -> Call:
            with lock:
                if number not in built:
                    built[number] = factories[number][1]()
                return built[number]

        def wait_for_turn() -> None:
            if per_second:
                with lock:
                    now["start"] = max(now["start"], time.monotonic()) + 1 / per_second
                    turn = now["start"] - 1 / per_second
                time.sleep(max(0.0, turn - time.monotonic()))

        def ask(value) -> tuple:
            started, attempt = time.perf_counter(), 0
            while True:
                number = now["caller"]
                try:
                    wait_for_turn()
                    return caller(number)(value), None, time.perf_counter() - started, factories[number][0]
                except Exception as problem:  # noqa: BLE001 - kept as data
                    error = str(problem) or type(problem).__name__
                over_quota = any(phrase in error.lower() for phrase in quota_phrases)
                if over_quota and number < len(factories) - 1:
                    with lock:
                        now["caller"] = max(now["caller"], number + 1)
                    attempt = 0
                elif attempt < retries:
                    time.sleep(first_wait * 2 ** attempt)
                    attempt += 1
                else:
                    return None, error, time.perf_counter() - started, factories[number][0]

        with ThreadPoolExecutor(in_flight) as pool:
            # few rows at a time: values and answers are whole documents, and a batch may have ten thousand
            for part in (batch.slice(at, rows_at_a_time) for batch in batches for at in range(0, batch.num_rows, rows_at_a_time)):
                values = part.column("_input").to_pylist()
                rows = list(pool.map(ask, values) if in_flight > 1 else map(ask, values))
                answers, errors, elapsed, callers = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(name) for name in keep), pa.array(answers, pa.string()),
                     pa.array([error is None for error in errors], pa.bool_()), pa.array(errors, pa.string()),
                     pa.array(elapsed, pa.float64()), pa.array(callers, pa.string())],
                    names=[*keep, "answer", "success", "error", "elapsed", "caller"])
                del values, rows, answers, errors

    return source.mapInArrow(run, schema)


ANSWERS = "prompt_hash string, answer string, caller string"


def map_with_answers(df: DataFrame, column: str, keep: list[str], factories: list[tuple[str, Callable[[], Call]]],
                     store: KeyedStore, **how) -> DataFrame:
    """The same with a store of answers (schema ``ANSWERS``, key prompt_hash): what was answered once is not asked again.

    Equal values are asked once. Answers are stored before they are used; failed calls are not, so
    that a later run asks anew. ``caller`` of a stored answer is who gave it.
    """
    spark = df.sparkSession
    hashed = df.select(*keep, F.col(column).alias("_input"), F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("\0null")), 256)
                       .alias("prompt_hash"))
    folder = work_folder(spark, "prompts")
    hashed.write.parquet(folder)
    hashed = spark.read.schema(hashed.schema).parquet(folder)
    prompts = hashed.groupBy("prompt_hash").agg(F.first("_input").alias("_input"))
    known = store.matching(prompts).select("prompt_hash")
    answers = work_folder(spark, "answers")
    map_with_caller(prompts.join(known, "prompt_hash", "left_anti"), "_input", ["prompt_hash"], factories, **how).write.parquet(answers)
    asked = spark.read.schema("prompt_hash string, answer string, success boolean, error string, elapsed double, caller string").parquet(answers)
    store.insert_new(asked.where("success"))
    found = store.matching(prompts).select("prompt_hash", "answer", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), "caller")
    failed = asked.where("NOT success").select("prompt_hash", "answer", "success", "error", "caller")
    return hashed.drop("_input").join(found.unionByName(failed), "prompt_hash").select(
        *keep, "answer", "success", "error", "caller")
