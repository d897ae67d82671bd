"""Packing by powers of two: every document is cut into pieces of binary length.

As many pieces of the full length as fit, then one piece for each bit of the rest. A piece is a
sequence of its own, so no sequence crosses documents and none needs padding; sequences of equal
length are numbered after each other, so that each length is one bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake.llm.frames import beside_each_task
from meritlake.llm.tokenizing import encoder_of, pattern_of, read_definition
from meritlake.session import work_folder

SEQUENCE_TOKENS = 4096
PIECES = "doc_id long, start long, length long, doc_tokens long, shard int, place long, ids binary"
PIECE_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("shard", pa.int32()), ("place", pa.int64()), ("ids", pa.binary())])
# Bytes of ids in a batch handed back to Spark; a document's pieces may pass it.
BATCH_BYTES = 8 << 20


def binary_lengths(tokens: int, most: int) -> list[int]:
    """Lengths of the pieces, longest first; ``most`` is a power of two."""
    whole, rest = divmod(tokens, most)
    return [most] * whole + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, most: int = SEQUENCE_TOKENS,
                   text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (32-bit little-endian) of every piece.

    Every row of the input is a document, whether its key is null, repeated or not; a null text is
    empty and gives the end id alone. Sequence ids run from 0 without gaps, longest sequences
    first; offset is 0, as no sequence has two pieces. Other columns are not kept. An empty table
    gives no pieces. Nothing but one count per task and length is shuffled; the starts made of them, one
    row a task, go to the pieces (up to ``frames.MOST_SENT_ROWS`` tasks).
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(read_definition(tokenizer))
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder_of(definition.value, pattern_of(definition.value), lower=True).encode
        seen: dict[int, int] = {}
        rows, held = [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE_SCHEMA)], schema=PIECE_SCHEMA)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(value.as_py()) + end
                tokens, start = len(ids) // 4, 0
                for length in binary_lengths(tokens, most):
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    rows.append((name, start, length, tokens, shard, place, ids[4 * start:4 * (start + length)]))
                    start += length
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield packed()
                    rows, held = [], 0
        if rows:
            yield packed()

    # written once, so that a task run again cannot renumber what others have read
    folder = work_folder(spark, "pieces")
    (docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
     .mapInArrow(cut, PIECES).write.parquet(folder))
    pieces = spark.read.schema(PIECES).parquet(folder)
    firsts = pieces.groupBy("length", "shard").agg(F.count("*").alias("n")).select(
        "length", "shard", F.expr("sum(n) OVER (ORDER BY length DESC, shard) - n").alias("first"))
    starts = firsts.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("firsts"))
    return beside_each_task(pieces, starts, "piece-starts").select(
        "doc_id", "start", "length", "doc_tokens", (F.col("firsts")[F.col("length")] + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "ids")
