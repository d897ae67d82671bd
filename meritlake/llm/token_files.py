"""Token ids in files of bit planes.

Documents are put in ascending order of their key by a range shuffle; each task encodes its part
and writes one shard. A shard is a row of chunks. A chunk holds whole documents, cut into blocks
of a fixed number of ids; each block is transposed into bit planes, and each plane is compressed
with zstandard. The chunk index (place in the shard, documents with their lengths, block sizes,
plane lengths) is stored beside the planes, so every chunk can be read alone. Spark's Parquet
writer carries the chunks: its commits survive lost executors and it reaches any store.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritlake.llm.frames import beside_each_task
from meritlake.llm.tokenizing import encoder_of, read_definition

BLOCK_IDS = 1 << 16
# A chunk ends with the document that brings it to so many ids.
CHUNK_IDS = 1 << 19

CHUNKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
    T.StructField("start_in_shard", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("block_ids", T.ArrayType(T.IntegerType())),
    T.StructField("plane_counts", T.ArrayType(T.IntegerType())),
    T.StructField("plane_bytes", T.ArrayType(T.IntegerType())),
    T.StructField("planes", T.BinaryType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_tokens", T.ArrayType(T.LongType())),
])
DOCUMENTS = "doc_id long, shard int, start_in_shard long, n_tokens long, ids binary"
CHUNK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()),
    ("block_ids", pa.list_(pa.int32())), ("plane_counts", pa.list_(pa.int32())),
    ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))])


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Bit planes of a block, lowest bit first, as many as its largest id needs; packed 8 to a byte."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    return [np.packbits((ids >> np.uint32(bit)).astype(np.uint8) & 1).tobytes() for bit in range(width)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    ids = np.zeros(count, np.uint32)
    for bit, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count).astype(np.uint32) << np.uint32(bit)
    return ids


def pack_chunk(ids: np.ndarray) -> tuple[list[int], list[int], list[int], bytes]:
    """Ids of each block, planes of each block, bytes of each plane, all planes after each other."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    sizes, counts, lengths, body = [], [], [], []
    for at in range(0, len(ids), BLOCK_IDS):
        block = ids[at:at + BLOCK_IDS]
        planes = [press.compress(plane) for plane in to_planes(block)]
        sizes.append(len(block))
        counts.append(len(planes))
        lengths += map(len, planes)
        body += planes
    return sizes, counts, lengths, b"".join(body)


def unpack_chunk(sizes: list[int], counts: list[int], lengths: list[int], body: bytes) -> np.ndarray:
    import zstandard

    press = zstandard.ZstdDecompressor()
    blocks, plane, at = [], 0, 0
    for size, count in zip(sizes, counts):
        planes = []
        for length in lengths[plane:plane + count]:
            planes.append(press.decompress(body[at:at + length]))
            at += length
        plane += count
        blocks.append(from_planes(planes, size))
    return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int,
                      text: str = "text", key: str = "doc_id") -> None:
    """Encode ``text`` of every row, each ended by ``end_id``, in ascending order of the key.

    A null text is empty and gives the end id alone. Null keys come first; rows with equal keys
    are ordered by their text's hash. Other columns are not stored. An empty table gives no chunk.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode_text = encoder_of(definition.value, pattern).encode
        chunk, start, keys, parts, held = 0, 0, [], [], 0

        def packed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = (shard, chunk, start, len(ids), *pack_chunk(ids), keys, [len(p) // 4 for p in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array([value], field.type) for value, field in zip(row, CHUNK_SCHEMA)], schema=CHUNK_SCHEMA)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode_text(value.as_py()) + end
                keys.append(name)
                parts.append(ids)
                held += len(ids) // 4
                if held >= CHUNK_IDS:
                    yield packed()
                    chunk, start, keys, parts, held = chunk + 1, start + held, [], [], 0
        if keys:
            yield packed()

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    (rows.repartitionByRange(F.col("key").asc_nulls_first())
     .sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")
     .mapInArrow(encode, CHUNKS).write.parquet(folder))


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (32-bit little-endian) of every document.

    Chunks are read alone. The start of a shard comes from a running sum over one small row per
    shard, so no shard waits for another; these rows go to the chunks, and ids are not shuffled
    (up to ``frames.MOST_SENT_ROWS`` shards).
    """
    chunks = spark.read.schema(CHUNKS).parquet(folder)
    starts = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.expr("sum(n) OVER (ORDER BY shard) - n").alias("shard_start"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_chunk(row["block_ids"], row["plane_counts"], row["plane_bytes"], row["planes"])
                lengths = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                body = ids.astype("<u4").tobytes()
                parts = [body[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([row["shard"]] * len(parts), pa.int32()),
                    pa.array(ends - lengths + row["start_in_shard"], pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array(parts, pa.binary())],
                    names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"])

    return beside_each_task(chunks.mapInArrow(decode, DOCUMENTS), starts, "shard-starts").select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")
