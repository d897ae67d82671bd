"""Merkle manifest of a dataset: a tree of digests per group, a tree over the groups, proofs for all rows.

Time-forward processing, in blocks. A node's label is its level, then its number; a node sends its
digest to its parent, whose label is larger. Messages wait in a queue ordered by label: within a
block of so many levels it is a heap in memory, bounded by the block's size; between blocks it is a
table that Spark sorts by block and label, so that a block's messages reach its task in order. The
largest groups are many blocks and lie with many tasks. The reversed sweep takes the same tables from
the root down: a parent sends every child the rest of its proof.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritlake.llm.frames import numbered, written

FAN = 3
# Levels of a block: at most 3 ** 7 = 2,187 nodes enter one.
BLOCK_LEVELS = 7
PROOF = "array<struct<left: string, right: string>>"
# Rows handed back to Spark at once.
BATCH_ROWS = 4_096


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: every value as '-' if null, else its UTF-8 byte count, a colon and its text."""
    texts = [value.cast("string") for value in values]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def rise(digests: list[str], first: int, size: int, levels: int, fan: int = FAN) -> tuple[dict[tuple[int, int], list[str]], int, str]:
    """Digests from a block's lowest nodes up: children by (level, number) of their parent, levels climbed, top digest.

    ``first`` is the number of the block's first node and ``size`` counts the nodes of its group, both on the lowest level.
    """
    queue = [(1, (first + place) // fan, place, digest) for place, digest in enumerate(digests)]
    families: dict[tuple[int, int], list[str]] = {}
    top = 0
    while top < levels and size > 1:
        top, size = top + 1, -(-size // fan)
    if not top:
        return families, 0, digests[0]
    while True:
        level, number, place, digest = heapq.heappop(queue)
        family = [digest]
        while queue and queue[0][:2] == (level, number):
            family.append(heapq.heappop(queue)[3])
        families[level, number] = family
        digest = _digest(family)
        if level == top:
            return families, top, digest
        heapq.heappush(queue, (level + 1, number // fan, number, digest))


def descend(families: dict[tuple[int, int], list[str]], top: int, proof: list[dict], count: int, first: int,
            fan: int = FAN) -> list[list[dict]]:
    """Proofs of a block's lowest nodes from the proof of its top node; labels fall, so a parent comes before its children."""
    if not top:
        return [proof]
    waiting = [(-top, -number, proof) for level, number in families if level == top]
    proofs: list[list[dict]] = [[]] * count
    while waiting:
        level, number, rest = heapq.heappop(waiting)
        level, number = -level, -number
        family = families[level, number]
        for place in range(len(family)):
            step = {"left": "".join(family[:place]), "right": "".join(family[place + 1:])}
            child = number * fan + place
            if level == 1:
                proofs[child - first] = [step, *rest]
            else:
                heapq.heappush(waiting, (1 - level, -child, [step, *rest]))
    return proofs


class _Block:
    """Rows of one block as they come, the message from above, if any, before the nodes."""

    def __init__(self, key: tuple):
        self.key, self.message, self.digests, self.first, self.size, self.rows = key, None, [], 0, 0, []

    def add(self, row: dict, carried: pa.Array | None) -> None:
        if row["number"] is None:
            self.message = row
            return
        if not self.digests:
            self.first, self.size = row["number"], row["size"]
        self.digests.append(row["digest"])
        if carried is not None:
            self.rows.append(carried)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    block = None
    for batch in batches:
        carried = batch.column("row") if "row" in batch.schema.names else None
        plain = batch.select([n for n in batch.schema.names if n != "row"]).to_pylist()
        for place, row in enumerate(plain):
            key = (row["group"], row["block"])
            if block is None or block.key != key:
                if block:
                    yield block
                block = _Block(key)
            block.add(row, carried.slice(place, 1) if carried is not None else None)
    if block:
        yield block


def _dealt(nodes: DataFrame, span: int) -> DataFrame:
    """Nodes with their block."""
    return nodes.withColumn("block", F.floor(F.col("number") / F.lit(span)).cast("long"))


def _raised(nodes: DataFrame, levels: int, fan: int) -> DataFrame:
    """The blocks' top nodes: group, number, size, digest."""
    def climb(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for block in _blocks(batches):
            _, top, digest = rise(block.digests, block.first, block.size, levels, fan)
            out.append((block.key[0], block.key[1], -(-block.size // fan ** top), digest))
            if len(out) >= BATCH_ROWS:
                yield _tops(out)
                out = []
        if out:
            yield _tops(out)

    asked = _dealt(nodes.select("group", "number", "size", "digest"), fan ** levels)
    return (asked.repartition("group", "block").sortWithinPartitions("group", "block", "number")
            .mapInArrow(climb, "group string, number long, size long, digest string"))


def _tops(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["group", "number", "size", "digest"])


def _lowered(nodes: DataFrame, messages: DataFrame, levels: int, fan: int) -> DataFrame:
    """All columns of the nodes with proof and top; messages are group, block, proof, top, one for every block."""
    others = [c for c in nodes.columns if c not in ("group", "number", "size", "digest")]
    asked = _dealt(nodes.select("group", "number", "size", "digest", F.struct(*[nodes[c] for c in others or ["number"]]).alias("row")),
                   fan ** levels)
    kind = asked.schema["row"].dataType
    both = asked.withColumn("proof", F.lit(None).cast(PROOF)).withColumn("top", F.lit(None).cast("string")).unionByName(
        messages.select("group", "block", "proof", "top"), allowMissingColumns=True)
    schema = T.StructType([
        T.StructField("group", T.StringType()), T.StructField("number", T.LongType()), T.StructField("digest", T.StringType()),
        T.StructField("row", kind), T.StructField("proof", T.ArrayType(T.StructType([
            T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))),
        T.StructField("top", T.StringType())])
    proof_kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    simple = (pa.string(), pa.int64(), pa.string(), None, proof_kind, pa.string())

    def fall(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = [pa.concat_arrays(c) if k is None else pa.array(c, k) for c, k in zip(zip(*out), simple)]
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        for block in _blocks(batches):
            families, top, _ = rise(block.digests, block.first, block.size, levels, fan)
            proofs = descend(families, top, block.message["proof"], len(block.digests), block.first, fan)
            for place, (digest, row, proof) in enumerate(zip(block.digests, block.rows, proofs)):
                out.append((block.key[0], block.first + place, digest, row, proof, block.message["top"]))
            if len(out) >= BATCH_ROWS:
                yield packed()
                out = []
        if out:
            yield packed()

    lowered = (both.repartition("group", "block")
               .sortWithinPartitions("group", "block", F.col("number").asc_nulls_first()).mapInArrow(fall, schema))
    return lowered.select("group", "number", "digest", *[F.col("row")[c].alias(c) for c in others], "proof", "top")


def _tables(nodes: DataFrame, levels: int, fan: int) -> list[DataFrame]:
    """The nodes on every block border, from the lowest; the last has one node a group."""
    tables, largest = [nodes], nodes.agg(F.max("size")).first()[0] or 0  # one number
    while largest > 1:
        tables.append(written(_raised(tables[-1], levels, fan), f"merkle-{len(tables)}"))
        largest = -(-largest // fan ** levels)
    return tables


def _proven(tables: list[DataFrame], messages: DataFrame, levels: int, fan: int) -> DataFrame:
    """The lowest nodes with their proofs, from messages to the top blocks."""
    if len(tables) == 1:  # no group has two nodes: each is its own top
        return tables[0].join(messages.drop("block"), "group").drop("size")
    for nodes in reversed(tables[1:-1]):
        lowered = _lowered(nodes, messages, levels, fan)
        messages = lowered.select("group", F.col("number").alias("block"), "proof", "top")
    return _lowered(tables[0], messages, levels, fan)


def merkle_manifest(docs: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id",
                    carry: dict[str, Column] | None = None, fan: int = FAN, levels: int = BLOCK_LEVELS) -> DataFrame:
    """group, key, leaf, subroot, root, proof and the columns ``carry`` of every row.

    A leaf is the digest of the row's ``fields``. Leaves of a group ascend by key (null first, rows
    with equal keys by digest); every ``fan`` consecutive nodes have a parent until one is left, the
    subroot, a lone leaf being its own. Subroots in order of the group (null first, else bytewise)
    give the root likewise. ``proof`` has one struct(left, right) for each level from leaf to root:
    the digests of the siblings before and after, joined. Repeated rows are leaves of their own.
    Group and key may be any columns; others are not kept. An empty table gives an empty table.
    """
    carry = carry or {}
    # null sorts before every text, the empty one included
    name = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit(""))
    leaves = written(docs.select(
        name.alias("group"), docs[key].alias("key"), leaf_digest([docs[c] for c in fields]).alias("digest"),
        docs[group].alias("group_value"),
        F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in carry.items()]).alias("carried")), "merkle-leaves")
    nodes = numbered(leaves, ["group"], [F.col("key").asc_nulls_first(), F.col("digest")], "merkle-order")
    tables = _tables(nodes, levels, fan)

    subroots = tables[-1].select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    over = _tables(numbered(subroots, ["group"], [F.col("name")], "merkle-subroots"), levels, fan)
    top = over[-1].select("group", F.lit(0).cast("long").alias("block"), F.array().cast(PROOF).alias("proof"),
                          F.col("digest").alias("top"))
    proven = written(_proven(over, top, levels, fan), "merkle-subroot-proofs")
    roots = proven.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("block"), "proof",
                          F.concat_ws("|", "digest", "top").alias("top"))
    found = _proven(tables, roots, levels, fan)
    return found.select(
        F.col("group_value").alias(group), F.col("key").alias(key), F.col("digest").alias("leaf"),
        F.split("top", r"\|")[0].alias("subroot"), F.split("top", r"\|")[1].alias("root"), "proof",
        *[F.col("carried")[n].alias(n) for n in carry])


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))
