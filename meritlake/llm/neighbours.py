"""Approximate nearest neighbours by a forest of random-projection trees.

The trees' planes are fitted on a bounded sample and sent to all tasks; every vector is then put
into its leaf of each tree. A query walks all trees at once through one priority queue, nearest
plane first, until the leaves it has met hold enough vectors. Vectors and queries meet by leaf;
large leaves are cut into blocks and many queries into parts, so no task sees more than one of
each. Each meeting gives one row with its best vectors, ranked by exact inner products, and the
rows of a query are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.session import work_folder

SAMPLE_ROWS = 20_000
TREES = 6
# Leaves of a tree over the sample; more vectors make leaves larger, not more.
LEAF_SAMPLE_ROWS = 400
# Share of all vectors that a query's leaves hold together, counted once per tree.
SEARCH_SHARE = 1.2
LEAST_CANDIDATES = 4_000
BLOCK_ROWS = 4_000
# Queries that meet a block together.
QUERY_ROWS = 8_000
SEED = 7


class Tree(NamedTuple):
    """Node i: plane ``planes[i]``, offset, and two children; a child below zero is leaf ``-child - 1``."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int


def grow_tree(sample: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    """Splits by a random direction at the median until a part has ``leaf_rows`` rows or cannot be split."""
    planes, offsets, children, leaves = [], [], [], 0
    waiting = [(np.arange(len(sample)), -1, 0)]
    while waiting:
        rows, parent, side = waiting.pop()
        node = None
        if len(rows) > leaf_rows:
            for _ in range(3):
                # the direction between two rows follows the data better than a blind one
                first, second = rng.choice(rows, 2, replace=False)
                plane = sample[first] - sample[second]
                size = np.linalg.norm(plane)
                if not size:
                    plane, size = rng.standard_normal(sample.shape[1]), 1.0
                plane = plane / size
                heights = sample[rows] @ plane
                offset = float(np.median(heights))
                right = heights > offset
                if 0 < right.sum() < len(rows):
                    node = len(planes)
                    planes.append(plane)
                    offsets.append(offset)
                    children.append([0, 0])
                    waiting += [(rows[~right], node, 0), (rows[right], node, 1)]
                    break
        if node is None:
            node, leaves = -leaves - 1, leaves + 1
        if parent >= 0:
            children[parent][side] = node
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(planes).reshape(-1, width), np.array(offsets),
                np.array(children, np.int64).reshape(-1, 2), leaves)


def leaves_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    if not len(tree.offsets):
        return np.zeros(len(vectors), np.int64)
    at = np.zeros(len(vectors), np.int64)
    inner = np.arange(len(vectors))
    while len(inner):
        nodes = at[inner]
        heights = np.einsum("ij,ij->i", vectors[inner], tree.planes[nodes])
        at[inner] = tree.children[nodes, (heights > tree.offsets[nodes]).astype(int)]
        inner = inner[at[inner] >= 0]
    return -at - 1


def search_leaves(forest: list[Tree], counts: list[np.ndarray], vector: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) of a query, best first, until they hold ``enough`` vectors together.

    One queue serves all trees; a leaf's rank is the smallest distance to a plane that was
    crossed on the wrong side on the way to it.
    """
    heights = [tree.planes @ vector - tree.offsets if len(tree.offsets) else None for tree in forest]
    queue = [(-np.inf, number, 0 if len(tree.offsets) else -1) for number, tree in enumerate(forest)]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and held < enough:
        far, number, node = heapq.heappop(queue)
        while node >= 0:
            height = heights[number][node]
            near, other = forest[number].children[node][::1 if height <= 0 else -1]
            heapq.heappush(queue, (max(far, abs(height)), number, int(other)))
            node = int(near)
        size = int(counts[number][-node - 1])
        if size:
            found.append((number, -node - 1))
            held += size
    return found


def usable(vector: Column) -> Column:
    """Not null, not empty, no null, infinite or NaN component, and some component but zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def nearest(vectors: DataFrame, queries: Column, most: int = 20, vector: str = "embedding", key: str = "vec_id",
            trees: int = TREES, share: float = SEARCH_SHARE, least: int = LEAST_CANDIDATES,
            sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``most`` nearest found of every row that ``queries`` selects.

    Nearness is the inner product of the original vectors in double precision; ties go to the
    smaller key. Rows without key, or whose vector ``usable`` refuses or is not of the commonest
    length, take no part. A key that several rows have counts as one candidate with its best
    score, and as one query for each of its rows, merged. A query never finds its own key. With
    fewer candidates than ``most``, all are found. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    found = "query_id long, rank int, vec_id long, score double"
    common = (rows.groupBy(F.size("vector").alias("width")).count()
              .orderBy(F.desc("count"), "width").limit(1).collect())
    if not common:
        return spark.createDataFrame([], found)
    width, total = common[0]["width"], common[0]["count"]
    rows = rows.filter(F.size("vector") == width)

    sample = np.array([r.vector for r in rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id")
                       .limit(sample_rows).collect()])  # at most sample_rows vectors
    rng = np.random.default_rng(SEED)
    forest = [grow_tree(sample, leaf_rows, rng) for _ in range(trees)]
    sent = spark.sparkContext.broadcast(forest)  # its size follows the sample's bound

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = np.stack([leaves_of(tree, _matrix(batch.column(1))) for tree in sent.value], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(
                    pa.array(np.arange(len(leaves) + 1) * leaves.shape[1], pa.int32()),
                    pa.array(leaves.ravel(), pa.int32()))], names=[*batch.schema.names, "leaves"])

    folder = work_folder(spark, "forest")
    rows.mapInArrow(place, "vec_id long, vector array<double>, asks boolean, leaves array<int>").write.parquet(folder)
    placed = spark.read.parquet(folder)
    member = placed.select("vec_id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = [np.zeros(max(1, tree.leaves), np.int64) for tree in forest]
    for row in member.groupBy("tree", "leaf").count().collect():  # one row a leaf, as many as the forest has
        sizes[row.tree][row.leaf] = row["count"]
    parts = -(-placed.filter("asks").count() // QUERY_ROWS)
    sent_sizes = spark.sparkContext.broadcast(sizes)
    enough = max(least, share * total)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, vectors_here = batch.column(0).to_pylist(), _matrix(batch.column(1))
            out = []
            for name, value in zip(names, vectors_here):
                for tree, leaf in search_leaves(sent.value, sent_sizes.value, value, enough):
                    blocks = -(-int(sent_sizes.value[tree][leaf]) // block_rows)
                    out += [(name, value.tolist(), tree, leaf, block) for block in range(blocks)]
                if len(out) > 2_000:
                    yield _asked(out)
                    out = []
            if out:
                yield _asked(out)

    asked = (placed.filter("asks").select("vec_id", "vector").mapInArrow(
        ask, "query_id long, vector array<double>, tree int, leaf int, block int"))
    leaf_blocks = F.element_at(F.element_at(
        F.lit([(-(-s // block_rows)).clip(1).tolist() for s in sizes]), F.col("tree") + 1), F.col("leaf") + 1)
    share_of = F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts))).cast("int")
    asked = asked.withColumn("part", share_of)
    member = member.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(0, parts - 1)))))
    blocked = member.withColumn("block", F.pmod(F.xxhash64("vec_id"), leaf_blocks.cast("long")).cast("int"))

    def meet(asking: pd.DataFrame, holding: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(holding):
            return _met([])
        names, held = holding["vec_id"].to_numpy(), np.stack(holding["vector"].to_numpy())
        asked_vectors = np.stack(asking["vector"].to_numpy())
        # the matrix product may differ in the last bits between equal vectors: it only chooses
        rough = asked_vectors @ held.T
        slack = 1e-9 * np.abs(asked_vectors).max(axis=1) * np.abs(held).max() * held.shape[1]
        plain = len(np.unique(names)) == len(names)
        out = []
        for query, value, line, give in zip(asking["query_id"].to_numpy(), asked_vectors, rough, slack):
            line = np.where(names == query, -np.inf, line)
            least = np.partition(line, -most)[-most] if plain and len(line) > most else -np.inf
            chosen = np.flatnonzero((line >= least - give) & (line > -np.inf))
            scores = (held[chosen] * value).sum(axis=1)
            best = np.lexsort((names[chosen], -scores))
            best = best[np.sort(np.unique(names[chosen][best], return_index=True)[1])][:most]
            out.append((query, names[chosen][best].tolist(), scores[best].tolist()))
        return _met(out)

    met = (asked.groupBy("tree", "leaf", "block", "part").cogroup(blocked.groupBy("tree", "leaf", "block", "part"))
           .applyInPandas(meet, "query_id long, vec_ids array<long>, scores array<double>"))

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        names, scores = np.concatenate(parts["vec_ids"].to_numpy()), np.concatenate(parts["scores"].to_numpy())
        order = np.lexsort((names, -scores))
        _, first = np.unique(names[order], return_index=True)
        best = order[np.sort(first)][:most]
        return pd.DataFrame({"query_id": parts["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32),
                             "vec_id": names[best], "score": scores[best]})

    return met.groupBy("query_id").applyInPandas(merge, found)


def _met(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows)) or [(), (), ()]
    return pd.DataFrame({"query_id": pd.Series(columns[0], dtype="int64"), "vec_ids": pd.Series(columns[1], dtype=object),
                         "scores": pd.Series(columns[2], dtype=object)})


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=["query_id", "vector", "tree", "leaf", "block"])
