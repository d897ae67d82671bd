"""Hard negatives by segment summaries.

Every vector is cut into segments, on several levels; each segment keeps its mean and its deviation
(both scaled by the root of its length). The inner product of two segments is the product of their
means, give or take the product of their deviations, so the sums over all segments bound a score from
both sides. Pairs that the bounds of one segment cannot decide go on to more and shorter segments, and
only what is left is scored exactly. Rows are packed into blocks in order of their label, anchors into
parts; a part and a block meet in one task, which hands back the best of each anchor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritlake.llm.frames import numbered, written

# Segments of a vector on each level.
LEVELS = (1, 4, 16)
BLOCK_ROWS = 8_192
PART_ROWS = 4_096
# Pairs that a task looks at together.
CELLS = 1 << 21
# Scores stay below this, so that a hundred of one fits a long.
MOST_SCORE = 2.0 ** 55
NONE = np.iinfo(np.int64).min
PACK = ("labels array<long>, keys binary, numbers binary, label_of binary, vectors binary, means binary, "
        "deviations binary, rows int")
MEETING = "anchor long, place int, other_key long, other_number long, score long"


def borders(width: int, segments: int) -> np.ndarray:
    """Firsts of the segments, of nearly equal length; no more segments than components."""
    return np.unique(np.arange(min(segments, width)) * width // max(1, min(segments, width)))


def summaries(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row, times the root of the segment's length."""
    width = vectors.shape[1]
    if not width:
        return np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1))
    firsts = borders(width, segments)
    lengths = np.diff([*firsts, width])
    means = np.add.reduceat(vectors, firsts, axis=1) / lengths
    apart = vectors - np.repeat(means, lengths, axis=1)
    return means * np.sqrt(lengths), np.sqrt(np.add.reduceat(apart * apart, firsts, axis=1))


def products(left: np.ndarray, right: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Inner products of all rows; where few pairs are alive, of these only, else 0."""
    if alive.mean() > 1 / 16:
        return left @ right.T
    found = np.zeros(alive.shape, left.dtype)
    rows, columns = np.nonzero(alive)
    for at in range(0, len(rows), 1 << 16):
        r, c = rows[at:at + (1 << 16)], columns[at:at + (1 << 16)]
        found[r, c] = np.einsum("ij,ij->i", left[r], right[c])
    return found


def largest(values: np.ndarray, most: int) -> np.ndarray:
    """The ``most``-th largest value of each row; -inf where a row has fewer."""
    if values.shape[1] < most:
        return np.full(len(values), -np.inf)
    return np.partition(values, -most, axis=1)[:, -most]


class Packed:
    """Rows of a block or part as they were packed."""

    def __init__(self, row: pd.Series):
        count = int(row["rows"])
        self.keys, self.numbers, self.labels = (np.frombuffer(row[c], np.int64) for c in ("keys", "numbers", "label_of"))
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(count, -1).astype(np.int64)
        means = np.frombuffer(row["means"], np.float64).reshape(count, -1)
        deviations = np.frombuffer(row["deviations"], np.float64).reshape(count, -1)
        sizes = [max(1, len(borders(self.vectors.shape[1], s))) for s in LEVELS]
        cuts = np.cumsum(sizes)[:-1]
        self.levels = list(zip(np.split(means, cuts, axis=1), np.split(deviations, cuts, axis=1)))
        self.length = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))


def filtered_scores(part: Packed, rows: np.ndarray, block: Packed, columns: np.ndarray, alive: np.ndarray,
                    keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs ``keep`` leaves after all levels, and their exact scores (whole numbers)."""
    slack = 1e-9 * np.outer(part.length[rows], block.length[columns]) + 1e-6
    for (means, deviations), (other_means, other_deviations) in zip(part.levels, block.levels):
        if not alive.any():
            break
        middle = products(means[rows], other_means[columns], alive)
        give = products(deviations[rows], other_deviations[columns], alive) + slack
        alive = keep(middle - give, middle + give, alive)
    left, right = part.vectors[rows], block.vectors[columns]
    if slack.size and slack.max() < 2.0 ** 50 * 1e-9:  # then doubles hold every product and sum of them
        return alive, np.rint(products(left.astype(float), right.astype(float), alive)).astype(np.int64)
    return alive, products(left, right, alive)


def best(keys: np.ndarray, numbers: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    return np.lexsort((numbers, keys, -scores))[:most]


def _chunks(rows: np.ndarray, columns: int) -> list[np.ndarray]:
    step = max(1, CELLS // max(1, columns))
    return [rows[at:at + step] for at in range(0, len(rows), step)]


def positives_in(part: Packed, block: Packed, most: int) -> list[tuple]:
    """Best rows of its label for every anchor of a part, out of one block."""
    out = []
    for label in np.intersect1d(part.labels, block.labels):
        columns = np.flatnonzero(block.labels == label)
        for rows in _chunks(np.flatnonzero(part.labels == label), len(columns)):
            alive = part.numbers[rows][:, None] != block.numbers[columns][None, :]

            def keep(lower, upper, alive):
                return alive & (upper >= largest(np.where(alive, lower, -np.inf), most)[:, None])

            alive, scores = filtered_scores(part, rows, block, columns, alive, keep)
            for at, row in enumerate(rows):
                chosen = np.flatnonzero(alive[at])
                names, numbers, values = block.keys[columns[chosen]], block.numbers[columns[chosen]], scores[at, chosen]
                out += [(part.numbers[row], -1, names[i], numbers[i], values[i]) for i in best(names, numbers, values, most)]
    return out


def negatives_in(part: Packed, block: Packed, limits: np.ndarray, most: int, low: int, high: int) -> list[tuple]:
    """Best rows of other labels between the limits of every anchor and positive, out of one block.

    ``limits`` has the positives' scores, a column for each place, ``NONE`` where an anchor has fewer.
    """
    out = []
    columns = np.arange(len(block.keys))
    for rows in _chunks(np.flatnonzero((limits != NONE).any(axis=1)), len(columns)):
        alive = part.labels[rows][:, None] != block.labels[columns][None, :]
        floors = np.where(limits[rows] == NONE, np.inf, limits[rows] * float(low))
        ceilings = limits[rows] * float(high)

        def keep(lower, upper, alive):
            kept = np.zeros_like(alive)
            for place in range(limits.shape[1]):
                least, top = floors[:, place, None], ceilings[:, place, None]
                sure = alive & (lower * 100 >= least) & (upper * 100 <= top)
                enough = largest(np.where(sure, lower, -np.inf), most)[:, None]
                kept |= alive & (upper * 100 >= least) & (lower * 100 <= top) & (upper >= enough)
            return kept

        alive, scores = filtered_scores(part, rows, block, columns, alive, keep)
        for at, row in enumerate(rows):
            chosen = np.flatnonzero(alive[at])
            values = scores[at, chosen]
            for place in range(limits.shape[1]):
                score = limits[row, place]
                if score == NONE:
                    continue
                inside = chosen[(values * 100 >= score * low) & (values * 100 <= score * high)]
                names, numbers = block.keys[inside], block.numbers[inside]
                out += [(part.numbers[row], place, names[i], numbers[i], scores[at, inside[i]])
                        for i in best(names, numbers, scores[at, inside], most)]
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ("anchor", "place", "other_key", "other_number", "score")
    return pd.DataFrame({n: np.array(c, "int32" if n == "place" else "int64")
                         for n, c in zip(names, zip(*rows) if rows else [()] * 5)})


def _packed(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Consecutive rows packed by ``size``: one row for each pack."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(group["vector"].to_numpy()).astype(np.int64).reshape(len(group), -1)
        means, deviations = zip(*(summaries(vectors, s) for s in LEVELS))
        labels = group["label"].to_numpy(np.int64)
        return pd.DataFrame({
            name: group[name].iloc[:1], "labels": [np.unique(labels)], "keys": group["key"].to_numpy(np.int64).tobytes(),
            "numbers": group["number"].to_numpy(np.int64).tobytes(), "label_of": labels.tobytes(),
            "vectors": vectors.astype(np.int32).tobytes(), "means": np.hstack(means).tobytes(),
            "deviations": np.hstack(deviations).tobytes(), "rows": len(group)})

    dealt = rows.withColumn(name, F.floor(F.col("place_in_order") / size).cast("long")).drop("place_in_order")
    return written(dealt.groupBy(name).applyInPandas(pack, f"{name} long, {PACK}"), name)


def _meetings(pairs: DataFrame, parts: DataFrame, blocks: DataFrame, meet: Callable) -> DataFrame:
    """What comes of every pair of a part and a block; each pair is a group of its own, so a task holds one of each."""
    pairs = written(pairs, "meetings")
    right = pairs.select(F.col("part").alias("part_met"), F.col("block").alias("block_met")).join(
        blocks.withColumnRenamed("block", "block_met"), "block_met")
    return (pairs.join(parts, "part").groupBy("part", "block")
            .cogroup(right.groupBy("part_met", "block_met")).applyInPandas(meet, MEETING))


def _top(found: DataFrame, most: int) -> DataFrame:
    """The best ``most`` of every anchor and place, ranked."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "other_key", "other_number")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine_hard_negatives(vectors: DataFrame, anchors: Column, label: str = "label", vector: str = "embedding",
                        key: str = "vec_id", scale: int = 256, positives: int = 5, negatives: int = 10,
                        low: int = 30, high: int = 90, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the exact inner product. An anchor's positives are
    its best rows of the same (integer) label; negatives of an anchor and positive are the best rows of
    other labels whose score times 100 lies between ``low`` and ``high`` times the positive's. Higher
    scores first, ties to the smaller key, then by place in an internal order. Rows without key, label
    or vector, with a null or non-finite component, with a component too large for a score to fit a
    long, or not of the commonest length take no part. Repeated rows are rows of their own: copies of
    an anchor are its positives, and each copy of an anchor gives its rows. Other columns are not
    read. An empty table, and an anchor without positives, give no rows.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(
        vectors[key].cast("long").alias("key"), vectors[label].cast("long").alias("label"),
        vectors[vector].cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    usable = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("key").isNotNull() & F.col("label").isNotNull() & usable)
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths[0]["width"]
    most_component = min(float(2 ** 31 - 1), (MOST_SCORE / max(1, width)) ** 0.5)
    rows = (rows.filter(F.size("vector") == width)
            .withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale)))))
            .filter(~F.exists("vector", lambda x: (x > most_component) | (x < -most_component))))
    ordered = numbered(rows, [], [F.col("label"), F.col("key")], "vectors").drop("size")
    blocks = _packed(ordered.select("key", "label", "vector", "number", F.col("number").alias("place_in_order")),
                     "block", block_rows)
    asking = numbered(ordered.filter("asks").select("key", "label", "vector", F.col("number").alias("own")), [],
                      [F.col("own")], "anchors")
    parts = _packed(asking.select("key", "label", "vector", F.col("own").alias("number"),
                                  F.col("number").alias("place_in_order")), "part", part_rows)
    count = blocks.count()

    # parts and blocks that share a label
    pairs = (parts.select("part", F.explode("labels").alias("label"))
             .join(blocks.select("block", F.explode("labels").alias("label")), "label").select("part", "block").distinct())

    def meet_positives(_: tuple, part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(block):
            return _frame([])
        return _frame(positives_in(Packed(part.iloc[0]), Packed(block.iloc[0]), positives))

    met = _meetings(pairs, parts, blocks, meet_positives)
    found = written(_top(met, positives), "positives")

    # scores of the positives, by place, beside their part
    of_part = asking.select(F.col("own").alias("anchor"), F.floor(F.col("number") / part_rows).cast("long").alias("part"))
    limits = written(found.join(of_part, "anchor").groupBy("part").agg(
        F.collect_list(F.struct("anchor", "rank", "score")).alias("limits")), "limits")
    every = (parts.join(limits, "part").select("part", "labels", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(count - 1, 0)).cast("long"))).alias("block"))
             .join(blocks.select("block", F.col("labels").alias("block_labels")), "block")
             .filter((F.size(F.array_union("labels", "block_labels")) > 1)).select("part", "block"))

    def meet_negatives(_: tuple, part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(block):
            return _frame([])
        asked = Packed(part.iloc[0])
        seat = {number: at for at, number in enumerate(asked.numbers.tolist())}
        scores = np.full((len(asked.keys), positives), NONE)
        for limit in part["limits"].iloc[0]:
            scores[seat[limit["anchor"]], limit["rank"] - 1] = limit["score"]
        return _frame(negatives_in(asked, Packed(block.iloc[0]), scores, negatives, low, high))

    met = _meetings(every, parts.join(limits, "part"), blocks, meet_negatives)
    names = asking.select(F.col("own").alias("anchor"), F.col("key").alias("anchor_id"))
    chosen = found.join(names, "anchor").select(
        "anchor", "anchor_id", (F.col("rank") - 1).alias("place"), F.col("other_key").alias("positive_id"),
        F.col("score").alias("positive_score"))
    return _top(met, negatives).join(chosen, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_key").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
