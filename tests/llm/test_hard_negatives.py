"""Hard negatives against all pairs in plain Python, bounds against exact scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritlake.llm import queries as llm_queries
from meritlake.llm.hard_negatives import LEVELS, mine_hard_negatives, products, summaries
from tests.compare import connect, difference

SCHEMA = "vec_id long, label int, embedding array<float>, score string"


def plain(rows, asks, positives=5, negatives=10, low=30, high=90):
    good = [(k, label, [math.floor(256 * float(np.float32(x))) for x in v]) for k, label, v, _ in rows
            if None not in (k, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (key, label, vector) in enumerate(good):
        if not asks(key):
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, other)), k, other_label)
                        for b, (k, other_label, other) in enumerate(good) if a != b)
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and -low * score <= -100 * s[0] <= -high * score]
            out += [(key, positive, rank, s[1], -score, -s[0]) for rank, s in enumerate(inside[:negatives], 1)]
    return sorted(out)


def found(frame):
    return sorted(map(tuple, frame.collect()))


def rows_of(count, width, seed, hot=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for key in range(count):
        label = 0 if rng.random() < hot else int(rng.integers(0, 6))
        vector = (centres[label] + 0.9 * rng.normal(size=width) + 0.4).astype(np.float32).tolist()
        rows.append((key, label, vector, "clash"))
    return rows


@pytest.mark.parametrize("width, count", [(24, 300), (3, 120), (1, 60)])
def test_equals_all_pairs(spark, width, count):
    rows = rows_of(count, width, width)
    rows += [(count + i, *rows[i][1:]) for i in range(0, 40)]  # equal vectors: ties
    rows += [(None, 1, rows[0][2], ""), (9_000, None, rows[0][2], ""), (9_001, 1, None, ""),
             (9_002, 1, [None] * width, ""), (9_003, 2, [float("nan")] * width, ""), (9_004, 2, [float("inf")] * width, ""),
             (9_005, 3, [0.0] * width, ""), (9_010, 77, rows[5][2], "")]
    asks = lambda key: key % 10 == 0
    frame = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 10 == 0,
                                block_rows=37, part_rows=11)
    expected = plain(rows, asks)
    assert expected and found(frame) == expected


def test_repeated_rows_are_rows(spark):
    rows = rows_of(40, 8, 3)
    rows += [rows[10]] * 3 + [rows[11]] * 2
    frame = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, block_rows=7, part_rows=2)
    assert found(frame) == plain(rows, lambda key: key % 10 == 0)


def test_small_tables(spark):
    for rows in ([], [(0, 1, [1.0], "")], [(0, 1, [], ""), (1, 1, [], ""), (2, 2, [], "")],
                 [(0, 1, [1.0, 2.0], ""), (100, 2, [1.0, 1.0], "")]):
        frame = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
        assert found(frame) == plain(rows, lambda key: key % 100 == 0)


def test_large_components(spark):
    rows = [(i, i % 2, [float(2 ** 18 + i), float(-(2 ** 17)), 3.0], "") for i in range(30)]
    rows.append((100, 0, [1e30, 0.0, 0.0], ""))  # its score fits no long: takes no part
    frame = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, low=0, high=200)
    assert found(frame) == plain(rows[:-1], lambda key: key % 10 == 0, low=0, high=200)


def test_segments_bound_scores():
    rng = np.random.default_rng(1)
    for width in (1, 5, 16, 64):
        left, right = rng.integers(-300, 900, (20, width)), rng.integers(-300, 900, (30, width))
        exact, last = left @ right.T, None
        for segments in LEVELS:
            (m, d), (n, e) = summaries(left, segments), summaries(right, segments)
            assert (np.abs(exact - m @ n.T) <= d @ e.T + 1e-6).all()
            width_now = (d @ e.T).mean()
            assert last is None or width_now <= last + 1e-9
            last = width_now
    alive = rng.random((20, 30)) < 0.03
    assert (products(left, right, alive)[alive] == (left @ right.T)[alive]).all()


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(llm_queries.op12_hard_negatives(spark, folder), connect(folder), llm_queries.OP12_SQL) is None
