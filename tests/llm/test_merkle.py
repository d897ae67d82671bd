"""Manifest against a plain loop over whole trees."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meritlake.llm import queries as llm_queries
from meritlake.llm.merkle import descend, folded, merkle_manifest, proof_digest, rise
from tests.compare import connect, difference

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fan=3):
    """Root, and for every lowest node its siblings as (before, after), level by level."""
    seats, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for at, seat in enumerate(seats):
            first = seat // fan * fan
            proofs[at].append(("".join(nodes[first:seat]), "".join(nodes[seat + 1:first + fan])))
        seats = [s // fan for s in seats]
        nodes = [digest(nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], proofs


def plain_manifest(rows):
    def leaf(row):
        values = (row[0], row[3], row[2], row[4], row[1])
        return digest(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = climb([trees[g][0] for g in order])
    return sorted(
        repr((x[3][0], x[2], g, trees[g][0], root, proof + above[i]))
        for i, g in enumerate(order)
        for x, proof in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]))


def found(frame):
    return sorted(repr((r.doc_id, r.leaf, r.source, r.subroot, r.root, [(s.left, s.right) for s in r.proof]))
                  for r in frame.collect())


def many():
    rows = [(i, f"text {i}\n", "en", "hot", i, "clash") for i in range(400)]
    rows += [(1000 + i, None if i % 3 else "ä\n\n", None, f"s{i % 23}", None, None) for i in range(90)]
    rows += [(None, "x", "fi", None, 1, ""), (None, "x", "fi", None, 1, ""), (5, "", "", "", 0, ""), (5, "y", "", "", 0, "")]
    rows += [(7, "long " * 50_000, "en", "=", 1, ""), (7, "long " * 50_000, "en", "=", 1, "")]
    return rows


@pytest.mark.parametrize("levels", [2, 7])
def test_manifest_equals_plain_trees(spark, levels):
    rows = many()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    result = merkle_manifest(docs, FIELDS, levels=levels).cache()
    assert found(result) == plain_manifest(rows)
    folds = result.select((folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"),
                          proof_digest(F.col("proof")).alias("d"), "proof").collect()
    assert all(r.ok for r in folds)
    assert all(r.d == digest([s.left + s.right for s in r.proof]) for r in folds)


@pytest.mark.parametrize("rows", [
    [], [(1, "a", "en", "s", 1, "")], [(1, "a", "en", None, 1, ""), (2, None, None, "", None, "")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(merkle_manifest(docs, FIELDS)) == (plain_manifest(rows) if rows else [])


def test_blocks_up_and_down():
    nodes = [digest([str(i)]) for i in range(20)]
    root, proofs = climb(nodes)
    families, top, found_root = rise(nodes, 0, 20, 7)
    assert (top, found_root) == (3, root)
    ways = descend(families, top, [], 20, 0)
    assert [[(s["left"], s["right"]) for s in way] for way in ways] == proofs


def test_query_equals_sql_with_awkward_rows(spark, tmp_path):
    rows = [r[:5] for r in many() if r[0] is not None]
    rows = [(r[0] if r[0] not in (5, 7) else r[0] + 10_000 + i, *r[1:]) for i, r in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1) \
        .write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    frame = llm_queries.op11_merkle_manifest(spark, str(tmp_path))
    assert difference(frame, connection, llm_queries.OP11_SQL) is None
    assert {r.verified for r in frame.select("verified").collect()} == {True, False}


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(llm_queries.op11_merkle_manifest(spark, folder), connect(folder), llm_queries.OP11_SQL) is None
