"""Substring matching by trigrams against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.operators import degrees
from meritlake.operators.grams import indexed, with_contained


@pytest.mark.parametrize("shortest", [1, 3])
def test_contained_equals_loops(spark, shortest):
    rng = random.Random(shortest)
    letters = "abcä日🙂 .*\n(A"
    word = lambda low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    texts = [(i, rng.choice("xyz"), word(0, 60)) for i in range(150)] + [(200, "x", None), (201, None, "abc"), (202, "x", "")]
    texts += [(300 + i, "x", texts[0][2]) for i in range(20)]
    needles = [(rng.choice("xyz"), word(shortest, 5)) for _ in range(200)] + [("x", None), ("x", ""), (None, "abc")]
    needles += needles[:30]
    got = {r.i: (r.text, sorted(r.found)) for r in with_contained(
        spark.createDataFrame(texts, "i int, k string, text string"), F.col("text"),
        spark.createDataFrame(needles, "k string, needle string"), "needle", ["k"]).collect()}
    want = {i: (text, sorted({n for key, n in needles if key == k and key and n and text and n in text})) for i, k, text in texts}
    assert got == want and any(len(found) > 2 for _, found in want.values())


def test_no_needles_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "abc")], "i int, text string")
    needles = spark.createDataFrame([("bc",)], "needle string")
    assert [r.found for r in with_contained(texts, F.col("text"), needles.limit(0), "needle").collect()] == [[]]
    assert with_contained(texts.limit(0), F.col("text"), needles, "needle").count() == 0
    assert [r.found for r in with_contained(texts, F.col("text"), needles, "needle").collect()] == [["bc"]]


def test_a_million_keywords(spark):
    keywords = spark.range(1_000_000, numPartitions=8).selectExpr(
        "concat('p', id % 3) AS programme_key", "'role' AS kind", "concat('Task ', hex(id * 2654435761 % 4294967296)) AS keyword")
    known = [r.keyword for r in keywords.where("programme_key = 'p1'").limit(5).collect()]
    texts = spark.createDataFrame(
        [(1, "p1", "did " + " and ".join(known[:3]).upper()), (2, "p1", "did " + known[0].lower()), (3, "p2", "did " + known[0]),
         (4, "p1", None), (5, "p1", "nothing of it")], "i int, programme_key string, text string")
    frame = degrees.keyword_hits(texts, keywords)
    rows = {r.i: r for r in frame.collect()}
    low = [k.lower() for k in known]
    every = {r.k for r in keywords.where("programme_key = 'p1'").selectExpr("lower(keyword) AS k").collect()}
    for number, text in ((1, "did " + " and ".join(low[:3])), (2, "did " + low[0])):
        assert rows[number].keyword_hits == sum(k in text for k in every) > 0
    assert rows[1].degree_relevance == "high" and [rows[i].keyword_hits for i in (3, 4, 5)] == [0, 0, 0]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_programmes_as_a_table(spark):
    listed = [(i, *p) for i, p in enumerate(K.DEGREE_PROGRAMMES)]
    texts = [name for _, _, name in listed] + [key.upper() for _, key, _ in listed] + [name[3:9] for _, _, name in listed]
    texts += ["Rakennusmestari (AMK)!", "nothing known", "", " ", "a", "ab", None, "Business", "BUSINESS"]
    frame = spark.createDataFrame([(t,) for t in texts], "degree string")
    got = {r.degree: (r.programme_key, r.supported) for r in degrees.match_degrees(
        frame, spark.createDataFrame(listed, "place int, key string, name string")).collect()}
    want = {r.degree: (r.m, r.s) for r in frame.select(
        "degree", degrees.match_degree(F.col("degree")).alias("m"), degrees.degree_supported(F.col("degree")).alias("s")).collect()}
    assert got == want


def test_needles_are_filed_under_trigrams_of_their_words(spark):
    """degree_keyword_index: trigrams across words are in most texts, so they are taken only without another."""
    needles = spark.createDataFrame([("red bolt",), ("old bolt",), ("a b c",)], "needle string")
    filed = {r.needle: r.gram for r in indexed(needles, "needle", []).collect()}
    assert filed.pop("a b c") in ("a b", " b ", "b c") and not any(" " in gram for gram in filed.values())


def test_texts_give_out_few_trigrams(spark):
    """degree_keyword_index: the filter of 128 KB is no column of the rows, and not every trigram of a text is made."""
    texts = spark.createDataFrame([(1, "old bolts, красный болт"), (2, "none of it")], "i int, text string")
    frame = with_contained(texts, F.col("text"), spark.createDataFrame([("old bolt",)], "needle string"), "needle")
    assert {r.i: r.found for r in frame.collect()} == {1: ["old bolt"], 2: []}
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" not in plan and "regexp_extract_all(_text" in plan and ", scalar-subquery" in plan


def test_signs_of_patterns_are_plain_characters(spark):
    signs = ["]^-", "[&&", "\\d\\", "a-z", "\x00\x01\x7f", "🙂a🙂", "ÿĀ ", "$1{", "|)("]
    texts = [(i, "x" + s + "y" + signs[i - 1]) for i, s in enumerate(signs)] + [(90, "abz dd a9z 11"), (91, "\x02\x00\x01")]
    frame = with_contained(spark.createDataFrame(texts, "i int, text string"), F.col("text"),
                           spark.createDataFrame([(s,) for s in signs], "needle string"), "needle")
    assert {r.i: sorted(r.found) for r in frame.collect()} == {i: sorted(s for s in signs if s in t) for i, t in texts}
