import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from meritlake.llm.neighbours import nearest
from meritlake.llm.url_templates import Rule, grow_templates, judge_urls, url_host, url_path

RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def brute(rows, asks, most=20):
    clean = [(i, np.array(v, float)) for i, v in rows
             if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v))]
    found = {}
    for q, v in clean:
        if asks(q):
            best = {}
            for i, w in clean:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((w * v).sum()))
            found[q] = [i for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most]]
    return found


def test_nearest_on_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(60)]
    rows += [(60, [0.0] * 4), (61, None), (62, [1.0, None, 0.0, 0.0]), (63, [float("nan")] * 4), (64, [float("inf"), 0.0, 0.0, 0.0]),
             (65, []), (None, [1.0] * 4), (3, rows[3][1]), (66, rows[40][1])]
    frame = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = nearest(frame, F.col("vec_id") % 20 == 0).collect()
    expected = brute(rows, lambda q: q % 20 == 0)
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(by_query[r.query_id])
    assert by_query == expected


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert nearest(frame.filter("false"), F.col("vec_id") == 0).count() == 0
    assert nearest(frame, F.col("vec_id") == 9).count() == 0


def test_equal_vectors_in_blocks(spark):
    frame = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(1.0)).alias("embedding"))
    got = nearest(frame, F.col("vec_id") == 100, leaf_rows=10, block_rows=50, least=50, share=0.1).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0, least=400, leaf_rows=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        shares.append(len(got[ids[q]] & set(ids[np.argsort(-scores)[:20]])) / 20)
    assert np.mean(shares) >= 0.9


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("HTTP://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("x://net", "net", "", None, "allow"),
    ("x://net/", "net", "/", "net/", "block"),
    ("x://notnet.com/de/", "notnet.com", "/de/", None, "allow"),
    ("x://w.example.com/de/1", "w.example.com", "/de/1", "example.com/de/", "block"),
    ("x://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("x://É.org?q/fr/", "É.org", "", None, "allow"),
    ("l\ne://h/\np", "h", "/\np", None, "allow")])
def test_rules(spark, url, host, path, rule, verdict):
    urls = spark.createDataFrame([(1, url, "n")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "key long, label int")
    row = judge_urls(urls, labels, RULES).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in row] == [(host, path, rule, verdict)]


def test_templates_by_purity(spark):
    urls, labels = [], []
    for i in range(400):
        good = i % 2 == 0
        urls.append((i, f"http://h.com/{'good' if good else 'spam'}/item{i}/view"))
        labels.append((i, int(good)))
    urls += [(1000, "http://h.com/spam/item9999/view"), (1001, "http://h.com/good/new/view"), (None, "http://h.com/spam/item3/view"),
             (1002, "http://h.com/" + "d/" * 40), (1000, "http://h.com/spam/item9999/view")]
    out = judge_urls(spark.createDataFrame(urls, "page_id long, url string"),
                     spark.createDataFrame(labels + [(None, 1), (5, None)], "key long, label int"), RULES).collect()
    assert len(out) == len(urls)
    for r in out:
        assert r.verdict == ("block" if "/spam/" in r.path else "allow"), r
    assert {r.template for r in out if "/good/item" in r.path} == {"/good/~/view"}
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"),
                      spark.createDataFrame(labels, "key long, label int"), RULES).count() == 0


def test_many_children_become_a_wildcard(spark):
    rows = [("h", ["a", f"name-{chr(97 + i // 26)}{chr(97 + i % 26)}"], 1, 1, 1.0) for i in range(60)]
    frame = spark.createDataFrame(rows, "host string, shape array<string>, n long, labelled long, good double")
    assert {r.template for r in grow_templates(frame).collect()} == {"/a/*"}


@pytest.mark.parametrize("depth", [1, 5, 7, 30])
def test_branches_at_any_depth_are_told_apart(spark, depth):
    head = "/".join(f"s{i}" for i in range(depth))
    urls = [(i, f"http://h.com/{head}/{'good' if i % 2 else 'spam'}/item{i}") for i in range(400)]
    out = judge_urls(spark.createDataFrame(urls, "page_id long, url string"),
                     spark.createDataFrame([(i, i % 2) for i in range(400)], "key long, label int"), []).collect()
    assert len(out) == 400 and all(r.rule is None and r.verdict == ("allow" if r.page_id % 2 else "block") for r in out)


def test_clashing_columns_and_no_rules(spark):
    urls = spark.createDataFrame([(1, "x://h/a", "v", "t", 3), (None, None, None, None, None)],
                                 "page_id long, url string, verdict string, template string, key int")
    labels = spark.createDataFrame([(1, 1, "x")], "key long, label int, host string")
    out = judge_urls(urls, labels, [])
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "template"]
    assert sorted(map(repr, out.collect())) == sorted(map(repr, [
        Row(page_id=1, host="h", path="/a", rule=None, verdict="allow", template="/a"),
        Row(page_id=None, host="", path="", rule=None, verdict="allow", template="")]))


def plain_templates(shapes, most_children, similar):
    """The tree as a recursion over lists: {(host, shape): template}."""
    out = {}

    def grow(host, rows, at, template):
        branches = {}
        for row in rows:
            if len(row[1]) == at:
                out[host, tuple(row[1])] = template
            else:
                branches.setdefault(row[1][at], []).append(row)
        labelled = {s: sum(r[3] for r in b) for s, b in branches.items()}
        good = {s: sum(r[4] for r in b) for s, b in branches.items()}
        total, all_good, named = sum(labelled.values()), sum(good.values()), {}
        for segment, branch in branches.items():
            n, others = labelled[segment], total - labelled[segment]
            name = segment if len(branches) == 1 else "*" if len(branches) > most_children else "~"
            if n and others:
                pooled = all_good / total
                error = (pooled * (1 - pooled) * (1 / n + 1 / others)) ** 0.5
                if error > 0 and abs(good[segment] / n - (all_good - good[segment]) / others) > similar * error:
                    name = segment
            named.setdefault(name, []).extend(branch)
        for name, branch in named.items():
            grow(host, branch, at + 1, f"{template}/{name}")

    for host in {r[0] for r in shapes}:
        grow(host, [r for r in shapes if r[0] == host], 0, "")
    return out


def test_templates_equal_a_plain_tree(spark):
    rng = random.Random(5)
    shapes = {}
    for _ in range(700):
        host = rng.choice("hij")
        shape = tuple(rng.choice(["a", "b", f"x{rng.randrange(9)}"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 9])))
        shape = ("p", "q", "r") + shape if rng.random() < 0.3 else shape
        labelled = rng.randrange(0, 40)
        shapes[host, shape] = (host, list(shape), labelled + 1, labelled, float(rng.randint(0, labelled) if "b" in shape else labelled))
    frame = spark.createDataFrame(list(shapes.values()), "host string, shape array<string>, n long, labelled long, good double")
    for most_children, similar in ((4, 2.58), (24, 1.0)):
        got = {(r.host, tuple(r.shape)): r.template for r in grow_templates(frame, most_children, similar).collect()}
        assert got == plain_templates(list(shapes.values()), most_children, similar)
