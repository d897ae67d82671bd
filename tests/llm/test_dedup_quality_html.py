"""Exact copies, quality and main text: small cases, plain Python, held-out accuracy."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from meritlake.llm.exact_dedup import drop_copies, mark_copies
from meritlake.llm.main_text import extract_main_text, main_text
from meritlake.llm.quality import PLACES, Leader, features, score, train
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


def test_exact_dedup_against_sql(spark):
    frame = entry_points.queries()["op9_exact_dedup"](spark, FOLDER)
    assert difference(frame, connect(FOLDER), entry_points.oracle_sql()["op9_exact_dedup"]) is None


def test_copies_of_odd_rows(spark):
    texts = ["a b", "ab", " a\tb\n", "a b", "", None, " \x0b\x0c\r", "é", "é", "x" * 100_000, "x" * 99_999 + " x", "🙂🙂", "🙂 🙂"]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "ab", "k", 1), (2, " a\tb\n", "k", 1), (None, "z", "k", 1), (None, "z", "k", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, sha long")
    out = mark_copies(frame).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d is None, d))
    assert len(out) == len(rows)
    kept = defaultdict(int)
    for r in out:
        norm = re.sub("[\x20\x09-\x0d]", "", r.text or "")
        best = min(groups[norm], key=lambda g: (g[0], g[1], g[2] or 0))
        assert (r.keep_id, r.group_size) == (best[2], len(groups[norm]))
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
        assert not r.kept or r.doc_id == best[2]
        kept[norm] += r.kept
    assert set(kept.values()) == {1}
    assert set(mark_copies(frame).columns) == {"doc_id", "text", "sha", "keep_id", "group_size", "kept", "text_sha256"}
    assert drop_copies(frame).columns == frame.columns and drop_copies(frame).count() == len(groups)
    assert mark_copies(frame.filter("false")).count() == 0


def test_no_python_on_the_path(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = mark_copies(docs.select("doc_id", "text"), carry=["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in entry_points.queries()["op5_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and len(held) > 500
    assert np.mean([r.predicted == q for r, q in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_of_odd_rows(spark):
    texts = ["good calm words here", "BAD!! BAD!!", "", None, "word " * 50_000, "ok"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "x", "s"), (0, texts[0], "s")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (2, None), (None, 1), (9, 1), (3, 7)], "doc_id long, quality int")
    model = train(docs, labels, label="quality")
    assert len(model) == PLACES + 1
    out = {r.text: r.score for r in score(docs, model).collect()}
    assert out["good calm words here"] > out["BAD!! BAD!!"] and out[""] == out[None]
    assert not train(docs, labels.filter("false"), label="quality").any()
    assert {r.score for r in score(docs, np.zeros(PLACES + 1)).collect()} == {0.5}
    assert score(docs.filter("false"), model).count() == 0


def test_follow_the_leader_matches_its_formula():
    leader, z, n = Leader(4, 0.5, 1.0, 0.1, 0.2), np.zeros(5), np.zeros(5)
    rng = np.random.default_rng(1)
    for _ in range(50):
        where, values, label = rng.choice(5, 3, replace=False), rng.standard_normal(3), int(rng.integers(2))
        w = np.array([0.0 if abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * 0.1) / ((1 + n[i] ** 0.5) / 0.5 + 0.2) for i in where])
        p = 1 / (1 + np.exp(-(w @ values)))
        for i, v, wi in zip(where, values, w):
            g = (p - label) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * wi
            n[i] += g * g
        leader.learn(where, values, label)
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)


def test_features():
    where, values = features("a b a b")
    assert len(where) == 4 and (np.diff(where) > 0).all() and np.isclose((values ** 2).sum(), 1)
    assert len(features("")[0]) == len(features(None)[0]) == len(features(" \n")[0]) == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, ok?</div>
%s
<div id="comments"><p>First, I liked it, a lot, really, it was good.</p></div><form><p>Mail, please</p></form>
<aside>Related, more</aside><script>var a = "</p>";</script><!-- <p>no</p> --><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("body, expected", [
    ("<article><h1>Head &amp; line</h1><p>One,  two\n three.<p>Fo&#252;r <b>bold</b><br>five</article>", "Head & line\n\nOne, two three.\n\nFoür bold five"),
    ("<div class='post'><h2>H</h2><p>One, two, three, a longer text of the page.</p><ul><li>first<li>second</ul></div>",
     "H\n\nOne, two, three, a longer text of the page.\n\nfirst\n\nsecond"),
    ("<main><section><p>A, b, c.</p></section><section><p>D.</p></section></main>", "A, b, c.\n\nD."),
    ("<article><p>Text, with <a href=x>link</a>.</p><div class='share'>Share</div><table><tr><td>c1<td>c2</table></article>",
     "Text, with link.\n\nc1\n\nc2"),
    ("<article>bare text <p>then &lt;p&gt; a paragraph</article>", "bare text\n\nthen <p> a paragraph"),
    ("", "")])
def test_main_text(body, expected):
    assert main_text(PAGE % body) == expected


def test_links_discount_a_container():
    links = "".join(f"<p><a href={i}>Some long link text, with commas, number {i}, and more of it, again</a></p>" for i in range(30))
    text = "".join(f"<p>Running text, number {i}, that is long enough to count, and has no link.</p>" for i in range(6))
    assert main_text(f"<body><div>{links}</div><div>{text}</div></body>").startswith("Running text, number 0")


def test_odd_pages(spark):
    pages = [(1, None, "t"), (2, "", "t"), (3, "no markup, just text", "t"), (4, "<p>open <b>bold", "t"), (5, "<" * 2000, "t"),
             (6, "<div>" * 3000 + "deep" + "</div>" * 3000, "t"), (7, "<article><p>" + "long, " * 200_000 + "</article>", "t"), (7, "", "t")]
    frame = spark.createDataFrame(pages, "page_id long, html string, text string")
    got = extract_main_text(frame)
    assert got.columns == ["page_id", "text", "n_chars"]
    rows = sorted(got.collect(), key=lambda r: (r.page_id, r.n_chars))
    assert [r.text[:20] for r in rows[:5]] == ["", "", "no markup, just text", "open bold", "<" * 20]
    assert rows[5].text == "deep" and rows[6].n_chars == 0 and rows[7].n_chars == 1_199_999
    assert extract_main_text(frame.filter("false")).count() == 0


def test_every_page_of_the_table(spark):
    """The pages' articles have only h1, p, b and br: cutting at their tags is a full comparison."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in entry_points.queries()["op3_main_text"](spark, "/root/testdata/sf0.01").collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " ")))).strip()
                 for p in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame(
        [(900_001, None, None, None, None), (900_002, "", "en", "s", 0), (None, "A calm text of some words, for no one.", "en", "s", 38)],
        docs.schema)
    docs, counts = docs.union(extra), []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] == counts[3] > 300
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "personal_data", "packing"]
    packed = P.STAGES[-1][1](spark, docs, "/root/testdata/sf0.01")
    assert packed.select("doc_id").distinct().count() == counts[3]
    assert packed.groupBy("sequence_id").count().filter("count > 1").count() == 0
    assert P.STAGES[1][1](spark, docs.filter(F.lit(False)), "/root/testdata/sf0.01").count() == 0


LONG = "<p>Running text, of some length, that a reader came for, and that has no link in it.</p>" * 3


@pytest.mark.parametrize("name", [
    "content-sidebar-wrap", "content no-sidebar", "site has-header", "elementor-widget elementor-widget-text-editor",
    "post legal", "widget", "site-header", "comments"])
def test_names_do_not_remove_an_article(name):
    text = main_text(PAGE.replace(' id="comments"', "") % f"<div class='{name}'>{LONG}</div>")
    assert text.count("Running text") == 3
    assert main_text(PAGE % f"<div id='{name}'><article><h1>Head</h1><p>Text.</p></article></div>") == "Head\n\nText."
    inside = main_text(PAGE % f"<article><p>Short.</p><div class='{name}'>{LONG}</div></article>")
    assert inside.count("Running text") == 3 and inside.startswith("Short.")


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "sidebar-left", "widget", "cookie-notice", "comments", "comment-list", "nav menu"])
def test_named_blocks_without_much_text_are_removed(name):
    body = f"<article>{LONG}<div class='box {name}'><p>Something else.</p></div></article>"
    assert "Something" not in main_text(PAGE % body)


def test_comments_that_are_articles_stay_out():
    comments = "".join(f"<article class='comment-body'><p>I say, number {i}.</p></article>" for i in range(3))
    assert "I say" not in main_text(f"<body><div>{LONG * 3}</div><div class='comments'>{comments}</div></body>")


@pytest.mark.parametrize("beside, text", [
    ("<h1>Head</h1>", "Head"), ("<section><h2>More</h2>short</section>", "More\n\nshort"), ("<ul><li>one<li>two</ul>", "one\n\ntwo"),
    ("<pre>x = 1</pre>", "x = 1"), ("<blockquote>said</blockquote>", "said")])
def test_short_blocks_beside_the_body_stay(beside, text):
    linked = "<ul><li><a href='/a'>Other page</a></ul><h3><a href='/b'>Next</a></h3>"
    got = main_text(f"<body>{beside}<div>{LONG * 4}</div>{linked}</body>")
    assert got.startswith(text + "\n\nRunning text") and got.count("Running text") == 12
    assert "Other page" not in got and "Next" not in got


def test_quotes_open_after_an_equals_sign_only():
    assert main_text(PAGE % "<article><p>One <img src=a alt=it's> two. It's three.</p></article>") == "One two. It's three."
    assert main_text(PAGE % """<article><p title='a > "b' data-x="it's">Said <a href=x"y>link</a> so.</p></article>""") == "Said link so."
    assert "<" not in main_text("<body><article><p>Text that is here <a href=\"x>link</a></p><p>More of it.</p></article></body>")
    assert main_text("<article><p>Text here.</p><p class='x") == "Text here."
    # many quoted values in a tag that does not end cost no more than their length
    assert main_text("<article><p>Text here.</p><p " + 'a="b" ' * 3000) == "Text here."


@pytest.mark.parametrize("place", ["<article>%s%s</article>", "<div>%s</div>%s", "<main><section>%s</section>%s</main>"])
@pytest.mark.parametrize("name", ["comments", "comment-list", "replies", "disqus_thread respond"])
def test_long_comments_are_not_the_article(place, name):
    article = "<p>The article has two sentences, as it happens.</p><p>This is the second one of them.</p>"
    comments = f"<div id='{name.split()[0]}' class='{name}'>" + "<p>I have, as always, a lot more to say about that, really.</p>" * 10 + "</div>"
    text = main_text(f"<html><body>{place % (article, comments)}</body></html>")
    assert text == "The article has two sentences, as it happens.\n\nThis is the second one of them."
