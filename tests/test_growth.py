"""What a task reads, moves and holds as tables grow."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from meritlake.functions.text import input_problem, sanitize_text
from meritlake.operators import applications as A
from meritlake.operators.degrees import degree_keyword_score
from meritlake.plans import catalog_rules
from meritlake.plans.driver_views import Tables
from meritlake.sources import calls, tables

FOLDER = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    """check_extraction: narrow rows, many to a split."""
    monkeypatch.setattr(tables, "ROWS_OF_A_TASK", 100)
    scan = spark.read.parquet(f"{FOLDER}/orders.parquet")
    spread = tables.spread_few_splits(scan)
    assert spread.rdd.getNumPartitions() == 15 and spread.count() == scan.count() == 1500


def test_problems_and_repairs_are_looked_for_once(spark):
    """check_extraction: one line of the plan has the rules, none has them twice."""
    lines = _plan(entry_points.queries()["check_extraction"](spark, FOLDER))
    assert lines.count("variant_get(") <= 30 and lines.count("regexp_replace(") == 2


def test_moved_rows_of_detailed_application(spark):
    """detailed_application: joined rows are not moved to the students and back."""
    t = Tables(spark, FOLDER)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in off}
    try:
        for name, value in off.items():
            spark.conf.set(name, value)
        bare = spark.createDataFrame([], "certificate_id long, document_id string, document_type string, filename string, "
                                         "filetype string, uploaded_at timestamp")
        rows = A.detailed_application(t.certificates.select("certificate_id"), t.certificates, t.students, bare)
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 5
        assert rows.columns == ["certificate_id", "student_id", "decision", "certificate", "student", "additional_documents"]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_workers_hold_few_answers(spark):
    """map_with_caller: a batch of Arrow rows is answered in pieces."""
    def whole():
        import sys

        def call(value):
            frame = sys._getframe(1)
            while frame and "values" not in frame.f_locals:
                frame = frame.f_back
            return str(len(frame.f_locals["values"]))
        return call

    rows = calls.map_with_caller(spark.range(1000).coalesce(1).withColumn("v", F.lit("x")), "v", ["id"], [("c", whole)]).collect()
    assert [r.id for r in rows] == list(range(1000)) and all(r.success for r in rows)
    assert max(int(r.answer) for r in rows) <= 256


def test_names_are_compared_in_one_pass(spark):
    """reject_on_name_mismatch: passed and rejected rows do not each compare all names."""
    plan = _plan(entry_points.queries()["reject_on_name_mismatch"](spark, FOLDER))
    assert "Union" not in plan and plan.count("Join") <= 3


def test_drops_have_as_many_files_as_their_rows_need(spark):
    """stream_status: a drop is not written by one task, whatever its size."""
    t = Tables(spark, FOLDER)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "2000b")
    try:
        table = t.certificates.repartition(8)
        folders = []
        keep = catalog_rules.read_arrivals
        catalog_rules.read_arrivals = lambda _s, _schema, path, files_per_batch: folders.append((path, files_per_batch))
        catalog_rules._dropped(t, table, 2)
    finally:
        catalog_rules.read_arrivals = keep
        spark.conf.set(size, before)
    folder, at_a_time = folders[0]
    files = [f for _, _, names in os.walk(folder.removesuffix("/*")) for f in names if f.endswith(".parquet")]
    assert len(files) > 2 and at_a_time == len(files)
    assert spark.read.parquet(folder).count() == 1500


def test_dates_of_a_position_are_read_once(spark):
    """extraction_warnings: one parse for a start, one for an end."""
    plan = _plan(entry_points.queries()["extraction_warnings"](spark, FOLDER))
    assert plan.count("(?!0000)") == 2


def test_long_texts_are_read_few_times(spark):
    """evaluate_texts: date ranges are looked for once, keywords by their longest words."""
    plan = _plan(entry_points.queries()["evaluate_texts"](spark, FOLDER))
    assert plan.count("regexp_extract_all(") == 2 and "_shelves" in plan and "translate(replace(" not in plan


def test_keywords_by_their_longest_words(spark):
    """evaluate_texts, degree_keyword_score: odd keywords and texts count as each alone would."""
    words = ["red bolt", "Red Bolt", "bolt", "", " ", "  bolt", "big  red", "ä ö", "bolt red big", None]
    texts = [None, "", " ", "RED BOLTS", "a big  red bolt", "bolt red", "x ä ö", "the bolt red bigger  bolt"]
    catalogue = spark.createDataFrame([("p", words[:6], words[6:]), ("none", [], [])], "programme_key string, industries array<string>, roles array<string>")
    rows = spark.createDataFrame([(i, k, t) for i, t in enumerate(texts) for k in ("p", "none", "unknown")], "i int, programme_key string, text string")
    got = {(r.i, r.programme_key): r.keyword_hits for r in degree_keyword_score(rows, catalogue).collect()}
    each = {w.lower() for w in words if w is not None}
    assert got == {(i, k): sum(w in (t or "").lower() for w in each) if k == "p" and t is not None else 0
                   for i, t in enumerate(texts) for k in ("p", "none", "unknown")}


def test_whole_texts_keep_their_words(spark, values):
    """evaluate_texts: runs of spaces, line ends and odd white space, without a limit."""
    texts = ["a  b   c d", "a\r\rb\r\n\r\n  c", " \x85 a 　\n\x0c", "   ", "", None, "\x00x\x7f  \x01 y", "one\rtwo"]
    assert values(lambda t: sanitize_text(t, limit=None), texts) == [
        "a b c d", "a\nb\nc", "a", "", "", "", "x y", "one\ntwo"]
    assert values(input_problem, ["　 {a: 12345678}", " " * 12, "a" + " " * 12, "short", "  \"quoted text\""]) == [
        "Text appears to be JSON, not document content", "Text too short or empty", None, "Text too short or empty",
        "Text appears to be JSON, not document content"]
