import datetime as dt

import pytest
from pyspark.sql import functions as F

from meritlake.operators import degrees, intake, lookups, ordered, state
from meritlake.operators import statistics as S
from meritlake.sources.keyed_store import KeyedStore

DECISIONS = ("decision_id string, certificate_id int, student_comment string, reviewer_id int, "
             "reviewer_decision string, reviewer_comment string, reviewed_at timestamp")
ACTIONS = ("certificate_id int, action_id int, action_at timestamp, student_comment string, reviewer_id int, "
           "reviewer_decision string, reviewer_comment string")


def at(day):
    return dt.datetime(2024, 1, day)


@pytest.fixture(scope="module")
def decisions(spark):
    return spark.createDataFrame([("d1", 1, None, None, None, None, None), ("d2", 2, "old", 5, None, None, None),
                                  ("d3", 3, None, None, None, None, None)], DECISIONS)


def actions(spark, *rows):
    return spark.createDataFrame(list(rows), ACTIONS)


def test_reviews(spark, decisions):
    acts = actions(spark, (1, 1, at(1), "c", None, "pass", "first"), (1, 2, at(2), None, None, "FAIL", "second"),
                   (1, 3, at(3), None, None, "MAYBE", "third"), (9, 4, at(1), None, None, "PASS", None))
    got = {r.certificate_id: (r.reviewer_decision, r.reviewer_comment, r.student_comment)
           for r in state.apply_reviews(decisions, acts).collect()}
    assert got == {1: ("FAIL", "second", "c"), 2: (None, None, "old"), 3: (None, None, None)}
    bad = {r.action_id: r.reason for r in state.rejected_reviews(decisions, acts).collect()}
    assert bad == {3: state.BAD_REVIEW, 4: state.NOT_FOUND}


def test_first_comment_and_appeal(spark, decisions):
    acts = actions(spark, (1, 1, at(2), "late", 7, None, None), (1, 2, at(1), "early", None, None, None),
                   (2, 3, at(1), "no", None, None, None), (9, 4, at(1), "lost", None, None, None))
    got = {r.certificate_id: r.student_comment for r in state.apply_first_comment(decisions, acts).collect()}
    assert got == {1: "early", 2: "old", 3: None}
    outcomes = {r.action_id: r.outcome for r in state.comment_outcomes(decisions, acts).collect()}
    assert outcomes == {1: state.COMMENT_EXISTS, 2: "accepted", 3: state.COMMENT_EXISTS, 4: state.NOT_FOUND}
    reviewers = spark.createDataFrame([(8, None, "A"), (9, "Zoe", None), (7, "Zoe", "B")],
                                      "reviewer_id int, first_name string, last_name string")
    appealed = {r.certificate_id: (r.student_comment, r.reviewer_id)
                for r in state.apply_appeals(decisions, acts, reviewers).collect()}
    assert appealed[1] == ("early", 7) and appealed[2] == ("old", 5)
    nobody = reviewers.where("false")
    assert {r.certificate_id: r.reviewer_id for r in state.apply_appeals(decisions, acts, nobody).collect()}[1] is None
    assert {r.action_id: r.outcome for r in state.appeal_outcomes(decisions, acts, nobody).collect()}[2] == state.NO_REVIEWERS


def test_feedback_and_approval(spark, decisions):
    acts = actions(spark, (2, 1, at(1), "new", 6, None, None), (2, 2, at(2), None, None, None, None))
    got = {r.certificate_id: (r.student_comment, r.reviewer_id) for r in state.apply_feedback(decisions, acts).collect()}
    assert got[2] == (None, 6) and got[1] == (None, None)
    sent = {r.certificate_id: r.reviewer_id for r in state.send_for_approval(decisions, acts).collect()}
    assert sent[2] is None


def test_best_attempt(spark):
    long = "x" * 401
    rows = [("a", 0, long), ("a", 1, "ä" * 400), ("b", 0, "x" * 400), ("b", 1, "ä" * 50), ("c", 0, "ab"), ("c", 1, "cd"),
            ("d", 0, ""), ("d", 1, "z")]
    got = {r.k: r.attempt for r in ordered.best_text_attempt(
        spark.createDataFrame(rows, "k string, attempt int, text string"), "k").collect()}
    assert got == {"a": 0, "b": 1, "c": 0, "d": 1}


def test_degrees(spark, values):
    out = values(degrees.match_degree, ["BACHELOR OF HEALTH CARE, NURSING", "Medianomi (AMK)!", "katilo_amk", "Business",
                                        "Unknown Degree", "", None])
    assert out == ["bachelor_of_health_care_nursing", "medianomi_amk", "katilo_amk",
                   "bachelor_of_business_administration_international_business", "general",
                   "bachelor_of_engineering_information_technology", "general"]
    assert values(degrees.degree_supported, ["Business", "medianomi amk", "Medianomi (AMK)!", "Invalid Degree"]) == [
        True, True, False, False]


def test_pages_do_not_overlap(spark):
    frame = spark.range(250).select(F.concat(F.lit("d"), "id").alias("decision_id"),
                                    F.lit(dt.datetime(2020, 1, 1)).alias("created_at"))
    seen = [r.decision_id for skip in (0, 100, 200) for r in lookups.decisions_page(frame, skip, 100).collect()]
    assert len(seen) == len(set(seen)) == 250


def test_null_time_comes_first_in_newest_first(spark):
    frame = spark.createDataFrame([("a", at(1)), ("b", None), ("c", at(2))], "decision_id string, created_at timestamp")
    assert [r.decision_id for r in lookups.decisions_page(frame).collect()] == ["b", "c", "a"]


def test_uploads(spark):
    limit = 10 * 1024 * 1024
    rows = [("general", "regular", "a.PDF", 10, None), ("x", "REGULAR", "a.pdf", 10, "Invalid training type"),
            ("GENERAL", "odd", "a.pdf", 10, "Invalid work type"), ("GENERAL", "REGULAR", None, 10, "No filename provided"),
            ("GENERAL", "REGULAR", "a", 10, "File must have an extension"),
            ("GENERAL", "REGULAR", "a.exe", 10, "File type exe not supported"), ("GENERAL", "REGULAR", "a.doc", limit, None),
            ("GENERAL", "REGULAR", "a.doc", limit + 1, "File size too large. Maximum size is 10MB."),
            ("GENERAL", "REGULAR", "a.doc", 0, "File is empty")]
    frame = spark.createDataFrame(rows, "training_type string, work_type string, filename string, size long, want string")
    assert all(r.reject_reason == r.want for r in intake.admit_uploads(frame).collect())


def test_append_refuses_bad_rows_and_repeats_ids(spark, tmp_path):
    frame = spark.createDataFrame([("a.pdf", "GENERAL"), ("b.pdf", "WRONG")], "filename string, training_type string")
    store = KeyedStore(spark, str(tmp_path / "t"), "record_id",
                       "record_id string, filename string, training_type string, uploaded_at timestamp")
    for _ in range(2):
        refused = intake.append_records(frame, store, ["filename"], "uploaded_at")
    assert [(r.filename, r.problems) for r in refused.collect()] == [("b.pdf", ["training_type: not in domain"])]
    rows = store.read().collect()
    assert [r.filename for r in rows] == ["a.pdf"] and rows[0].uploaded_at is not None


def test_seed_takes_one_row_per_key(spark):
    old = spark.createDataFrame([("a", "old")], "email string, degree string")
    new = spark.createDataFrame([("a", "x"), ("b", "2"), ("b", "1")], "email string, degree string")
    assert sorted(map(tuple, intake.seed_if_absent(old, new).collect())) == [("a", "old"), ("b", "1")]


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], "file_path string, file_name string, success boolean, error string, text_length int, "
                                  "finnish_chars_count int, detected_language string")
    row = S.batch_summary(empty).first()
    assert (row.total_files, row.success_rate, row.average_characters) == (0, 0.0, 0.0)
    assert {r.section: r.n for r in S.finnish_summary(empty).collect()} == {"finnish_documents": 0, "finnish_characters": 0}


def test_half_even_rounding(spark):
    frame = spark.createDataFrame([("p", "n", i < 1, None, t, 0, "eng") for i, t in enumerate([0, 1, 0, 0])],
                                  "file_path string, file_name string, success boolean, error string, text_length int, "
                                  "finnish_chars_count int, detected_language string")
    row = S.batch_summary(frame).first()
    assert (row.success_rate, row.average_characters) == (25.0, 0.2)


def test_employer_consistency(spark):
    rows = [(1, "A"), (1, None), (2, "A"), (2, "B"), (2, None), (3, None), (3, None), (4, "A"), (5, "A"), (5, ""), (5, "B")]
    got = {r.certificate_id: r.inconsistent for r in S.employer_consistency(
        spark.createDataFrame(rows, "certificate_id int, employer string")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_figures_gathered_while_writing(spark, tmp_path):
    rows = [("a@b.c", "x" * 300, "GENERAL"), (None, "", "GENERAL"), ("d@e.f", None, "OTHER")]
    frame = spark.createDataFrame(rows, "email string, filename string, training_type string")
    found = S.write_observed(frame, str(tmp_path / "t"), "uploads").collect()
    assert {(r.table_name, r.row_count) for r in found} == {("uploads", 3)}
    assert {r.column_name: r.n_filled for r in found if r.column_name} == {"email": 2, "filename": 2, "training_type": 3}
    assert {r.problem: r.n_broken for r in found if r.problem} == {
        "email: missing": 1, "filename: too long": 1, "filename: empty": 2, "training_type: not in domain": 1}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    counted = intake.check_constraints(frame.withColumn("id", F.lit(1)), "id").groupBy("problem").count().collect()
    assert {r.problem: r["count"] for r in counted} == {r.problem: r.n_broken for r in found if r.problem}
    assert {r.row_count for r in S.write_observed(frame.limit(0), str(tmp_path / "e"), "none").collect()} == {0}
