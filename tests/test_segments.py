"""Ordered groups of any size must give exactly what a plain loop gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meritlake.operators import applications as A
from meritlake.operators.ordered import timeline_check
from meritlake.operators.segments import arrays_in_order, with_previous
from meritlake.operators.statistics import combine_documents


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with more than a third of all rows, a null key, and many small ones."""
    random.seed(7)
    rows = [(0, random.randrange(40), i, i * 3) for i in range(700)]
    rows += [(None, random.choice([None, 1, 2]), i, i) for i in range(90)]
    rows += [(key, random.randrange(40), i, i if i % 3 else None) for key in range(1, 200) for i in range(random.randrange(1, 8))]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k int, o int, id int, v int").repartition(5)


def grouped(rows):
    def first(value):
        return (value is not None, value or 0)

    groups = {}
    for row in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def expected(rows):
    return {(r[0], r[2], r[1]): (g[i - 1][3] if i else None) for g in grouped(rows).values() for i, r in enumerate(g)}


@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_previous(spark, skewed, partitions):
    rows, frame = skewed
    names = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        got = {(r.k, r.id, r.o): r.previous_v for r in with_previous(frame, ["k"], ["o", "id"], ["v"]).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == expected(rows)


def test_nothing_runs_before_the_action(spark, skewed):
    _, frame = skewed
    spark.sparkContext.setJobGroup("segments", "")
    built = with_previous(frame, ["k"], ["o", "id"], ["v"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("segments")
    assert built.count() == frame.count()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("segments")


def test_no_rows(spark, skewed):
    assert with_previous(skewed[1].where("false"), ["k"], ["o", "id"], ["v"]).count() == 0


def test_arrays(skewed):
    rows, frame = skewed
    got = {r.k: r.ids for r in arrays_in_order(frame, ["k"], [F.col("o"), F.col("id")], F.col("id"), "ids").collect()}
    assert got == {k: [r[2] for r in g] for k, g in grouped(rows).items()}


def test_timeline(spark, skewed):
    rows, frame = skewed
    day = F.lit("2000-01-01").cast("date")
    positions = frame.select(F.col("k").alias("certificate_id"), "id", F.date_add(day, "o").alias("start_date"),
                             F.date_add(day, F.col("o") + F.col("v") % 5).alias("end_date"))
    got = {(r.certificate_id, r.id): (r.gap_days, r.overlaps, r.large_gap) for r in timeline_check(positions, ["id"], 2).collect()}
    dated = [r for r in rows if r[1] is not None]
    want = {}
    for group in grouped(dated).values():
        for i, (k, o, number, _) in enumerate(group):
            last = group[i - 1] if i else None
            end = last[1] + last[3] % 5 if last and last[3] is not None else None
            gap = None if end is None else o - end
            want[k, number] = (gap, gap is not None and gap < 0, gap is not None and gap > 2)
    assert got == want


def test_combined_text_of_a_hot_certificate(spark):
    docs = spark.createDataFrame([(1, i, "T", f"f{i}", f"text {i}") for i in range(60)] + [(2, 0, None, None, "only")],
                                 "certificate_id int, n int, document_type string, filename string, ocr_text string")
    main = spark.createDataFrame([(1, "main"), (2, "main"), (3, "main")], "certificate_id int, text string")
    rows = combine_documents(main, docs, ["n"]).collect()
    assert len(rows) == 3
    whole = "".join(r.combined_text for r in rows if r.certificate_id == 1)
    assert whole == "MAIN CERTIFICATE:\nmain\n\n" + "".join(
        f"ADDITIONAL DOCUMENT {i + 1} (T - f{i}):\ntext {i}\n\n" for i in range(60))
    assert [r.combined_text for r in rows if r.certificate_id == 2] == [
        "MAIN CERTIFICATE:\nmain\n\nADDITIONAL DOCUMENT 1 (ADDITIONAL_DOCUMENT - document_1):\nonly\n\n"]
    assert [r.combined_text for r in rows if r.certificate_id == 3] == ["MAIN CERTIFICATE:\nmain\n\n"]


def test_hot_student_and_hot_certificate(spark):
    """One student holds most certificates, one of them most documents; each is one row."""
    students = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "student_id int, email string")
    start = dt.datetime(2020, 1, 1)
    certificates = spark.createDataFrame(
        [(i, 1 if i % 10 else 2, "GENERAL", "SELF_PACED", f"f{i}", None if i == 7 else start + dt.timedelta(days=i % 17))
         for i in range(200)],
        "certificate_id int, student_id int, training_type string, work_type string, filename string, uploaded_at timestamp")
    rows = {r.student_id: [c.certificate_id for c in r.certificates] for r in A.student_with_certificates(students, certificates).collect()}
    far = start + dt.timedelta(days=999)
    for student in (1, 2, 3):
        own = [r for r in certificates.collect() if r.student_id == student]
        assert rows[student] == [r.certificate_id for r in sorted(own, key=lambda r: (far - (r.uploaded_at or far), r.certificate_id))]
    for one in ({"student_id": 2}, {"email": "b"}):
        got = A.student_with_certificates(students, certificates, **one).collect()
        assert [(r.student_id, [c.certificate_id for c in r.certificates]) for r in got] == [(2, rows[2])]
    assert A.student_with_certificates(students, certificates, email="nobody").count() == 0

    documents = spark.createDataFrame(
        [(f"d{i:03}", 5 if i % 4 else 6, "HOUR_DOCUMENTATION", "n", "pdf", start) for i in range(160)],
        "document_id string, certificate_id int, document_type string, filename string, filetype string, uploaded_at timestamp")
    arrays = {r.certificate_id: [d.document_id for d in r.additional_documents] for r in A.document_arrays(documents).collect()}
    assert arrays == {c: [f"d{i:03}" for i in range(160) if (5 if i % 4 else 6) == c] for c in (5, 6)}
