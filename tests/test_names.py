import pytest

from meritlake.functions import names as N
from meritlake.operators.identity import reject_on_name_mismatch, validate_student_names

CASES = [
    ("John", "Doe", "John Doe", "match", 1.0),
    ("John", "Doe", "Doe, John", "match", 0.95),
    ("John", "Doe", "Mr. John Michael Doe", "match", 0.9),
    ("John", "Doe", "J. Doe", "partial_match", 0.6),
    ("John", "Doe", "Jane Smith", "mismatch", 1.0),
    ("Mäkelä", "Åke", "makela AKE", "match", 1.0),
    ("John", "Doe", "Unknown Employee", "unknown", 0.0),
    ("John", "Doe", None, "unknown", 0.0),
    (None, "", "John Doe", "unknown", 0.0),
    (None, "Doe", "Jane Smith", "partial_match", 0.6),  # '' is contained in every name
    ("Marika", "Virtanen", "Marita Virtamen", "partial_match", 13 / 15),
    ("Anna", "Korho", "Anno Kirbe", "mismatch", 0.4),  # 6 of 10 places agree
]


def test_name_verdicts(spark):
    frame = spark.createDataFrame([(i, *case[:3]) for i, case in enumerate(CASES)],
                                  "i int, f string, l string, x string")
    rows = N.with_name_match(frame, "f", "l", "x").orderBy("i").collect()
    for row, case in zip(rows, CASES):
        assert (row.match_result, pytest.approx(row.match_confidence, abs=1e-9)) == (case[3], case[4]), case


def test_explanations(spark):
    frame = spark.createDataFrame([("Marika", "Virtanen", "Marita Virtamen")], "f string, l string, x string")
    text = N.with_name_match(frame, "f", "l", "x").first().match_explanation
    assert text == "Similar names: 'Marita Virtamen' is 87% similar to 'Marika Virtanen'"


def test_small_functions(values):
    assert values(N.name_from_email, ["anna-mary.o'neil@x.fi", "JOHN.DOE@x"]) == ["Anna-Mary O'Neil", "John Doe"]
    assert values(lambda x: N.full_name(x, x), [" a ", "", None]) == ["a a", "Unknown", "Unknown"]
    assert values(lambda x: N.student_email_ok(x, "st.example.org"), [
        "a.b@st.example.org", "a b@st.example.org", "a@stxexample.org", None]) == [True, False, False, False]


def test_validation_and_rejection(spark):
    students = spark.createDataFrame([(1, "John", "Doe")], "student_id int, first_name string, last_name string")
    certificates = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (13, 99)], "certificate_id int, student_id int")
    extractions = spark.createDataFrame(
        [(10, "John Doe"), (11, "Jane Smith"), (12, None), (13, "Any Body")], "certificate_id int, employee_name string")
    checked = validate_student_names(extractions, certificates, students)
    got = {r.certificate_id: (r.match_result, r.name_match, r.db_student_full_name) for r in checked.collect()}
    assert got == {10: ("match", True, "John Doe"), 11: ("mismatch", False, "John Doe"),
                   12: ("unknown", False, "John Doe"), 13: ("unknown", True, "Unknown")}
    passed, rejected = reject_on_name_mismatch(checked)
    assert sorted(r.certificate_id for r in passed.collect()) == [10, 13]
    assert {(r.certificate_id, r.decision, r.credits_qualified) for r in rejected.collect()} == {
        (11, "REJECTED", 0.0), (12, "REJECTED", 0.0)}
