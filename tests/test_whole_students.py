"""Texts go round the whole student table: held against the SQL with the counted number of students in place of 150."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.01"
ROUND, WHOLE = "doc_id % 150", "doc_id % (SELECT count(*) FROM students)"


@pytest.mark.parametrize("name", ["evaluate_texts", "evaluate_with_model"])
def test_every_student_takes_part(name, spark):
    sql = entry_points.oracle_sql()[name].replace(ROUND, WHOLE)
    assert WHOLE in sql
    assert difference(entry_points.queries()[name](spark, FOLDER), connect(FOLDER), sql) is None
