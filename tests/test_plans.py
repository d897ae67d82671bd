"""What the plans must and must not contain."""

import pytest

from meritlake.plans import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries.queries()
PYTHON = {"map_with_caller", "process_documents"}
WRITES = {"evaluate_with_model", "append_records", "write_decision_records", "stream_evaluate", "stream_status",
          "store_reviews", "store_deletes", "decisions_page_ranked", "clustered_lookups", "pending_applications_bucketed",
          "write_observed", "scan_document_inventory", "scan_text_documents", "scan_entity_tables", "map_with_answers"}


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_python_and_no_cartesian(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "Python" not in text and "InPandas" not in text


def test_lookup_filter_reaches_the_files(spark):
    text = plan(spark, "certificate_by_id")
    assert "EqualTo(o_orderkey,12)" in text.replace(" ", "")


def test_employment_totals_reads_only_what_it_needs(spark):
    text = plan(spark, "employment_totals")
    assert "l_extendedprice" not in text and "p_retailprice" not in text


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    from meritlake.sources.sorted_files import write_bucketed

    left = write_bucketed(spark.range(5000).selectExpr("id AS k", "id * 2 AS v"), "left_rows", str(tmp_path / "l"), "k", 8)
    right = write_bucketed(spark.range(0, 9000, 3).selectExpr("id AS k", "'x' AS w"), "right_rows", str(tmp_path / "r"), "k", 8)
    joined = left.hint("merge").join(right, "k")
    assert joined.count() == len(range(0, 5000, 3))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert not [r for r in spark.sql("SHOW TABLES").collect() if "_rows" in r.tableName]
