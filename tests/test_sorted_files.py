"""Pages and look-ups on sorted files: the rows of the plain way, from few files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meritlake.operators import lookups
from meritlake.operators.segments import newest_first
from meritlake.sources.sorted_files import read_page, write_clustered, write_ranked


@pytest.fixture(scope="module")
def ranked(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(f"D{i:05}", None if i % 40 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(900)), i) for i in range(6000)]
    frame = spark.createDataFrame(rows, "decision_id string, created_at timestamp, n int").repartition(7)
    path, order = str(tmp_path_factory.mktemp("ranked") / "t"), {"newest": newest_first("created_at"), "by_id": F.col("decision_id")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_ranked(frame, path, order, step=50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    far = dt.datetime(3000, 1, 1)
    return path, frame.schema, sorted(rows, key=lambda r: (r[1] is not None, (far - r[1]) if r[1] else far - far, r[0]))


@pytest.mark.parametrize("skip, limit", [(0, 10), (0, 0), (49, 3), (50, 50), (149, 1), (3000, 100), (2999, 777), (5990, 100), (6000, 5), (9999, 5)])
def test_pages(spark, ranked, skip, limit):
    path, schema, rows = ranked
    page = read_page(spark, path, schema, ["newest", "by_id"], skip, limit, step=50)
    assert page.columns == ["decision_id", "created_at", "n"]
    assert [r.n for r in page.collect()] == [r[2] for r in rows[skip:skip + limit]]


def test_late_pages_read_no_more_files(spark, ranked):
    path, schema, _ = ranked
    total = len(spark.read.parquet(f"{path}/rows").inputFiles())
    files = []
    for skip in (0, 2000, 4000, 5900):
        page = read_page(spark, path, schema, ["newest", "by_id"], skip, 20, step=50)
        page.collect()
        files.append(scanned(page, "numFiles"))
    assert total >= 8 and max(files) <= 2


def scanned(frame, metric):
    """A metric of the scan that ran."""
    def scan(plan):
        if plan.nodeName().startswith("Scan parquet"):
            return plan
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return scan(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return scan(plan.plan())
        children = plan.children()
        return next((s for i in range(children.size()) if (s := scan(children.apply(i)))), None)

    return scan(frame._jdf.queryExecution().executedPlan()).metrics().apply(metric).value()


def test_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "decision_id string, created_at timestamp")
    write_ranked(frame, str(tmp_path / "t"), {"by_id": F.col("decision_id")})
    page = read_page(spark, str(tmp_path / "t"), frame.schema, ["by_id"], 0, 10)
    assert page.columns == frame.columns and page.count() == 0


def test_lookups_read_few_row_groups(spark, tmp_path):
    total = 400_000
    frame = spark.range(total).selectExpr(
        "id AS student_id", "concat('s', hash(id * 7), '.', id, '@x.org') AS email", "repeat(md5(string(id)), 3) AS filler")
    path = str(tmp_path / "t")
    write_clustered(frame.repartition(8), path, "student_id", ("email",), distinct=60_000, row_group_bytes=1 << 20)
    stored = spark.read.parquet(path)
    email = frame.where("student_id = 123456").first().email
    for found in (lookups.student_by_email(stored, email), lookups.student_by_id(stored, 123456)):
        assert [r.student_id for r in found.collect()] == [123456]
        assert scanned(found, "numOutputRows") <= total / 20
    assert lookups.student_by_email(stored, "nobody@x.org").count() == 0
