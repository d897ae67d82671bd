import datetime as dt

from pyspark.sql import functions as F

from meritlake.functions import credits as C
from meritlake.functions import dates as D


def test_dates(values):
    given = ["2. 6. 2025", "27.11.2009", "13.2.1984", "27/11/2009", "31.2.2020", "2025-6-2", "0000-01-01",
             "2025.06.02", " 2 . 6 . 2025\n", "", None, "12.13.2020", "2.6.25"]
    assert values(D.parse_finnish_date, given) == [
        dt.date(2025, 6, 2), dt.date(2009, 11, 27), dt.date(1984, 2, 13), dt.date(2009, 11, 27), None,
        dt.date(2025, 6, 2), None, None, dt.date(2025, 6, 2), None, None, None, None]


def test_validate(spark):
    frame = spark.createDataFrame([("1.1.2020", "1.1.2019"), ("x", "2.2.2031"), (None, None), ("", "")], "a string, b string")
    rows = [r.r for r in frame.select(D.parse_and_validate_dates(
        F.col("a"), F.col("b"), F.lit("2025-01-01").cast("date")).alias("r")).collect()]
    assert rows[0].errors == ["Start date 2020-01-01 is after end date 2019-01-01"] and not rows[0].is_valid
    assert rows[1].errors == ["Could not parse start date: x"]
    assert rows[1].warnings == ["End date 2031-02-02 is in the future"]
    assert rows[2].is_valid and rows[2].errors == [] and rows[2].start_date is None
    assert rows[3].is_valid


def test_years(values):
    assert values(D.years_of, [0, 365, None], "int") == [None, 365 / 365.25, None]


def test_credits(spark):
    rows = [(320.0, "general", 11.0, 10.0), (304.0, "professional", 11.0, 11.0), (0.0, "general", 0.0, 0.0),
            (810.0, "professional", 30.0, 30.0), (837.0, "professional", 31.0, 30.0), (5000.0, "other", 185.0, 185.0),
            (-28.0, "general", -1.0, -1.0)]
    frame = spark.createDataFrame(rows, "h double, k string, base double, capped double")
    base = C.credits_from_hours(F.col("h"))
    got = frame.select("*", base.alias("b"), C.cap_credits(base, F.col("k")).alias("c"),
                       C.cap_breakdown(F.col("h").cast("int"), base, F.col("k")).alias("t")).collect()
    assert all(r.b == r.base and r.c == r.capped for r in got)
    assert got[0].t == "320 hours / 27 hours per ECTS = 11.0 credits, capped at 10.0 maximum for general training"
    assert got[1].t is None and got[5].t is None


def test_status(spark):
    rows = [(None, None, None, "PENDING"), ("ACCEPTED", "r", None, "PENDING_FOR_APPROVAL"),
            ("REJECTED", None, None, "AI_PROCESSED_NOT_SENT"), ("ACCEPTED", "r", "PASS", "ACCEPTED"),
            ("REJECTED", None, "FAIL", "AI_PROCESSED_NOT_SENT"), ("ODD", None, None, "ODD")]
    frame = spark.createDataFrame(rows, "a string, r string, d string, want string")
    got = frame.select("want", C.application_status(F.col("a"), F.col("r"), F.col("d")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_hours(spark):
    frame = spark.createDataFrame(
        [("2020-01-01", "2020-01-07", "2021-01-01"), ("2020-01-01", None, "2020-01-14"), ("2020-01-01", None, None)],
        "a string, b string, i string").select(*[F.col(c).cast("date") for c in "abi"])
    got = [r.h for r in frame.select(C.hours_from_dates(F.col("a"), F.col("b"), F.col("i")).alias("h")).collect()]
    assert got == [40, 80, None]
    assert [r.p for r in spark.createDataFrame([("1040 hours",), ("12.5",), (None,)], "x string").select(
        C.hours_problem(F.col("x")).alias("p")).collect()] == ["Working hours are not a number: 1040 hours", None, None]
