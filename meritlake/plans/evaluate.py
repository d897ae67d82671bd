"""The whole evaluation as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.companies import rollup_status
from meritlake.functions.credits import (
    cap_breakdown, cap_credits, credits_from_hours, future_date_justification, hours_source_choice)
from meritlake.functions.names import with_name_match
from meritlake.functions.text import input_problem, sanitize_text
from meritlake.operators.degrees import degree_keyword_score, match_degree
from meritlake.operators.extraction import extract_fields
from meritlake.operators.identity import NO_IDENTITY


def position_totals(positions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All a certificate needs from its positions, in one aggregate.

    Days of positions without an end are kept as a count and a sum of start days, so the issue
    date can be filled in afterwards and positions meet no other table on the certificate.
    """
    start, end = F.col("start_date"), F.col("end_date")
    open_ended = end.isNull() & start.isNotNull()
    named = F.coalesce(F.col("employer"), F.lit("")) != ""
    bad = F.coalesce(F.col("counts_as_bad"), F.lit(False))
    return (
        positions.join(verdicts.where("counts_as_bad").select("employer", "counts_as_bad"), "employer", "left")
        .groupBy("certificate_id")
        .agg(
            F.count(F.lit(1)).alias("n_positions"),
            F.sum(F.datediff(end, start) + 1).alias("closed_days"),
            F.count_if(open_ended).alias("open_positions"),
            F.sum(F.when(open_ended, F.unix_date(start))).alias("open_start_days"),
            F.max(F.greatest(start, end)).alias("last_date"),
            F.count_if(named).alias("companies_checked"),
            F.count_if(named & bad).alias("bad_companies"),
        )
    )


def total_hours(issue_date: Column, weekly_hours: Column) -> Column:
    """Hours from the totals of :func:`position_totals`, rounded once."""
    none = F.lit(0).cast("long")
    open_days = F.col("open_positions") * (F.unix_date(issue_date) + 1) - F.col("open_start_days")
    days = F.coalesce("closed_days", none) + F.coalesce(open_days, none)
    return F.round(days * weekly_hours / 7).cast("int")


def decide(df: DataFrame, as_of: Column) -> DataFrame:
    """Credits, cap, decision and justification from hours, relevance, dates and name check.

    Needs: name_match, match_explanation, future, hours, requested_type, degree_relevance.
    The decision rule is ours (the wording of the rest is fixed): general training is accepted,
    professional training when the degree relevance is medium or high.
    """
    settled = ~F.col("name_match") | F.col("future")
    counted = df.withColumn(
        "total_working_hours", F.when(settled, F.lit(0)).otherwise(F.coalesce("hours", F.lit(0)))
    ).withColumn("credits_calculated", credits_from_hours(F.col("total_working_hours")))
    base, kind = F.col("credits_calculated"), F.col("requested_type")
    related = F.col("degree_relevance").isin("high", "medium")
    decision = (
        F.when(settled, F.lit("REJECTED"))
        .when((kind == "general") | related, F.lit("ACCEPTED")).otherwise(F.lit("REJECTED"))
    )
    justification = (
        F.when(~F.col("name_match"), F.concat(
            F.lit("Certificate rejected due to name mismatch: "), F.col("match_explanation")))
        .when(F.col("future"), future_date_justification(as_of))
        .otherwise(F.concat(
            F.lit("Degree relevance is "), F.col("degree_relevance"), F.lit(" for "), kind,
            F.lit(" training")))
    )
    return counted.withColumns({
        "credits_qualified": cap_credits(base, kind),
        "calculation_breakdown": F.coalesce(
            cap_breakdown(F.col("total_working_hours"), base, kind),
            F.lit("No calculation breakdown provided")),
        "degree_relevance": F.when(F.col("name_match"), F.col("degree_relevance")).otherwise(F.lit("low")),
        "ai_decision": decision,
        "ai_justification": justification,
    })


def certificate_facts(extractions: DataFrame, positions: DataFrame, document_hours: DataFrame,
                      verdicts: DataFrame) -> DataFrame:
    """The extractions, each with the totals of its certificate's positions and the sum of its document hours.

    Positions and document hours shrink to one row per certificate before they join.
    """
    stated = document_hours.groupBy("certificate_id").agg(F.sum("hours").cast("int").alias("document_hours"))
    return (extractions.join(position_totals(positions, verdicts), "certificate_id", "left")
            .join(stated, "certificate_id", "left"))


def evaluate_certificates(certificates: DataFrame, students: DataFrame, extractions: DataFrame,
                          positions: DataFrame, document_hours: DataFrame, verdicts: DataFrame,
                          catalogue: DataFrame, as_of: str) -> DataFrame:
    """Flat decision rows for all certificates that have an extraction.

    ``extractions``: certificate_id, employee_name, issue_date, duties. ``positions``:
    certificate_id, employer, start_date, end_date. ``document_hours``: certificate_id, hours.
    ``verdicts``: employer, counts_as_bad. ``catalogue``: programme_key, industries, roles.
    """
    return evaluate_facts(certificates, students, certificate_facts(extractions, positions, document_hours, verdicts),
                          catalogue, as_of)


def evaluate_facts(certificates: DataFrame, students: DataFrame, facts: DataFrame, catalogue: DataFrame,
                   as_of: str) -> DataFrame:
    """The same from the rows of :func:`certificate_facts`, which may have been made and stored before."""
    today = F.lit(as_of).cast("date")
    people = students.select(
        "student_id", "first_name", "last_name", match_degree(F.col("degree")).alias("programme_key"))
    base = (
        certificates.select("certificate_id", "student_id", "training_type", "work_type")
        .join(people.withColumn("_known", F.lit(True)), "student_id", "left")
        .join(facts, "certificate_id")
        .withColumn("text", F.col("duties"))
    )
    scored = degree_keyword_score(base, catalogue)
    named = with_name_match(scored, "first_name", "last_name", "employee_name")
    unknown = F.col("_known").isNull()
    ready = named.withColumns({
        "match_result": F.when(unknown, F.lit("unknown")).otherwise(F.col("match_result")),
        "match_explanation": F.when(unknown, F.lit(NO_IDENTITY)).otherwise(F.col("match_explanation")),
        "name_match": unknown | F.col("match_result").isin("match", "partial_match"),
        "future": F.coalesce(F.greatest("last_date", "issue_date") > today, F.lit(False)),
        "requested_type": F.lower("training_type"),
        "hours": hours_source_choice(
            F.col("work_type"), F.col("document_hours"),
            total_hours(F.col("issue_date"), F.lit(float(K.FULL_TIME_WEEK_HOURS)))),
    })
    return decide(ready, today).select(
        "certificate_id", "student_id", "requested_type", "programme_key", "total_working_hours",
        "credits_calculated", "credits_qualified", "calculation_breakdown", "degree_relevance",
        "ai_decision", "ai_justification",
        rollup_status(F.col("bad_companies"), F.col("companies_checked"), F.col("n_positions"))
        .alias("company_validation_status"),
        F.col("match_result").alias("name_validation_match_result"),
        F.col("match_explanation").alias("name_validation_explanation"),
    )


def evaluate_texts(texts: DataFrame, catalogue: DataFrame, as_of: str) -> DataFrame:
    """The same evaluation from raw certificate texts, by rules alone.

    ``texts``: certificate_id, text, first_name, last_name, degree, training_type. A text that
    cannot be evaluated keeps its row with ``input_error``. No shuffle: every step is local to
    the row but for the broadcast catalogue.
    """
    today = F.lit(as_of).cast("date")
    prepared = (
        texts.withColumn("input_error", input_problem(F.col("text")))
        .withColumn("text", sanitize_text(F.col("text"), limit=None))
        .withColumn("programme_key", match_degree(F.col("degree")))
    )
    scored = degree_keyword_score(extract_fields(prepared), catalogue)
    named = with_name_match(scored, "first_name", "last_name", "employee_name")

    # the extraction has written its dates as ISO texts
    def days(p: Column) -> Column:
        return F.coalesce(F.datediff(p["end_date"].try_cast("date"), p["start_date"].try_cast("date")) + 1, F.lit(0))

    week = F.coalesce("weekly_hours", F.lit(float(K.FULL_TIME_WEEK_HOURS))
                      * F.coalesce("percent", F.lit(100.0)) / 100)
    late = F.exists("positions", lambda p: (p["start_date"].try_cast("date") > today) | (p["end_date"].try_cast("date") > today))
    ready = named.withColumns({
        "name_match": F.col("match_result").isin("match", "partial_match"),
        "future": F.coalesce(late, F.lit(False)) | F.coalesce(F.col("issue_date") > today, F.lit(False)),
        "requested_type": F.lower("training_type"),
        "hours": F.round(
            F.aggregate(F.transform("positions", days), F.lit(0), lambda total, n: total + n)
            * week / 7).cast("int"),
    })
    done = decide(ready, today)
    usable = F.col("input_error").isNull()
    result = ["total_working_hours", "credits_calculated", "credits_qualified", "degree_relevance",
              "ai_decision", "ai_justification", "match_result"]
    return done.select(
        "certificate_id", "input_error", "employee_name", "employer", "requested_type", "programme_key",
        *[F.when(usable, F.col(c)).alias(c) for c in result])
