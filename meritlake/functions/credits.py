"""Hours, credits and application status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake import constants as K


def hours_problem(raw_hours: Column) -> Column:
    """Error text when hours are no number; the row is kept and the batch goes on."""
    return F.when(
        raw_hours.isNotNull() & raw_hours.try_cast("double").isNull(),
        F.concat(F.lit("Working hours are not a number: "), raw_hours),
    )


def credits_from_hours(hours: Column) -> Column:
    """Whole credits, cut toward zero."""
    return (hours / F.lit(float(K.HOURS_PER_CREDIT))).cast("int").cast("double")


def _cap(training_type: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, cap in K.CREDIT_CAPS.items():
        chain = chain.when(training_type == name, F.lit(cap))
    return chain


def effective_type(requested: Column, answered: Column | None = None) -> Column:
    """The requested type, or the one in the answer when none was requested."""
    asked = F.nullif(requested, F.lit(""))
    return asked if answered is None else F.coalesce(asked, answered)


def cap_credits(base: Column, training_type: Column) -> Column:
    """Credits after the cap of the training type; other types have none."""
    return F.least(base, _cap(training_type).cast("double"))


def cap_breakdown(hours: Column, base: Column, training_type: Column) -> Column:
    """Calculation text, only where the cap took effect."""
    cap = _cap(training_type)
    return F.when(
        base > cap,
        F.concat(
            hours.cast("string"),
            F.lit(f" hours / {K.HOURS_PER_CREDIT} hours per ECTS = "),
            base.cast("int").cast("string"),
            F.lit(".0 credits, capped at "),
            cap.cast("string"),
            F.lit(".0 maximum for "),
            training_type,
            F.lit(" training"),
        ),
    )


def hours_per_credit(hours: Column, credits: Column) -> Column:
    return F.nullif(hours, F.lit(0)) / F.nullif(credits, F.lit(0.0))


def application_status(ai_decision: Column, reviewer_id: Column, reviewer_decision: Column) -> Column:
    no_reviewer = reviewer_id.isNull()
    no_review = F.coalesce(reviewer_decision, F.lit("")) == ""
    return (
        F.when(F.coalesce(ai_decision, F.lit("")) == "", F.lit("PENDING"))
        .when(~no_reviewer & no_review, F.lit("PENDING_FOR_APPROVAL"))
        .when(ai_decision.isin(*K.DECISION_STATUSES) & no_reviewer, F.lit("AI_PROCESSED_NOT_SENT"))
        .otherwise(ai_decision)
    )


def hours_from_dates(start: Column, end: Column, issue_date: Column,
                     weekly_hours: Column | None = None, percent: Column | None = None) -> Column:
    """Hours of one position: whole days in weeks times the weekly hours.

    A missing end is the issue date and never today. The week has 40 hours unless hours or a
    percentage are stated; job words such as 'summer' or 'intern' say nothing about it.
    """
    week = F.lit(float(K.FULL_TIME_WEEK_HOURS))
    if percent is not None:
        week = week * F.coalesce(percent, F.lit(100.0)) / 100
    if weekly_hours is not None:
        week = F.coalesce(weekly_hours, week)
    days = F.datediff(F.coalesce(end, issue_date), start) + 1
    return F.round(days * week / 7).cast("int")


def hours_source_choice(work_type: Column, document_hours: Column, date_hours: Column) -> Column:
    """For self-paced work, stated document hours beat hours from dates."""
    return F.when(work_type == "SELF_PACED", F.coalesce(document_hours, date_hours)).otherwise(date_hours)


def future_date_justification(as_of: Column) -> Column:
    return F.concat(
        F.lit("The work experience cannot be evaluated because it contains dates after the current date ("),
        F.date_format(as_of, "yyyy-MM-dd"),
        F.lit("). Working hours cannot be calculated for employment periods that have not yet occurred. "
              "The certificate must be corrected to show valid past dates before it can be processed."),
    )
