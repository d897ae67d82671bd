"""Operators that depend on the order of rows inside a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.operators.segments import with_previous


def timeline_check(positions: DataFrame, order: list[str], max_gap_days: int = K.MAX_GAP_DAYS) -> DataFrame:
    """Positions with a start date against the one before: overlap and over-long gap.

    ``order`` makes positions with the same start distinct.
    """
    dated = positions.where(F.col("start_date").isNotNull())
    keys = ["certificate_id"]
    lagged = with_previous(dated, keys, ["start_date", *order], ["end_date"])
    gap = F.datediff("start_date", "previous_end_date")
    return lagged.select(
        *positions.columns, "previous_end_date",
        gap.alias("gap_days"),
        F.coalesce(F.col("previous_end_date") > F.col("start_date"), F.lit(False)).alias("overlaps"),
        F.coalesce(gap > max_gap_days, F.lit(False)).alias("large_gap"),
    )


def best_text_attempt(attempts: DataFrame, key: str, min_early_length: int = 400) -> DataFrame:
    """One text per document: the first attempt if long enough, else the best-scored one.

    Score is 10 per Finnish letter plus the length; the earliest attempt wins a tie. Attempts
    without text are skipped. ``attempts``: key, attempt (0-based), text. An aggregate, not a
    window, so many attempts of one document shrink before the shuffle.
    """
    length = F.length("text")
    letters = length - F.length(F.translate(F.lower("text"), K.FINNISH_LETTERS, ""))
    score = letters * 10 + length
    early = (F.col("attempt") == 0) & (length > min_early_length)
    return (
        attempts.where(length > 0)
        .groupBy(key)
        .agg(F.max_by(F.struct("attempt", score.alias("score"), "text"),
                      F.struct(early, score, -F.col("attempt"))).alias("_best"))
        .select(key, "_best.attempt", "_best.score", "_best.text")
    )


def latest_decision(decisions: DataFrame, columns: list[str]) -> DataFrame:
    """The newest decision of each certificate; the id breaks ties."""
    newest = F.struct(F.col("created_at"), F.col("decision_id"))
    return (
        decisions.groupBy("certificate_id")
        .agg(F.max_by(F.struct("decision_id", "created_at", *columns), newest).alias("_d"))
        .select("certificate_id", "_d.*")
    )


def first_reviewer(reviewers: DataFrame) -> DataFrame:
    """One row: the first reviewer by first and last name, nulls last."""
    place = F.struct(F.col("first_name").isNull(), "first_name", F.col("last_name").isNull(),
                     "last_name", "reviewer_id")
    return reviewers.agg(F.min_by("reviewer_id", place).alias("default_reviewer_id"))


def first_reviewer_default(appeals: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Appeals without a chosen reviewer go to the first one."""
    default: Column = first_reviewer(reviewers).scalar()
    return appeals.withColumn("assigned_reviewer_id", F.coalesce(F.col("reviewer_id"), default))
