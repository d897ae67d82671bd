"""Updates and deletes as folds of an append-only action table.

``actions``: certificate_id, action_id (unique, ascending in time), action_at and the fields
of the action. Each operator gives a new state table and never changes its input; a job
writes it to a new path and switches to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.operators.ordered import first_reviewer

NOT_FOUND = "Certificate not found"
COMMENT_EXISTS = "Student comment already exists for this certificate"
NO_REVIEWERS = "No reviewers available"
BAD_REVIEW = "Invalid reviewer_decision. Use 'PASS' or 'FAIL'."

_TIME = ("action_at", "action_id")


def _last(fields: list[str], given: Column | None = None) -> Column:
    """Fields of the latest action, or of the latest where ``given`` holds."""
    when = F.struct(*_TIME) if given is None else F.when(given, F.struct(*_TIME))
    return F.max_by(F.struct(*fields), when)


def _replace(decisions: DataFrame, latest: DataFrame, **columns: Column) -> DataFrame:
    return (
        decisions.join(latest, "certificate_id", "left")
        .withColumns(columns).select(*decisions.columns)
    )


def apply_reviews(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Set comment, PASS/FAIL and time of the latest valid review; a student comment only if given."""
    review = F.upper("reviewer_decision")
    valid = actions.where(review.isin("PASS", "FAIL")).withColumn("reviewer_decision", review)
    latest = valid.groupBy("certificate_id").agg(
        _last(["reviewer_comment", "reviewer_decision", "action_at"]).alias("_review"),
        _last(["student_comment"], F.col("student_comment").isNotNull()).alias("_comment"))
    reviewed = F.col("_review").isNotNull()

    def new(column: str, source: str) -> Column:
        return F.when(reviewed, F.col(source)).otherwise(F.col(column))

    return _replace(
        decisions, latest,
        reviewer_comment=new("reviewer_comment", "_review.reviewer_comment"),
        reviewer_decision=new("reviewer_decision", "_review.reviewer_decision"),
        reviewed_at=new("reviewed_at", "_review.action_at"),
        student_comment=F.coalesce("_comment.student_comment", "student_comment"),
    )


def rejected_reviews(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Reviews that change nothing, with the reason."""
    known = decisions.select("certificate_id").distinct().withColumn("_known", F.lit(True))
    bad = ~F.coalesce(F.upper("reviewer_decision").isin("PASS", "FAIL"), F.lit(False))
    reason = F.when(bad, F.lit(BAD_REVIEW)).when(F.col("_known").isNull(), F.lit(NOT_FOUND))
    return (
        actions.join(known, "certificate_id", "left").withColumn("reason", reason)
        .where(F.col("reason").isNotNull()).select("action_id", "certificate_id", "reason")
    )


def apply_feedback(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Set the latest student comment, and the latest reviewer that was given."""
    latest = actions.groupBy("certificate_id").agg(
        _last(["student_comment"]).alias("_comment"),
        _last(["reviewer_id"], F.col("reviewer_id").isNotNull()).alias("_reviewer"))
    return _replace(
        decisions, latest,
        student_comment=F.when(F.col("_comment").isNotNull(), F.col("_comment.student_comment"))
        .otherwise(F.col("student_comment")),
        reviewer_id=F.coalesce("_reviewer.reviewer_id", "reviewer_id"),
    )


def _first_comments(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Per certificate with a decision and no comment yet, the earliest comment action."""
    open_ones = decisions.groupBy("certificate_id").agg(
        F.max(F.coalesce(F.col("student_comment"), F.lit("")) != "").alias("_taken"))
    earliest = actions.groupBy("certificate_id").agg(
        F.min_by(F.struct(*actions.columns), F.struct(*_TIME)).alias("_first"))
    return open_ones.join(earliest, "certificate_id", "left")


def comment_outcomes(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Every comment action with its outcome: 'accepted' or why not."""
    firsts = _first_comments(decisions, actions).select(
        "certificate_id", "_taken", F.col("_first.action_id").alias("_accepted_id"),
        F.lit(True).alias("_known"))
    return actions.join(firsts, "certificate_id", "left").withColumn(
        "outcome",
        F.when(F.col("_known").isNull(), F.lit(NOT_FOUND))
        .when(F.col("_taken") | (F.col("action_id") != F.col("_accepted_id")), F.lit(COMMENT_EXISTS))
        .otherwise(F.lit("accepted")),
    ).select("action_id", "certificate_id", "outcome")


def apply_first_comment(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """A comment is taken only where there is none; the earliest one wins."""
    firsts = _first_comments(decisions, actions).where(~F.col("_taken") & F.col("_first").isNotNull())
    return _replace(
        decisions, firsts.select("certificate_id", F.col("_first.student_comment").alias("_new")),
        student_comment=F.coalesce("_new", "student_comment"))


def send_for_approval(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Assign the reviewer of the latest action."""
    latest = actions.groupBy("certificate_id").agg(_last(["reviewer_id"]).alias("_latest"))
    return _replace(
        decisions, latest,
        reviewer_id=F.when(F.col("_latest").isNotNull(), F.col("_latest.reviewer_id"))
        .otherwise(F.col("reviewer_id")))


def apply_appeals(decisions: DataFrame, actions: DataFrame, reviewers: DataFrame) -> DataFrame:
    """A once-only comment with a reviewer: the one given, else the first by name.

    Without any reviewer nothing changes (see :func:`appeal_outcomes`).
    """
    default = first_reviewer(reviewers).scalar()
    firsts = _first_comments(decisions, actions).where(~F.col("_taken") & F.col("_first").isNotNull())
    latest = firsts.select(
        "certificate_id", F.col("_first.student_comment").alias("_comment"),
        F.coalesce(F.col("_first.reviewer_id"), default).alias("_reviewer"),
        default.isNotNull().alias("_possible"))
    taken = F.coalesce("_possible", F.lit(False))
    return _replace(
        decisions, latest,
        student_comment=F.when(taken, F.col("_comment")).otherwise(F.col("student_comment")),
        reviewer_id=F.when(taken, F.col("_reviewer")).otherwise(F.col("reviewer_id")))


def appeal_outcomes(decisions: DataFrame, actions: DataFrame, reviewers: DataFrame) -> DataFrame:
    default = first_reviewer(reviewers).scalar()
    return comment_outcomes(decisions, actions).withColumn(
        "outcome",
        F.when((F.col("outcome") == "accepted") & default.isNull(), F.lit(NO_REVIEWERS))
        .otherwise(F.col("outcome")))


def delete_certificates(deletes: DataFrame, certificates: DataFrame, decisions: DataFrame,
                        documents: DataFrame) -> dict[str, DataFrame]:
    """The three tables without the listed certificates and what hangs on them."""
    gone = deletes.select("certificate_id").distinct()
    return {
        name: table.join(gone, "certificate_id", "left_anti")
        for name, table in {"certificates": certificates, "decisions": decisions,
                            "additional_documents": documents}.items()
    }


def attach_text(table: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Store extracted text; a row without a new text keeps its old one."""
    new = texts.select(key, F.col("text").alias("_new"))
    return table.join(new, key, "left").withColumn(
        "ocr_output", F.coalesce("_new", "ocr_output")).select(*table.columns)
