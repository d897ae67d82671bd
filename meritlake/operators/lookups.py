"""Point look-ups and lists. Filters and column choice reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CERTIFICATE_LIST = ("certificate_id", "student_id", "training_type", "work_type", "filename",
                    "filetype", "uploaded_at")


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with one value in a key column; none means not found."""
    return df.where(F.col(column) == F.lit(value))


def student_by_email(students: DataFrame, email: str) -> DataFrame:
    return by_key(students, "email", email)


def student_by_id(students: DataFrame, student_id) -> DataFrame:
    return by_key(students, "student_id", student_id)


def certificate_by_id(certificates: DataFrame, certificate_id) -> DataFrame:
    return by_key(certificates, "certificate_id", certificate_id)


def certificates_of_student(certificates: DataFrame, student_id) -> DataFrame:
    """Newest first, without file bytes or text."""
    return (
        by_key(certificates, "student_id", student_id)
        .select(*CERTIFICATE_LIST)
        .orderBy(F.desc_nulls_first("uploaded_at"), "certificate_id")
    )


def decision_by_id(decisions: DataFrame, decision_id) -> DataFrame:
    return by_key(decisions, "decision_id", decision_id)


def decisions_page(decisions: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page, newest first; the id breaks ties so pages never overlap."""
    return (
        decisions.orderBy(F.desc_nulls_first("created_at"), "decision_id").offset(skip).limit(limit)
    )


def reviewer_by_email(reviewers: DataFrame, email: str) -> DataFrame:
    return by_key(reviewers, "email", email)


def all_reviewers(reviewers: DataFrame) -> DataFrame:
    return reviewers.orderBy(F.asc_nulls_last("first_name"), F.asc_nulls_last("last_name"),
                             "reviewer_id")


def additional_documents_of(documents: DataFrame, certificate_id) -> DataFrame:
    return by_key(documents, "certificate_id", certificate_id).orderBy(
        F.asc_nulls_last("uploaded_at"), "document_id")


def student_comment_of(decisions: DataFrame, certificate_id) -> DataFrame:
    return (
        by_key(decisions, "certificate_id", certificate_id)
        .where(F.col("student_comment").isNotNull())
        .select("certificate_id", "student_comment")
    )
