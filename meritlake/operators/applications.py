"""Joins over students, certificates, decisions, reviewers and extra documents.

All joins are key joins whose right side has one row per key; adaptive execution splits a
hot left key. No side is forced to broadcast: its size is left to the runtime statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.functions.credits import application_status
from meritlake.functions.names import full_name, name_from_email, reviewer_display_name
from meritlake.operators.segments import arrays_in_order, newest_first


def _summaries(decisions: DataFrame, certificates: DataFrame, students: DataFrame) -> DataFrame:
    return (
        decisions.join(certificates, "certificate_id")
        .join(students, "student_id")
        .select(
            "decision_id", "certificate_id",
            name_from_email(F.col("email")).alias("student_name"),
            F.col("email").alias("student_email"), F.col("degree").alias("student_degree"),
            "filename", "training_type", "ai_decision", "reviewer_decision", "uploaded_at",
            "created_at", "student_comment",
        )
        .orderBy(F.desc_nulls_first("created_at"), "decision_id")
    )


def pending_applications(decisions, certificates, students) -> DataFrame:
    """Applications nobody has reviewed, newest decision first."""
    return _summaries(decisions.where(F.col("reviewer_decision").isNull()), certificates, students)


def applications_by_review_status(decisions, certificates, students, status: str) -> DataFrame:
    return _summaries(decisions.where(F.col("reviewer_decision") == status), certificates, students)


def document_arrays(documents: DataFrame) -> DataFrame:
    """Extra documents of each certificate as one array in upload order."""
    fields = ("document_id", "document_type", "filename", "filetype", "uploaded_at")
    # in the order of their fields, so the two that place them are held once
    entry = F.struct("uploaded_at", "document_id", "document_type", "filename", "filetype")
    item = lambda x: F.struct(*[x[name].alias(name) for name in fields])
    return documents.groupBy("certificate_id").agg(
        F.transform(F.sort_array(F.collect_list(entry)), item).alias("additional_documents"))


def _or_empty(df: DataFrame, name: str) -> DataFrame:
    empty = F.array().cast(df.schema[name].dataType)
    return df.withColumn(name, F.coalesce(name, empty))


def _with_documents(df: DataFrame, documents: DataFrame) -> DataFrame:
    return _or_empty(df.join(document_arrays(documents), "certificate_id", "left"), "additional_documents")


def student_applications(certificates, decisions, reviewers, documents, student_id=None, students=None,
                         email: str | None = None) -> DataFrame:
    """Every certificate with its decision, reviewer name, derived status and documents.

    Runs for all students at once, or for one by id or (with ``students``) by email, newest first. Documents are
    shown for self-paced work only.
    """
    one = student_id is not None or email is not None
    if student_id is not None:
        certificates = certificates.where(F.col("student_id") == F.lit(student_id))
    if email is not None:
        certificates = certificates.join(
            students.where(F.col("email") == F.lit(email)).select("student_id"), "student_id", "left_semi")
    people = reviewers.select(
        "reviewer_id", reviewer_display_name(F.col("first_name"), F.col("last_name")).alias("reviewer_name"))
    self_paced = certificates.where(F.col("work_type") == "SELF_PACED").select("certificate_id")
    rows = (
        certificates.join(decisions, "certificate_id", "left")
        .join(people, "reviewer_id", "left")
        .withColumn("status", application_status(
            F.col("ai_decision"), F.col("reviewer_id"), F.col("reviewer_decision")))
        .withColumn("credits", F.coalesce("credits_awarded", F.lit(0)))
    )
    rows = _with_documents(rows, documents.join(self_paced, "certificate_id", "left_semi"))
    return rows.orderBy(F.desc_nulls_first("uploaded_at"), "certificate_id") if one else rows


def student_with_certificates(students, certificates, student_id=None, email: str | None = None) -> DataFrame:
    """Students, or one by id or email, with their certificates as an array, newest first; empty when they have none."""
    if student_id is not None:
        students = students.where(F.col("student_id") == F.lit(student_id))
        certificates = certificates.where(F.col("student_id") == F.lit(student_id))
    if email is not None:
        students = students.where(F.col("email") == F.lit(email))
        certificates = certificates.join(students.select("student_id"), "student_id", "left_semi")
    item = F.struct("certificate_id", "training_type", "work_type", "filename", "uploaded_at")
    arrays = arrays_in_order(certificates, ["student_id"], [newest_first("uploaded_at"), F.col("certificate_id")], item, "certificates")
    return _or_empty(students.join(arrays, "student_id", "left"), "certificates")


def detailed_application(decisions, certificates, students, documents, certificate_id=None) -> DataFrame:
    """Decision, certificate and student as structs, with extra documents; of all certificates, or of one.

    A row exists only where all three exist.
    """
    if certificate_id is not None:
        decisions, certificates, documents = (
            table.where(F.col("certificate_id") == F.lit(certificate_id)) for table in (decisions, certificates, documents))

    def packed(df: DataFrame, name: str, *keys: str) -> DataFrame:
        return df.select(*keys, F.struct(*df.columns).alias(name))

    # certificates meet their student first, as they are the narrow rows; decisions and documents then
    # meet them by certificate and are not moved again
    owned = packed(certificates, "certificate", "certificate_id", "student_id").join(
        packed(students, "student", "student_id"), "student_id")
    joined = packed(decisions, "decision", "certificate_id").join(owned, "certificate_id")
    return _with_documents(joined, documents).select(
        "certificate_id", "student_id", "decision", "certificate", "student", "additional_documents")


def reviewer_worklist(decisions, certificates, students, reviewer_id=None) -> DataFrame:
    """Applications assigned to reviewers, with defaults for missing fields, newest first."""
    assigned = decisions.where(F.col("reviewer_id").isNotNull())
    if reviewer_id is not None:
        assigned = assigned.where(F.col("reviewer_id") == F.lit(reviewer_id))
    return (
        assigned.join(certificates, "certificate_id")
        .join(students, "student_id")
        .where(F.col("decision_id").isNotNull() & F.col("certificate_id").isNotNull()
               & F.col("student_id").isNotNull())
        .withColumns({
            "ai_justification": F.coalesce("ai_justification", F.lit("")),
            "ai_decision": F.coalesce(F.nullif("ai_decision", F.lit("")), F.lit("REJECTED")),
            "training_type": F.coalesce(F.nullif("training_type", F.lit("")), F.lit("GENERAL")),
            "filename": F.coalesce("filename", F.lit("")),
            "filetype": F.coalesce("filetype", F.lit("")),
            "email": F.coalesce("email", F.lit("")),
            "degree": F.coalesce("degree", F.lit("")),
        })
        .orderBy("reviewer_id", F.desc_nulls_first("created_at"), "decision_id")
    )


def student_identity_by_certificate(certificates, students) -> DataFrame:
    return (
        certificates.select("certificate_id", "student_id")
        .join(students.select("student_id", "first_name", "last_name", "email"), "student_id")
        .select(
            "certificate_id",
            F.coalesce("first_name", F.lit("")).alias("first_name"),
            F.coalesce("last_name", F.lit("")).alias("last_name"),
            F.coalesce("email", F.lit("")).alias("email"),
            full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        )
    )


def orphan_report(students, certificates, decisions, reviewers, documents) -> DataFrame:
    """Rows whose foreign key has no parent: child table, key column, row id, key value."""
    def orphans(child, table, row_id, key, parent) -> DataFrame:
        known = parent.select(key)
        return (
            child.where(F.col(key).isNotNull())
            .join(known, key, "left_anti")
            .select(F.lit(table).alias("child_table"), F.lit(key).alias("key_column"),
                    F.col(row_id).cast("string").alias("row_id"),
                    F.col(key).cast("string").alias("key_value"))
        )

    return (
        orphans(certificates, "certificates", "certificate_id", "student_id", students)
        .unionByName(orphans(decisions, "decisions", "decision_id", "certificate_id", certificates))
        .unionByName(orphans(decisions, "decisions", "decision_id", "reviewer_id", reviewers))
        .unionByName(orphans(documents, "additional_documents", "document_id", "certificate_id",
                             certificates))
    )


def status_fields(certificates: DataFrame) -> DataFrame:
    """'completed' with the decision's fields and their defaults, or 'processing' where decision_id is null."""
    done = F.col("decision_id").isNotNull()

    def when_done(column: str, default) -> Column:
        given = F.nullif(F.col(column), F.lit("")) if isinstance(default, str) else F.col(column)
        return F.when(done, F.coalesce(given, F.lit(default))).alias(column)

    return certificates.select(
        "certificate_id",
        F.when(done, F.lit("completed")).otherwise(F.lit("processing")).alias("status"),
        when_done("ai_decision", "PENDING"),
        when_done("ai_justification", "No justification provided"),
        when_done("total_working_hours", 0),
        when_done("credits_awarded", 0),
        when_done("training_duration", "Not specified"),
        when_done("training_institution", "Not specified"),
    )


def certificate_status(certificates, decisions) -> DataFrame:
    """Status of certificates against the decisions there are."""
    return status_fields(certificates.select("certificate_id").join(
        decisions.select("certificate_id", "decision_id", "ai_decision", "ai_justification",
                         "total_working_hours", "credits_awarded", "training_duration",
                         "training_institution"),
        "certificate_id", "left"))


def unprocessed_certificates(certificates, decisions) -> DataFrame:
    """The to-do list: certificates without a decision."""
    return certificates.join(decisions.select("certificate_id"), "certificate_id", "left_anti")
