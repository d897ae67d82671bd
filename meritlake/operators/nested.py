"""Nested workflow answers: reading, flattening, merging, serialising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.schemas import ISSUE, WORKFLOW


def parse_workflow(json_text: Column) -> Column:
    return F.from_json(json_text, WORKFLOW)


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def flatten_decision(df: DataFrame, workflow: str = "workflow") -> DataFrame:
    """One flat decision row per successful workflow, with defaults; the nested form stays as JSON.

    Anything but ACCEPTED is stored as REJECTED. The company block may also stand directly in
    the validation stage. Failed workflows give no decision, see :func:`failed_workflows`.
    """
    w = F.col(workflow)
    evaluation, extraction = w["evaluation_results"]["results"], w["extraction_results"]["results"]
    stage = w["validation_results"]
    validation = stage["results"]
    company = F.when(validation.isNotNull(), validation["company_validation"]).otherwise(
        stage["company_validation"])
    person = validation["name_validation"]
    company_status = _or(company["status"], "UNVERIFIED")
    company_text = (
        F.when(company.isNull(), F.lit("No company validation data available"))
        .when(F.size(_or_empty(company["companies"])) > 0, F.to_json(company["companies"]))
        .otherwise(F.concat(F.lit("Overall Status: "), company_status,
                            F.lit("\nNo individual company details available.")))
    )
    return df.where(w["success"]).select(
        *[c for c in df.columns if c != workflow],
        F.when(evaluation["decision"] == "ACCEPTED", F.lit("ACCEPTED"))
        .otherwise(F.lit("REJECTED")).alias("ai_decision"),
        _or(evaluation["justification"], "No justification provided").alias("ai_justification"),
        _or(evaluation["total_working_hours"], 0).alias("total_working_hours"),
        F.round(_or(evaluation["credits_qualified"], 0.0)).cast("int").alias("credits_awarded"),
        _or(extraction["total_employment_period"], "Not specified").alias("training_duration"),
        _or(extraction["employer"], "Not specified").alias("training_institution"),
        _or(evaluation["degree_relevance"], "Not specified").alias("degree_relevance"),
        _or(evaluation["supporting_evidence"], "").alias("supporting_evidence"),
        _or(evaluation["challenging_evidence"], "").alias("challenging_evidence"),
        _or(evaluation["recommendation"], "").alias("recommendation"),
        F.to_json(w, {"ignoreNullFields": "false"}).alias("ai_workflow_json"),
        company_status.alias("company_validation_status"),
        company_text.alias("company_validation_justification"),
        person["match_result"].alias("name_validation_match_result"),
        person["explanation"].alias("name_validation_explanation"),
    )


def failed_workflows(df: DataFrame, workflow: str = "workflow") -> DataFrame:
    """Rows whose workflow did not succeed, with its error."""
    w = F.col(workflow)
    return df.where(~F.coalesce(w["success"], F.lit(False))).select(
        *[c for c in df.columns if c != workflow], _or(w["error"], "Unknown error").alias("error"))


def _or_empty(array: Column) -> Column:
    return F.when(array.isNull(), F.array()).otherwise(array)


def merge_validation(validation: Column, company: Column, person: Column,
                     company_issues: Column) -> Column:
    """Validation answer with the company block, the name block and the company issues added."""
    issues = F.when(
        F.size(F.coalesce(company_issues, F.array().cast(f"array<{ISSUE}>"))) > 0,
        F.concat(F.coalesce(validation["issues_found"], F.array().cast(f"array<{ISSUE}>")), company_issues),
    ).otherwise(validation["issues_found"])
    return (
        validation.withField("company_validation", company)
        .withField("name_validation", F.coalesce(person, validation["name_validation"]))
        .withField("issues_found", issues)
    )


def explode_issues(df: DataFrame, issues: str = "issues_found") -> DataFrame:
    """One row per issue; a row without issues stays with nulls."""
    keep = [c for c in df.columns if c != issues]
    return df.select(*keep, F.inline_outer(F.col(issues)))


def issue_counts(exploded: DataFrame) -> DataFrame:
    return (
        exploded.where(F.col("severity").isNotNull())
        .groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    )


_TIMES = ("uploaded_at", "created_at", "reviewed_at")
ENTITY_FIELDS = {
    "students": ("student_id", "email", "degree", "first_name", "last_name"),
    "reviewers": ("reviewer_id", "email", "first_name", "last_name", "position", "department"),
    "certificates": ("certificate_id", "filename", "training_type", "uploaded_at"),
    "decisions": (
        "decision_id", "certificate_id", "ai_justification", "ai_decision", "created_at",
        "student_comment", "reviewer_id", "reviewer_decision", "reviewer_comment", "reviewed_at",
        "total_working_hours", "credits_awarded", "training_duration", "training_institution",
        "degree_relevance", "supporting_evidence", "challenging_evidence", "recommendation",
        "ai_workflow_json", "company_validation_status", "company_validation_justification"),
    "additional_documents": ("document_id", "certificate_id", "document_type", "filename",
                             "filetype", "uploaded_at", "ocr_output"),
}


def entity_struct(table: str) -> Column:
    """Fields of an entity as they are served: ids as text, times in ISO form."""
    def field(name: str) -> Column:
        if name in _TIMES:
            # certificates show a blank between date and time, the others a 'T'
            pattern = "yyyy-MM-dd HH:mm:ss" if table == "certificates" else "yyyy-MM-dd'T'HH:mm:ss"
            return F.date_format(name, pattern).alias(name)
        if name.endswith("_id"):
            return F.col(name).cast("string").alias(name)
        return F.col(name)

    fields = [field(name) for name in ENTITY_FIELDS[table]]
    if table == "decisions":
        fields.append(F.when(
            F.col("name_validation_match_result").isNotNull(),
            F.struct(F.col("name_validation_match_result").alias("match_result"),
                     F.col("name_validation_explanation").alias("explanation")),
        ).alias("name_validation"))
    return F.struct(*fields)


def entity_to_json(table: str) -> Column:
    return F.to_json(entity_struct(table), {"ignoreNullFields": "false"})
