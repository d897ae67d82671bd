"""Does the name on the certificate belong to the student?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake.functions.names import full_name, with_name_match

NO_IDENTITY = "Student identity not available - name validation skipped"


def validate_student_names(extractions: DataFrame, certificates: DataFrame,
                           students: DataFrame) -> DataFrame:
    """Compare each extracted employee name with its certificate's student.

    ``extractions``: certificate_id, employee_name. Without a student on record the check
    passes as 'unknown' at 0.5; an unreadable name does not pass.
    """
    owners = certificates.select("certificate_id", "student_id")
    people = students.select("student_id", "first_name", "last_name", F.lit(True).alias("_known"))
    joined = extractions.join(owners, "certificate_id", "left").join(people, "student_id", "left")
    unknown = F.col("_known").isNull()
    compared = with_name_match(joined, "first_name", "last_name", "employee_name")
    stored = lambda name: F.when(unknown, F.lit("Unknown")).otherwise(
        F.coalesce(name, F.lit("")))
    return (
        compared
        .withColumn("match_result", F.when(unknown, F.lit("unknown")).otherwise(F.col("match_result")))
        .withColumn("match_confidence", F.when(unknown, F.lit(0.5)).otherwise(F.col("match_confidence")))
        .withColumn("match_explanation",
                    F.when(unknown, F.lit(NO_IDENTITY)).otherwise(F.col("match_explanation")))
        .select(
            *extractions.columns,
            stored(F.col("first_name")).alias("db_student_first_name"),
            stored(F.col("last_name")).alias("db_student_last_name"),
            F.when(unknown, F.lit("Unknown")).otherwise(
                full_name(F.col("first_name"), F.col("last_name"))).alias("db_student_full_name"),
            "match_result", "match_confidence", "match_explanation",
            (unknown | F.col("match_result").isin("match", "partial_match")).alias("name_match"),
        )
    )


def with_rejection(checked: DataFrame) -> DataFrame:
    """All rows in one pass, with the fields of a finished rejection where the names do not match (else null)."""
    why, matches = F.col("match_explanation"), F.col("name_match")
    fields = {
        "decision": F.lit("REJECTED"),
        "justification": F.concat(F.lit("Certificate rejected due to name mismatch: "), why),
        "total_working_hours": F.lit(0),
        "credits_qualified": F.lit(0.0),
        "degree_relevance": F.lit("low"),
        "relevance_explanation": F.lit("Not evaluated due to name mismatch"),
        "calculation_breakdown": F.lit("Not calculated due to name mismatch"),
        "summary_justification": F.concat(F.lit("Certificate rejected: "), why),
        "recommendation": F.lit("REJECT - Name validation failed"),
        "issue_type": F.lit("name_mismatch"),
        "issue_severity": F.lit("critical"),
        "issue_description": F.concat(F.lit("Student name mismatch: "), why),
        "requires_correction": F.lit(False),
    }
    return checked.withColumns({name: F.when(~matches, value) for name, value in fields.items()})


def reject_on_name_mismatch(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to evaluate, finished rejections): a mismatch ends the evaluation at once.

    Each of the two compares all names anew; :func:`with_rejection` has both in one pass.
    """
    return checked.where("name_match"), with_rejection(checked.where(~F.col("name_match")))
