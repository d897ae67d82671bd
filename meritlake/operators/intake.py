"""Uploads and inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.names import student_email_ok
from meritlake.functions.rules import broken, messages
from meritlake.functions.text import suffix_of
from meritlake.session import work_folder
from meritlake.sources.keyed_store import KeyedStore


def _file_problem(filename: Column, size: Column) -> Column:
    suffix = suffix_of(filename)
    return (
        F.when(filename.isNull() | (filename == ""), F.lit("No filename provided"))
        .when(suffix == "", F.lit("File must have an extension"))
        .when(~suffix.isin(*K.UPLOAD_SUFFIXES),
              F.concat(F.lit("File type "), suffix, F.lit(" not supported")))
        .when(size > K.MAX_UPLOAD_BYTES, F.lit("File size too large. Maximum size is 10MB."))
        .when(size == 0, F.lit("File is empty"))
    )


def admit_uploads(uploads: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (the first failing check, null when accepted) and ``filetype``.

    ``uploads``: training_type, work_type, filename, size.
    """
    def outside(column: str, allowed: tuple[str, ...]) -> Column:
        return ~F.coalesce(F.upper(F.col(column)).isin(*allowed), F.lit(False))

    reason = (
        F.when(outside("training_type", K.TRAINING_TYPES), F.lit("Invalid training type"))
        .when(outside("work_type", K.WORK_TYPES), F.lit("Invalid work type"))
        .otherwise(_file_problem(F.col("filename"), F.col("size")))
    )
    return uploads.withColumns({
        "reject_reason": reason, "filetype": F.nullif(suffix_of(F.col("filename")), F.lit(""))})


def admit_additional_documents(documents: DataFrame, certificates: DataFrame) -> DataFrame:
    """Extra documents that pass the file checks, of self-paced certificates only.

    Failing ones are skipped; every kept one counts as hour documentation.
    """
    self_paced = certificates.where(F.col("work_type") == "SELF_PACED").select("certificate_id")
    return (
        documents.where(_file_problem(F.col("filename"), F.col("size")).isNull())
        .join(self_paced, "certificate_id", "left_semi")
        .withColumns({"document_type": F.lit("HOUR_DOCUMENTATION"),
                      "filetype": suffix_of(F.col("filename"))})
    )


def new_id(**parts: Column) -> Column:
    """An id from the content, so a repeated run gives the same one; nulls and any text keep parts apart."""
    named = F.struct(*[part.cast("string").alias(name) for name, part in parts.items()])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


DOMAINS = {
    "training_type": K.TRAINING_TYPES,
    "work_type": K.WORK_TYPES,
    "ai_decision": K.DECISION_STATUSES,
    "document_type": K.DOCUMENT_TYPES,
    "reviewer_decision": K.REVIEWER_DECISIONS,
    "company_validation_status": K.COMPANY_STATUSES,
    "name_validation_match_result": K.NAME_MATCH_RESULTS,
}
NULLABLE_DOMAINS = ("reviewer_decision", "name_validation_match_result", "company_validation_status")
LENGTHS = {
    "email": 255, "first_name": 255, "last_name": 255, "position": 255, "department": 255,
    "degree": 255, "filename": 255, "filetype": 50,
}
NOT_EMPTY = ("degree", "filename", "filetype", "ai_justification")


def row_rules(columns: list[str], email_domain: str | None = None) -> dict[str, Column]:
    """Row rules of a table by what they find: domains, lengths, empty texts and the email pattern.

    Which rules apply follows from the columns the table has. A rule holds where the row breaks it.
    """
    rules: dict[str, Column] = {}
    for name in columns:
        column = F.col(name)
        if name in DOMAINS:
            bad = ~column.isin(*DOMAINS[name])
            rules[f"{name}: not in domain"] = bad if name in NULLABLE_DOMAINS else bad | column.isNull()
        if name in LENGTHS:
            rules[f"{name}: too long"] = F.length(column) > LENGTHS[name]
        if name in NOT_EMPTY:
            rules[f"{name}: empty"] = column.isNull() | (column == "")
        if name == "email":
            rules["email: missing"] = column.isNull()
            if email_domain:
                rules["email: wrong form"] = ~student_email_ok(column, email_domain)
    return rules


def constraint_problems(df: DataFrame, email_domain: str | None = None) -> Column:
    """What the rules of :func:`row_rules` find in a row."""
    return messages(*[broken(bad, found) for found, bad in row_rules(df.columns, email_domain).items()])


def check_constraints(df: DataFrame, row_id: str, email_domain: str | None = None) -> DataFrame:
    """(row_id, problem) for every broken row rule, and for emails used more than once."""
    rows = df.select(F.col(row_id).cast("string").alias("row_id"),
                     F.explode(constraint_problems(df, email_domain)).alias("problem"))
    if "email" not in df.columns:
        return rows
    repeated = (
        df.groupBy("email").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND email IS NOT NULL")
        .select(F.col("email").alias("row_id"), F.lit("email: not unique").alias("problem"))
    )
    return rows.unionByName(repeated)


def with_content_id(records: DataFrame, id_column: str, id_parts: list[str]) -> DataFrame:
    return records.withColumn(id_column, new_id(**{part: F.col(part) for part in id_parts}))


def append_records(records: DataFrame, store: KeyedStore, id_parts: list[str], time_column: str | None = None) -> DataFrame:
    """Store rows under a content id, the store's key, with a time stamp; rows already there stay as they are.

    Rows breaking a row rule of their columns are refused: they come back with ``problems``. Records are
    computed once and written to the working folder, from where both kinds are read.
    """
    if time_column and time_column not in records.columns:
        records = records.withColumn(time_column, F.current_timestamp())
    with_id = with_content_id(records, store.key, id_parts)
    checked = with_id.withColumn("problems", constraint_problems(with_id))
    folder = work_folder(records.sparkSession, "checked-records")
    checked.write.parquet(folder)
    checked = records.sparkSession.read.schema(checked.schema).parquet(folder)
    store.insert_new(checked.where(F.size("problems") == 0))
    return checked.where(F.size("problems") > 0)


def seed_if_absent(existing: DataFrame, new: DataFrame, key: str = "email") -> DataFrame:
    """Existing rows plus the new ones whose key is not there yet.

    Among new rows sharing a key the smallest row is taken, so reruns agree.
    """
    rest = [column for column in new.columns if column != key]
    one_each = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    fresh = one_each.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*new.columns))
