"""Scans, look-ups, joins, aggregates and ordered groups over the entity views."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritlake import constants as K
from meritlake.functions.companies import parse_company_answers
from meritlake.functions.credits import application_status
from meritlake.functions.text import redact_for_output
from meritlake.operators import applications as A
from meritlake.operators import intake, lookups, ordered
from meritlake.operators import statistics as S
from meritlake.operators.nested import parse_workflow
from meritlake.operators.segments import newest_first
from meritlake.plans.catalog import day, query, sql_day, sql_strip, sql_text
from meritlake.plans.driver_views import EMAIL_DOMAIN
from meritlake.schemas import ENTITY_SCHEMAS
from meritlake.session import work_folder
from meritlake.sources.documents import read_text_documents, scan_document_inventory
from meritlake.sources.keyed_store import KeyedStore
from meritlake.sources.sorted_files import read_page, write_bucketed, write_clustered, write_ranked
from meritlake.sources.tables import list_view, read_entity, write_decision_records

STUDENT = 7
EMAIL = f"customer.000000007@{EMAIL_DOMAIN}"
CERTIFICATE = 12
DOCUMENTED_CERTIFICATE = 31  # has extra documents in every data folder
COMMENTED_CERTIFICATE = 8  # its decision has a comment in every data folder
REVIEWER = 3

# --- scans, sources, sinks ------------------------------------------------------------------


def _text_files(t) -> str:
    """The documents as text files, fifty a file, one text a line and files in folders ``batch=n``."""
    folder = work_folder(t.spark, "texts")
    lines = t.documents.select(F.translate("text", "\r\n", "  ").alias("text"), F.floor(F.col("doc_id") / 50).alias("batch"), "doc_id")
    (lines.repartition("batch").sortWithinPartitions("batch", "doc_id").drop("doc_id")
     .write.partitionBy("batch").text(folder))
    return folder


_BATCHES_SQL = """batches AS (
    SELECT doc_id // 50 AS batch, string_agg(translate(text, chr(13) || chr(10), '  ') || chr(10), '' ORDER BY doc_id) AS text
    FROM documents GROUP BY batch)"""


@query("scan_document_inventory", f"""
    WITH {_BATCHES_SQL} SELECT CAST(batch AS INTEGER) AS batch, strlen(text) AS size, 'txt' AS suffix FROM batches""")
def _(t):
    files = scan_document_inventory(t.spark, _text_files(t), ("txt",))
    return files.select(F.regexp_extract("path", "batch=([0-9]+)", 1).cast("int").alias("batch"), "size", "suffix")


@query("scan_text_documents", f"""
    WITH {_BATCHES_SQL} SELECT CAST(batch AS INTEGER) AS batch, text, CAST(length(text) AS INTEGER) AS text_length FROM batches""")
def _(t):
    files = read_text_documents(t.spark, _text_files(t))
    return files.select(F.regexp_extract("path", "batch=([0-9]+)", 1).cast("int").alias("batch"), "text",
                        F.length("text").alias("text_length"))


_W = "ai_workflow_json"


@query("scan_workflow_json", f"""
    SELECT certificate_id,
      json_extract_string({_W}, '$.extraction_results.results.employer') AS employer,
      json_extract_string({_W}, '$.evaluation_results.results.decision') AS decision,
      CAST(json_extract_string({_W}, '$.evaluation_results.results.total_working_hours') AS INTEGER) AS hours,
      CAST(json_extract_string({_W}, '$.evaluation_results.results.credits_qualified') AS DOUBLE) AS credits,
      CAST(json_array_length({_W}, '$.validation_results.results.issues_found') AS INTEGER) AS n_issues,
      json_extract_string({_W}, '$.validation_results.results.name_validation.match_result') AS match_result,
      coalesce(json_extract_string({_W}, '$.correction_results.success') = 'true', false) AS corrected
    FROM workflows""")
def _(t):
    w = t.workflows.select("certificate_id", parse_workflow(F.col(_W)).alias("w"))
    return w.select(
        "certificate_id",
        F.col("w.extraction_results.results.employer"),
        F.col("w.evaluation_results.results.decision"),
        F.col("w.evaluation_results.results.total_working_hours").alias("hours"),
        F.col("w.evaluation_results.results.credits_qualified").alias("credits"),
        F.size("w.validation_results.results.issues_found").alias("n_issues"),
        F.col("w.validation_results.results.name_validation.match_result").alias("match_result"),
        F.coalesce("w.correction_results.success", F.lit(False)).alias("corrected"),
    )


_IDS = {"students": "student_id", "certificates": "certificate_id", "decisions": "decision_id",
        "reviewers": "reviewer_id", "additional_documents": "document_id"}


@query("scan_entity_tables", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, CAST({row_id} AS VARCHAR) AS row_id FROM {name}"
    for name, row_id in _IDS.items()))
def _(t):
    """Entity files in the declared schemas, read without file bytes and texts."""
    out = None
    for name, row_id in _IDS.items():
        view, path = getattr(t, name), work_folder(t.spark, f"stored-{name}")
        declared = [part.strip().split(" ") for part in ENTITY_SCHEMAS[name].split(",")]
        view.select(*[F.col(column).cast(kind) if column in view.columns else F.lit(None).cast(kind).alias(column)
                      for column, kind in declared]).write.parquet(path)
        part = list_view(read_entity(t.spark, name, path)).select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("append_records", f"""
    SELECT sha256('{{"student_id":"' || CAST(student_id AS VARCHAR) || '","filename":"' || filename || '"}}') AS record_id, student_id,
      training_type, work_type, filename, filetype, {sql_day('uploaded_at')}
    FROM certificates""")
def _(t):
    """Stored twice: the second run finds every id there."""
    records = t.certificates.drop("certificate_id")
    store = KeyedStore(t.spark, work_folder(t.spark, "append-certificates"), "record_id",
                       T.StructType([T.StructField("record_id", T.StringType()), *records.schema]))
    for _ in range(2):
        intake.append_records(records, store, ["student_id", "filename"], "uploaded_at")
    return store.read().select(
        "record_id", "student_id", "training_type", "work_type", "filename", "filetype", day("uploaded_at"))


@query("seed_if_absent", """
    SELECT student_id, email, CASE WHEN degree = 'Business' THEN 'seeded' ELSE degree END AS degree FROM students""")
def _(t):
    students = t.students.select("student_id", "email", "degree")
    existing = students.where("degree <> 'Business'")
    return intake.seed_if_absent(existing, students.withColumn("degree", F.lit("seeded")))


_SUFFIX_SQL = "lower(regexp_extract(regexp_replace(filename, '^\\.+', ''), '\\.([^.]*)$', 1))"
_ALLOWED = ", ".join(sql_text(s) for s in K.UPLOAD_SUFFIXES)
_FILE_PROBLEM = f"""CASE WHEN filename IS NULL OR filename = '' THEN 'No filename provided'
      WHEN {_SUFFIX_SQL} = '' THEN 'File must have an extension'
      WHEN {_SUFFIX_SQL} NOT IN ({_ALLOWED}) THEN 'File type ' || {_SUFFIX_SQL} || ' not supported'
      WHEN size > {K.MAX_UPLOAD_BYTES} THEN 'File size too large. Maximum size is 10MB.'
      WHEN size = 0 THEN 'File is empty' END"""


@query("admit_uploads", f"""
    SELECT upload_id, CASE WHEN upper(training_type) NOT IN ('GENERAL', 'PROFESSIONAL') THEN 'Invalid training type'
        WHEN upper(work_type) NOT IN ('REGULAR', 'SELF_PACED') THEN 'Invalid work type'
        ELSE {_FILE_PROBLEM} END AS reject_reason,
      nullif({_SUFFIX_SQL}, '') AS filetype
    FROM uploads""")
def _(t):
    return intake.admit_uploads(t.uploads).select("upload_id", "reject_reason", "filetype")


@query("admit_additional_documents", f"""
    SELECT document_id, certificate_id, 'HOUR_DOCUMENTATION' AS document_type, {_SUFFIX_SQL} AS filetype
    FROM additional_documents
    WHERE {_FILE_PROBLEM} IS NULL
      AND certificate_id IN (SELECT certificate_id FROM certificates WHERE work_type = 'SELF_PACED')""")
def _(t):
    return intake.admit_additional_documents(t.additional_documents, t.certificates).select(
        "document_id", "certificate_id", "document_type", "filetype")


@query("write_decision_records", f"""
    SELECT decision_id, ai_decision, total_working_hours, credits_awarded, {sql_day('created_at')},
      strftime(created_at, '%Y-%m') AS decision_month, ai_workflow_json
    FROM decisions""")
def _(t):
    path = work_folder(t.spark, "decision-records")
    write_decision_records(t.decisions, path)
    return t.spark.read.parquet(path).select(
        "decision_id", "ai_decision", "total_working_hours", "credits_awarded", day("created_at"),
        F.col("decision_month").cast("string").alias("decision_month"), "ai_workflow_json")


# --- look-ups ---------------------------------------------------------------------------------
_STUDENT_SQL = "SELECT student_id, email, degree, first_name, last_name FROM students WHERE "


@query("student_by_email", f"{_STUDENT_SQL} email = '{EMAIL}'")
def _(t):
    return lookups.student_by_email(t.students, EMAIL)


@query("student_by_id", f"{_STUDENT_SQL} student_id = {STUDENT}")
def _(t):
    return lookups.student_by_id(t.students, STUDENT)


_CERT_SQL = ("SELECT certificate_id, student_id, training_type, work_type, filename, filetype, "
             f"{sql_day('uploaded_at')} FROM certificates WHERE ")


def _dated(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@query("certificate_by_id", f"{_CERT_SQL} certificate_id = {CERTIFICATE}")
def _(t):
    return _dated(lookups.certificate_by_id(t.certificates, CERTIFICATE), "uploaded_at")


@query("certificates_of_student", f"{_CERT_SQL} student_id = {STUDENT} ORDER BY uploaded_at DESC")
def _(t):
    return _dated(lookups.certificates_of_student(t.certificates, STUDENT), "uploaded_at")


_DECISION_COLUMNS = ("decision_id", "certificate_id", "ai_justification", "ai_decision",
                     "student_comment", "reviewer_id", "reviewer_decision", "reviewer_comment",
                     "total_working_hours", "credits_awarded", "training_duration",
                     "training_institution", "degree_relevance", "supporting_evidence",
                     "challenging_evidence", "recommendation")
_DECISION_SQL = ", ".join(_DECISION_COLUMNS)


@query("decision_by_id", f"""
    SELECT {_DECISION_SQL}, {sql_day('created_at')}, {sql_day('reviewed_at')} FROM decisions
    WHERE decision_id = 'D{CERTIFICATE}'""")
def _(t):
    return lookups.decision_by_id(t.decisions, f"D{CERTIFICATE}").select(
        *_DECISION_COLUMNS, day("created_at"), day("reviewed_at"))


def _page_sql(skip: int) -> str:
    return f"""
    SELECT {_DECISION_SQL}, strftime(created_at, '%Y-%m-%d') AS created_day FROM decisions
    ORDER BY created_at DESC NULLS FIRST, decision_id LIMIT 100 OFFSET {skip}"""


@query("decisions_page_ranked", _page_sql(400))
def _(t):
    """The same from stored rows with a rank index: a page reads the folders its ranks lie in."""
    path, order = work_folder(t.spark, "ranked-decisions"), {"newest": newest_first("created_at"), "by_id": F.col("decision_id")}
    write_ranked(t.decisions, path, order, step=200)
    return read_page(t.spark, path, t.decisions.schema, list(order), 400, 100, step=200).select(
        *_DECISION_COLUMNS, day("created_at").alias("created_day"))


@query("clustered_lookups", f"""
    SELECT 'student by email' AS kind, CAST(student_id AS VARCHAR) AS row_id FROM students WHERE email = '{EMAIL}'
    UNION ALL SELECT 'student by id', CAST(student_id AS VARCHAR) FROM students WHERE student_id = {STUDENT}
    UNION ALL SELECT 'certificate by id', CAST(certificate_id AS VARCHAR) FROM certificates WHERE certificate_id = {CERTIFICATE}
    UNION ALL SELECT 'certificates of student', CAST(certificate_id AS VARCHAR) FROM certificates WHERE student_id = {STUDENT}
    UNION ALL SELECT 'decision by id', decision_id FROM decisions WHERE decision_id = 'D{CERTIFICATE}'
    UNION ALL SELECT 'additional documents', document_id FROM additional_documents WHERE certificate_id = {DOCUMENTED_CERTIFICATE}
    UNION ALL SELECT 'student comment', student_comment FROM decisions
      WHERE certificate_id = {COMMENTED_CERTIFICATE} AND student_comment IS NOT NULL""")
def _(t):
    """Look-ups on stored tables: sorted by one key, with Bloom filters for the others."""
    def stored(name: str, key: str, *blooms: str):
        path = work_folder(t.spark, f"clustered-{name}")
        table = getattr(t, name)
        write_clustered(table, path, key, blooms)
        return t.spark.read.schema(table.schema).parquet(path)

    students, certificates = stored("students", "student_id", "email"), stored("certificates", "student_id", "certificate_id")
    decisions, documents = stored("decisions", "certificate_id", "decision_id"), stored("additional_documents", "certificate_id")
    found = {
        "student by email": lookups.student_by_email(students, EMAIL).select("student_id"),
        "student by id": lookups.student_by_id(students, STUDENT).select("student_id"),
        "certificate by id": lookups.certificate_by_id(certificates, CERTIFICATE).select("certificate_id"),
        "certificates of student": lookups.certificates_of_student(certificates, STUDENT).select("certificate_id"),
        "decision by id": lookups.decision_by_id(decisions, f"D{CERTIFICATE}").select("decision_id"),
        "additional documents": lookups.additional_documents_of(documents, DOCUMENTED_CERTIFICATE).select("document_id"),
        "student comment": lookups.student_comment_of(decisions, COMMENTED_CERTIFICATE).select("student_comment")}
    return reduce(DataFrame.unionByName, [
        rows.select(F.lit(kind).alias("kind"), F.col(rows.columns[0]).cast("string").alias("row_id")) for kind, rows in found.items()])


@query("decisions_page", _page_sql(200))
def _(t):
    return lookups.decisions_page(t.decisions, 200, 100).select(
        *_DECISION_COLUMNS, day("created_at").alias("created_day"))


@query("reviewer_by_email", "SELECT * FROM reviewers WHERE email = 'supplier.000000004@staff.example.org'")
def _(t):
    return lookups.reviewer_by_email(t.reviewers, "supplier.000000004@staff.example.org")


@query("all_reviewers", """
    SELECT * FROM reviewers ORDER BY first_name NULLS LAST, last_name NULLS LAST, reviewer_id""")
def _(t):
    return lookups.all_reviewers(t.reviewers)


@query("additional_documents_of", f"""
    SELECT document_id, document_type, filename, filetype, ocr_output, strftime(uploaded_at, '%Y-%m-%d') AS uploaded_day
    FROM additional_documents WHERE certificate_id = {DOCUMENTED_CERTIFICATE} ORDER BY uploaded_at, document_id""")
def _(t):
    return lookups.additional_documents_of(t.additional_documents, DOCUMENTED_CERTIFICATE).select(
        "document_id", "document_type", "filename", "filetype", "ocr_output",
        day("uploaded_at").alias("uploaded_day"))


@query("student_comment_of", f"""
    SELECT certificate_id, student_comment FROM decisions
    WHERE certificate_id = {COMMENTED_CERTIFICATE} AND student_comment IS NOT NULL""")
def _(t):
    return lookups.student_comment_of(t.decisions, COMMENTED_CERTIFICATE)


@query("redact_for_output", """
    SELECT doc_id, lang, '[' || CAST(length(text) AS VARCHAR) || ' characters]' AS extracted_text FROM documents""")
def _(t):
    ocr = t.documents.select("doc_id", F.struct("lang", F.col("text").alias("extracted_text")).alias("ocr"))
    return ocr.select("doc_id", redact_for_output(F.col("ocr")).alias("ocr")).select("doc_id", "ocr.*")


# --- joins --------------------------------------------------------------------------------------
_TITLE_SQL = ("array_to_string(list_transform(regexp_extract_all(replace(split_part(email, '@', 1), '.', ' '), "
              "'(\\p{L}+|[^\\p{L}]+)', 1), lambda w: upper(w[1]) || lower(w[2:])), '')")
_SUMMARY_SQL = f"""
    SELECT decision_id, certificate_id, {_TITLE_SQL} AS student_name, email AS student_email,
      degree AS student_degree, filename, training_type, ai_decision, reviewer_decision,
      strftime(uploaded_at, '%Y-%m-%d') AS uploaded_day, strftime(created_at, '%Y-%m-%d') AS created_day, student_comment
    FROM decisions JOIN certificates USING (certificate_id) JOIN students USING (student_id)"""


def _summary(df):
    return df.withColumns({"uploaded_day": day("uploaded_at"), "created_day": day("created_at")}).drop(
        "uploaded_at", "created_at")


@query("pending_applications", f"{_SUMMARY_SQL} WHERE reviewer_decision IS NULL ORDER BY created_at DESC")
def _(t):
    return _summary(A.pending_applications(t.decisions, t.certificates, t.students))


@query("pending_applications_bucketed", f"{_SUMMARY_SQL} WHERE reviewer_decision IS NULL ORDER BY created_at DESC")
def _(t):
    """The same on tables stored in buckets of the certificate: they meet without a shuffle."""
    tables = [write_bucketed(getattr(t, name), f"{name}_{uuid.uuid4().hex}", work_folder(t.spark, f"bucketed-{name}"),
                             "certificate_id", 16) for name in ("decisions", "certificates")]
    return _summary(A.pending_applications(*tables, t.students))


@query("applications_by_review_status", f"{_SUMMARY_SQL} WHERE reviewer_decision = 'PASS' ORDER BY created_at DESC")
def _(t):
    return _summary(A.applications_by_review_status(t.decisions, t.certificates, t.students, "PASS"))


_STATUS_SQL = """CASE WHEN coalesce(ai_decision, '') = '' THEN 'PENDING'
      WHEN reviewer_id IS NOT NULL AND coalesce(reviewer_decision, '') = '' THEN 'PENDING_FOR_APPROVAL'
      WHEN reviewer_id IS NULL AND ai_decision IN ('ACCEPTED', 'REJECTED') THEN 'AI_PROCESSED_NOT_SENT'
      ELSE ai_decision END"""
_DISPLAY_SQL = "nullif(concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')), '')"


_APPLICATIONS_SQL = f"""
    WITH docs AS (SELECT certificate_id, string_agg(document_id, ',' ORDER BY uploaded_at, document_id) AS ids
      FROM additional_documents GROUP BY certificate_id)
    SELECT c.student_id, c.certificate_id, c.training_type, c.work_type, {_STATUS_SQL} AS status,
      coalesce(credits_awarded, 0) AS credits, credits_awarded, {_DISPLAY_SQL} AS reviewer_name,
      strftime(c.uploaded_at, '%Y-%m-%d') AS submitted_day, strftime(created_at, '%Y-%m-%d') AS decision_day,
      ai_justification, reviewer_decision, total_working_hours, student_comment,
      CASE WHEN c.work_type = 'SELF_PACED' THEN coalesce(docs.ids, '') ELSE '' END AS document_ids
    FROM certificates AS c LEFT JOIN decisions USING (certificate_id) LEFT JOIN reviewers USING (reviewer_id)
      LEFT JOIN docs USING (certificate_id)"""


def _applications(rows):
    return rows.select(
        "student_id", "certificate_id", "training_type", "work_type", "status", "credits",
        "credits_awarded", "reviewer_name", day("uploaded_at").alias("submitted_day"),
        day("created_at").alias("decision_day"), "ai_justification", "reviewer_decision",
        "total_working_hours", "student_comment",
        F.array_join(F.transform("additional_documents", lambda d: d["document_id"]), ",").alias("document_ids"))


@query("student_applications", _APPLICATIONS_SQL)
def _(t):
    return _applications(A.student_applications(t.certificates, t.decisions, t.reviewers, t.additional_documents))


@query("student_applications_by_email", f"{_APPLICATIONS_SQL} WHERE student_id = (SELECT student_id FROM students WHERE email = '{EMAIL}')")
def _(t):
    return _applications(A.student_applications(
        t.certificates, t.decisions, t.reviewers, t.additional_documents, students=t.students, email=EMAIL))


def _owned_sql(which: str = "true") -> str:
    return f"""
    SELECT student_id, any_value(email) AS email, CAST(count(certificate_id) AS INTEGER) AS n_certificates,
      coalesce(string_agg(CAST(certificate_id AS VARCHAR) || ':' || training_type, ','
        ORDER BY uploaded_at DESC, certificate_id), '') AS certificates
    FROM students LEFT JOIN certificates USING (student_id) WHERE {which} GROUP BY student_id"""


def _owned(rows):
    return rows.select(
        "student_id", "email", F.size("certificates").alias("n_certificates"),
        F.array_join(F.transform("certificates", lambda c: F.concat(
            c["certificate_id"].cast("string"), F.lit(":"), c["training_type"])), ",").alias("certificates"))


@query("student_with_certificates", _owned_sql())
def _(t):
    return _owned(A.student_with_certificates(t.students, t.certificates))


@query("student_with_certificates_by_email", _owned_sql(f"email = '{EMAIL}'"))
def _(t):
    return _owned(A.student_with_certificates(t.students, t.certificates, email=EMAIL))


@query("student_with_certificates_by_id", _owned_sql(f"student_id = {STUDENT}"))
def _(t):
    return _owned(A.student_with_certificates(t.students, t.certificates, student_id=STUDENT))


_DETAILED_SQL = """
    WITH docs AS (SELECT certificate_id, count(*) AS n,
        string_agg(filename, ',' ORDER BY uploaded_at, document_id) AS names
      FROM additional_documents GROUP BY certificate_id)
    SELECT certificate_id, decision_id, ai_decision, filename, email, degree,
      CAST(coalesce(n, 0) AS INTEGER) AS n_documents, coalesce(names, '') AS document_names
    FROM decisions JOIN certificates USING (certificate_id) JOIN students USING (student_id)
      LEFT JOIN docs USING (certificate_id)"""


def _detailed(rows):
    return rows.select(
        "certificate_id", "decision.decision_id", "decision.ai_decision", "certificate.filename",
        "student.email", "student.degree", F.size("additional_documents").alias("n_documents"),
        F.array_join(F.transform("additional_documents", lambda d: d["filename"]), ",").alias("document_names"))


@query("detailed_application", _DETAILED_SQL)
def _(t):
    return _detailed(A.detailed_application(t.decisions, t.certificates, t.students, t.additional_documents))


@query("detailed_application_by_id", f"{_DETAILED_SQL} WHERE certificate_id = {DOCUMENTED_CERTIFICATE}")
def _(t):
    return _detailed(A.detailed_application(
        t.decisions, t.certificates, t.students, t.additional_documents, certificate_id=DOCUMENTED_CERTIFICATE))


@query("reviewer_worklist", """
    SELECT reviewer_id, decision_id, certificate_id, student_id, ai_decision, training_type, filename,
      filetype, email, degree, first_name, last_name, strftime(created_at, '%Y-%m-%d') AS created_day
    FROM decisions JOIN certificates USING (certificate_id) JOIN students USING (student_id)
    WHERE reviewer_id IS NOT NULL""")
def _(t):
    return A.reviewer_worklist(t.decisions, t.certificates, t.students).select(
        "reviewer_id", "decision_id", "certificate_id", "student_id", "ai_decision", "training_type",
        "filename", "filetype", "email", "degree", "first_name", "last_name",
        day("created_at").alias("created_day"))


_FULL_NAME_SQL = (f"coalesce(nullif(concat_ws(' ', nullif({sql_strip('first_name')}, ''), "
                  f"nullif({sql_strip('last_name')}, '')), ''), 'Unknown')")


@query("student_identity_by_certificate", f"""
    SELECT certificate_id, coalesce(first_name, '') AS first_name, coalesce(last_name, '') AS last_name,
      email, {_FULL_NAME_SQL} AS full_name
    FROM certificates JOIN students USING (student_id)""")
def _(t):
    return A.student_identity_by_certificate(t.certificates, t.students)


def _dangling(key: str, every: int) -> str:
    """A foreign key of which one certificate in ``every`` points nowhere; ids are never negative."""
    return f"CASE WHEN certificate_id % {every} = 0 THEN -1 - {key} ELSE {key} END"


@query("orphan_report", f"""
    WITH owned AS (SELECT certificate_id, {_dangling('student_id', 11)} AS student_id FROM certificates),
      decided AS (SELECT decision_id, {_dangling('certificate_id', 13)} AS certificate_id,
        {_dangling('reviewer_id', 17)} AS reviewer_id FROM decisions),
      attached AS (SELECT document_id, {_dangling('certificate_id', 19)} AS certificate_id FROM additional_documents)
    SELECT 'certificates' AS child_table, 'student_id' AS key_column, CAST(certificate_id AS VARCHAR) AS row_id,
      CAST(student_id AS VARCHAR) AS key_value
    FROM owned WHERE student_id NOT IN (SELECT student_id FROM students)
    UNION ALL SELECT 'decisions', 'certificate_id', decision_id, CAST(certificate_id AS VARCHAR)
    FROM decided WHERE certificate_id NOT IN (SELECT certificate_id FROM certificates)
    UNION ALL SELECT 'decisions', 'reviewer_id', decision_id, CAST(reviewer_id AS VARCHAR) FROM decided
    WHERE reviewer_id IS NOT NULL AND reviewer_id NOT IN (SELECT reviewer_id FROM reviewers)
    UNION ALL SELECT 'additional_documents', 'certificate_id', document_id, CAST(certificate_id AS VARCHAR)
    FROM attached WHERE certificate_id NOT IN (SELECT certificate_id FROM certificates)""")
def _(t):
    """Whole tables; the given keys have no orphans, so some are made to point nowhere."""
    decided = t.decisions.select(
        "decision_id", F.expr(_dangling("certificate_id", 13)).alias("certificate_id"),
        F.expr(_dangling("reviewer_id", 17)).alias("reviewer_id"))
    return A.orphan_report(
        t.students, t.certificates.withColumn("student_id", F.expr(_dangling("student_id", 11))), decided, t.reviewers,
        t.additional_documents.withColumn("certificate_id", F.expr(_dangling("certificate_id", 19))))


@query("unprocessed_certificates", """
    SELECT certificate_id, student_id, training_type FROM certificates
    WHERE certificate_id NOT IN (SELECT certificate_id FROM decisions)""")
def _(t):
    return A.unprocessed_certificates(t.certificates, t.decisions).select(
        "certificate_id", "student_id", "training_type")


@query("certificate_status", """
    SELECT certificate_id, CASE WHEN decision_id IS NULL THEN 'processing' ELSE 'completed' END AS status,
      ai_decision, ai_justification, total_working_hours, credits_awarded, training_duration, training_institution
    FROM certificates LEFT JOIN decisions USING (certificate_id)""")
def _(t):
    return A.certificate_status(t.certificates, t.decisions)


# --- aggregates ------------------------------------------------------------------------------------


@query("statistics", """
    SELECT 'total_students' AS metric, NULL::VARCHAR AS key, count(*) AS n FROM students
    UNION ALL SELECT 'total_certificates', NULL, count(*) FROM certificates
    UNION ALL SELECT 'total_decisions', NULL, count(*) FROM decisions
    UNION ALL SELECT 'ai_decision', ai_decision, count(*) FROM decisions GROUP BY ai_decision
    UNION ALL SELECT 'reviewer_decision', reviewer_decision, count(*) FROM decisions GROUP BY reviewer_decision
    UNION ALL SELECT 'training_type', training_type, count(*) FROM certificates GROUP BY training_type""")
def _(t):
    return S.statistics(t.students, t.certificates, t.decisions)


@query("certificate_counts_by_type", """
    SELECT student_id, count(*) FILTER (training_type = 'GENERAL') AS general,
      count(*) FILTER (training_type = 'PROFESSIONAL') AS professional
    FROM students LEFT JOIN certificates USING (student_id) GROUP BY student_id""")
def _(t):
    return S.certificate_counts_by_type(t.students, t.certificates)


@query("certificate_limits", f"""
    WITH counts AS (SELECT student_id, count(*) FILTER (training_type = 'GENERAL') AS g,
        count(*) FILTER (training_type = 'PROFESSIONAL') AS p
      FROM students LEFT JOIN certificates USING (student_id) GROUP BY student_id)
    SELECT student_id, 'GENERAL' AS training_type, g < 1 AS is_allowed,
      CASE WHEN g >= 1 THEN {sql_text(K.LIMIT_MESSAGES['GENERAL'])} ELSE '' END AS message FROM counts
    UNION ALL SELECT student_id, 'PROFESSIONAL', p < 2,
      CASE WHEN p >= 2 THEN {sql_text(K.LIMIT_MESSAGES['PROFESSIONAL'])} ELSE '' END FROM counts""")
def _(t):
    return S.certificate_limits(t.students, t.certificates)


_RESULTS_SQL = """WITH results AS (SELECT doc_id, source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS file_path,
      'doc_' || CAST(doc_id AS VARCHAR) AS file_name, doc_id % 17 <> 3 AS success,
      CASE WHEN doc_id % 17 <> 3 THEN length(text) ELSE 0 END AS text_length,
      CASE WHEN doc_id % 17 <> 3 THEN length(text) - length(translate(lower(text), 'äöå', '')) ELSE 0 END
        AS finnish_chars_count,
      CASE WHEN doc_id % 17 = 3 THEN NULL WHEN regexp_matches(lower(text), '[äöå]') THEN 'fin' ELSE 'eng' END
        AS detected_language
      FROM texts)"""


def _results(t):
    """Document results where one document in seventeen could not be read."""
    ok = F.col("doc_id") % 17 != 3
    text = F.col("text")
    letters = F.length(text) - F.length(F.translate(F.lower(text), K.FINNISH_LETTERS, ""))
    return t.texts.select(
        F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("file_path"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file_name"),
        ok.alias("success"), F.when(~ok, F.lit("unreadable")).alias("error"),
        F.when(ok, F.length(text)).otherwise(F.lit(0)).alias("text_length"),
        F.when(ok, letters).otherwise(F.lit(0)).alias("finnish_chars_count"),
        F.when(ok, F.when(letters > 0, F.lit("fin")).otherwise(F.lit("eng"))).alias("detected_language"))


@query("batch_summary", f"""
    {_RESULTS_SQL}
    SELECT count(*) AS total_files, count(*) FILTER (success) AS successful_files,
      count(*) FILTER (NOT success) AS failed_files,
      CAST(round_even(count(*) FILTER (success) * 100.0 / count(*), 1) AS DOUBLE) AS success_rate,
      count(*) FILTER (detected_language = 'fin') AS finnish_files,
      count(*) FILTER (detected_language = 'eng') AS english_files,
      CAST(sum(text_length) AS BIGINT) AS total_characters,
      CAST(round_even(sum(text_length) * 1.0 / count(*), 1) AS DOUBLE) AS average_characters
    FROM results""", heavy=True)
def _(t):
    return S.batch_summary(_results(t))


@query("finnish_summary", f"""
    {_RESULTS_SQL},
    fin AS (SELECT * FROM results WHERE success AND (finnish_chars_count > 0 OR detected_language = 'fin'))
    SELECT 'finnish_documents' AS section, NULL::VARCHAR AS item, count(*) AS n FROM fin
    UNION ALL SELECT 'finnish_characters', NULL, CAST(sum(finnish_chars_count) AS BIGINT) FROM results WHERE success
    UNION ALL (SELECT 'finnish_file', file_name, finnish_chars_count FROM fin ORDER BY file_path LIMIT 5)
    UNION ALL SELECT 'failed', file_path || ': unreadable', NULL FROM results WHERE NOT success""", heavy=True)
def _(t):
    return S.finnish_summary(_results(t))


@query("table_health", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, true AS present, count(*) AS row_count FROM {name}" for name in _IDS
) + " UNION ALL SELECT 'audit_log', false, NULL")
def _(t):
    return S.table_health({**{name: getattr(t, name) for name in _IDS}, "audit_log": None})


def _columns_of(view: str) -> list[str]:
    return [part.strip().rsplit(" ", 1)[0] for part in _VIEW_COLUMNS[view].split(",")]


# The views' columns and types in Spark's names, as the report has to show them.
_VIEW_COLUMNS = {
    "students": "student_id bigint, email string, degree string, first_name string, last_name string",
    "certificates": "certificate_id bigint, student_id bigint, training_type string, work_type string, filename string, "
                    "filetype string, uploaded_at timestamp",
    "reviewers": "reviewer_id bigint, email string, first_name string, last_name string, position string, department string",
    "additional_documents": "document_id string, certificate_id bigint, document_type string, filename string, filetype string, "
                            "ocr_output string, hours int, size bigint, uploaded_at timestamp",
    "decisions": "decision_id string, certificate_id bigint, ai_justification string, ai_decision string, created_at timestamp, "
                 "student_comment string, reviewer_id bigint, reviewer_decision string, reviewer_comment string, reviewed_at timestamp, "
                 "total_working_hours int, credits_awarded int, training_duration string, training_institution string, "
                 "degree_relevance string, supporting_evidence string, challenging_evidence string, recommendation string, "
                 "ai_workflow_json string, company_validation_status string, company_validation_justification string, "
                 "name_validation_match_result string, name_validation_explanation string"}


def _fill_sql(view: str) -> str:
    lines = []
    for place, part in enumerate(_VIEW_COLUMNS[view].split(","), 1):
        name, kind = part.split()
        lines.append(f"SELECT '{view}' AS table_name, '{name}' AS column_name, '{kind}' AS data_type, "
                     f"CAST({place} AS INTEGER) AS ordinal, count(*) AS n_rows, count({name}) AS n_filled FROM {view}")
    return " UNION ALL ".join(lines)


@query("schema_report", " UNION ALL ".join(_fill_sql(view) for view in _IDS))
def _(t):
    tables = {name: getattr(t, name) for name in _IDS}
    return S.schema_report(tables).join(S.column_fill(tables), ["table_name", "column_name"]).drop("nullable")


@query("write_observed", " UNION ALL ".join(
    f"SELECT 'decisions' AS table_name, count(*) AS row_count, '{name}' AS column_name, count({name}) AS n_filled, "
    "CAST(NULL AS VARCHAR) AS problem, CAST(NULL AS BIGINT) AS n_broken FROM decisions" for name in _columns_of("decisions")))
def _(t):
    """Figures of the decisions, gathered while they are written."""
    return S.write_observed(t.decisions, work_folder(t.spark, "observed-decisions"), "decisions")


def verdicts(t):
    return parse_company_answers(t.verdict_answers, "answer")


_BAD_SQL = "json_extract_string(answer, '$.status') IN ('NOT_LEGITIMATE', 'UNVERIFIED')"


@query("company_rollup", f"""
    WITH judged AS (SELECT certificate_id, p.employer, coalesce(p.employer, '') <> '' AS named,
        coalesce({_BAD_SQL}, false) AS bad
      FROM positions AS p LEFT JOIN verdict_answers AS v ON p.employer = v.employer),
    per AS (SELECT certificate_id, count(*) AS n, count(*) FILTER (named) AS checked,
        count(*) FILTER (named AND bad) AS bad FROM judged GROUP BY certificate_id)
    SELECT certificate_id, CASE WHEN coalesce(n, 0) = 0 THEN 'UNVERIFIED' WHEN bad = 0 THEN 'LEGITIMATE'
        WHEN bad = checked THEN 'NOT_LEGITIMATE' ELSE 'PARTIALLY_LEGITIMATE' END AS status,
      coalesce(checked, 0) AS companies_checked, coalesce(bad, 0) AS bad_companies,
      coalesce(bad, 0) = 0 AS validation_passed
    FROM certificates LEFT JOIN per USING (certificate_id)""")
def _(t):
    return S.company_rollup(t.certificates, t.positions, verdicts(t))


@query("company_issues", f"""
    SELECT certificate_id, 'company_validation_error' AS type,
      CASE json_extract_string(answer, '$.status') WHEN 'UNVERIFIED' THEN 'medium' ELSE 'high' END AS severity,
      CASE json_extract_string(answer, '$.status') WHEN 'UNVERIFIED' THEN 'Company could not be verified: '
        ELSE 'Suspicious company detected: ' END || employer AS description,
      'company_validation' AS field_affected,
      CASE json_extract_string(answer, '$.status') WHEN 'UNVERIFIED'
        THEN 'Manual verification required for company ''' || employer || ''''
        ELSE 'Review company ''' || employer || ''' for legitimacy' END AS suggestion
    FROM positions JOIN verdict_answers USING (employer) WHERE {_BAD_SQL}""")
def _(t):
    return S.company_issues(t.positions, verdicts(t)).drop("position_index")


@query("employment_totals", f"""
    WITH totals AS (SELECT certificate_id, CAST(coalesce(sum(date_diff('day', start_date, end_date)), 0) AS BIGINT)
      AS total_employment_days FROM positions GROUP BY certificate_id)
    SELECT certificate_id, total_employment_days,
      round(CASE WHEN total_employment_days > 0 THEN total_employment_days / {K.DAYS_PER_YEAR}::DOUBLE
        ELSE 0 END, 6) AS total_employment_years FROM totals""")
def _(t):
    return S.employment_totals(t.positions).withColumn(
        "total_employment_years", F.round("total_employment_years", 6))


@query("employer_consistency", """
    SELECT certificate_id, count(*) AS n_positions, count(*) FILTER (employer IS NULL) AS n_null_employers,
      count(*) >= 2 AND count(DISTINCT nullif(employer, '')) > 1 AND count(*) FILTER (employer IS NULL) > 0
        AS inconsistent
    FROM positions GROUP BY certificate_id""")
def _(t):
    return S.employer_consistency(t.positions)


_DOCS_SQL = """docs AS (SELECT conv_id AS certificate_id, role AS document_type,
      'turn_' || CAST(turn AS VARCHAR) AS filename, text AS ocr_text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i
      FROM conversations WHERE turn > 0),
    main AS (SELECT conv_id AS certificate_id, text FROM conversations WHERE turn = 0)"""


def _conversations(t):
    conversations = t.conversations
    main = conversations.where("turn = 0").select(F.col("conv_id").alias("certificate_id"), "text")
    docs = conversations.where("turn > 0").select(
        F.col("conv_id").alias("certificate_id"), "turn", F.col("role").alias("document_type"),
        F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("filename"),
        F.col("text").alias("ocr_text"))
    return main, docs


@query("combine_documents", f"""
    WITH {_DOCS_SQL},
    whole AS (SELECT certificate_id, string_agg('ADDITIONAL DOCUMENT ' || CAST(i AS VARCHAR)
        || ' (' || document_type || ' - ' || filename || '):' || chr(10) || ocr_text || chr(10) || chr(10), '' ORDER BY i) AS body
      FROM docs GROUP BY certificate_id)
    SELECT certificate_id, 'MAIN CERTIFICATE:' || chr(10) || text || chr(10) || chr(10) || coalesce(body, '') AS combined_text
    FROM main LEFT JOIN whole USING (certificate_id)""")
def _(t):
    main, docs = _conversations(t)
    return S.combine_documents(main, docs, ["turn"])


@query("additional_doc_digest", f"""
    WITH {_DOCS_SQL},
    whole AS (SELECT certificate_id, string_agg(chr(10) || 'Additional Document ' || CAST(i AS VARCHAR)
        || ':' || chr(10) || '- Filename: ' || filename || chr(10) || '- Type: ' || document_type || chr(10)
        || '- Content: ' || substr(ocr_text, 1, 500) || CASE WHEN length(ocr_text) > 500 THEN '...' ELSE '' END
        || chr(10), chr(10) ORDER BY i) AS body
      FROM docs GROUP BY certificate_id)
    SELECT certificate_id, coalesce(body, 'No additional documents provided.') AS digest
    FROM main LEFT JOIN whole USING (certificate_id)""")
def _(t):
    main, docs = _conversations(t)
    return S.additional_doc_digest(main, docs, ["turn"])


# --- ordered groups ------------------------------------------------------------------------------------
GAP = 700


@query("timeline_check", f"""
    WITH lagged AS (SELECT *, lag(end_date) OVER (PARTITION BY certificate_id
        ORDER BY start_date, line, part_id, supplier_id) AS prev FROM positions)
    SELECT certificate_id, line, part_id, supplier_id, {sql_day('start_date')},
      CAST(date_diff('day', prev, start_date) AS INTEGER) AS gap_days,
      coalesce(prev > start_date, false) AS overlaps,
      coalesce(date_diff('day', prev, start_date) > {GAP}, false) AS large_gap
    FROM lagged""")
def _(t):
    return ordered.timeline_check(t.positions, ["line", "part_id", "supplier_id"], GAP).select(
        "certificate_id", "line", "part_id", "supplier_id", day("start_date"), "gap_days", "overlaps", "large_gap")


@query("best_text_attempt", """
    WITH attempts AS (SELECT source, doc_id AS attempt, text,
        (length(text) - length(translate(lower(text), 'äöå', ''))) * 10 + length(text) AS score
      FROM documents WHERE length(text) > 0)
    SELECT source, attempt, CAST(score AS INTEGER) AS score, text FROM (SELECT *, row_number() OVER (PARTITION BY source
      ORDER BY (attempt = 0 AND length(text) > 400) DESC, score DESC, attempt) AS rn FROM attempts) WHERE rn = 1""", heavy=True)
def _(t):
    attempts = t.documents.select("source", F.col("doc_id").alias("attempt"), "text")
    return ordered.best_text_attempt(attempts, "source")


@query("latest_decision", """
    SELECT certificate_id, decision_id, created_day, hours FROM (
      SELECT l_orderkey AS certificate_id, CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-'
          || CAST(l_suppkey AS VARCHAR) AS decision_id, strftime(l_shipdate, '%Y-%m-%d') AS created_day,
        CAST(l_quantity AS INTEGER) AS hours, l_shipdate
      FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY certificate_id ORDER BY l_shipdate DESC, decision_id DESC) = 1""")
def _(t):
    attempts = t.lineitem.select(
        F.col("l_orderkey").alias("certificate_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("decision_id"),
        F.col("l_shipdate").alias("created_at"), F.col("l_quantity").cast("int").alias("hours"))
    return ordered.latest_decision(attempts, ["hours"]).select(
        "certificate_id", "decision_id", day("created_at").alias("created_day"), "hours")


_FIRST_REVIEWER_SQL = ("(SELECT reviewer_id FROM reviewers ORDER BY first_name NULLS LAST, "
                       "last_name NULLS LAST, reviewer_id LIMIT 1)")


@query("first_reviewer_default", f"""
    SELECT action_id, certificate_id, coalesce(reviewer_id, {_FIRST_REVIEWER_SQL}) AS assigned_reviewer_id
    FROM actions WHERE event_type = 'signup'""")
def _(t):
    appeals = t.actions.where("event_type = 'signup'")
    return ordered.first_reviewer_default(appeals, t.reviewers).select(
        "action_id", "certificate_id", "assigned_reviewer_id")


@query("application_status", f"""
    SELECT certificate_id, {_STATUS_SQL} AS status FROM certificates LEFT JOIN decisions USING (certificate_id)""")
def _(t):
    return t.certificates.join(t.decisions, "certificate_id", "left").select(
        "certificate_id", application_status(
            F.col("ai_decision"), F.col("reviewer_id"), F.col("reviewer_decision")).alias("status"))
