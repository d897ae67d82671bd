"""Text, name, date and credit columns over documents and entity views."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions import credits as C
from meritlake.functions import dates as D
from meritlake.functions import names as N
from meritlake.functions import text as T
from meritlake.operators.degrees import degree_catalogue, with_guidelines
from meritlake.plans.catalog import (
    PROGRAMMES_SQL, SQL_WHITE, day, keyword_table, query, sql_day, sql_lines, sql_strip, sql_text)
from meritlake.plans.driver_views import EMAIL_DOMAIN

AS_OF = "2000-06-30"

# --- text -------------------------------------------------------------------------------------


@query("clean_text", f"SELECT doc_id, {sql_lines('text', K.LINE_BREAK_CLASS, 1)} AS cleaned FROM texts", heavy=True)
def _(t):
    return t.texts.select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query("clean_ocr_text", f"SELECT doc_id, {sql_lines('text', chr(92) + 'n', 3)} AS cleaned FROM texts", heavy=True)
def _(t):
    return t.texts.select("doc_id", T.clean_ocr_text(F.col("text")).alias("cleaned"))


_PLAIN_SQL = ("replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), "
              "chr(13) || chr(10), chr(10)), chr(13), chr(10))")
SANITIZED_SQL = sql_lines(f"regexp_replace({_PLAIN_SQL}, ' +', ' ', 'g')", chr(92) + "n", 1)


@query("sanitize_text", f"""
    WITH plain AS (SELECT doc_id, {SANITIZED_SQL} AS s FROM texts)
    SELECT doc_id, {sql_strip(f"CASE WHEN length(s) > {K.PROMPT_TEXT_LIMIT} THEN substr(s, 1, {K.PROMPT_TEXT_LIMIT}) || chr(10) || chr(10) || '[Text truncated due to length]' ELSE s END")} AS sanitized
    FROM plain""", heavy=True)
def _(t):
    return t.texts.select("doc_id", T.sanitize_text(F.col("text")).alias("sanitized"))


INPUT_SQL = f"""CASE WHEN text IS NULL THEN 'Invalid text input: <class ''NoneType''>'
      WHEN text = '' THEN 'Invalid text input: <class ''str''>'
      WHEN length(text) < 10 OR {sql_strip('text')} = '' THEN 'Text too short or empty'
      WHEN starts_with({sql_strip('text')}, '"') OR starts_with({sql_strip('text')}, '{{')
        THEN 'Text appears to be JSON, not document content' END"""


@query("input_problem", f"""
    SELECT action_id, {INPUT_SQL} AS problem FROM (SELECT action_id, CASE event_type WHEN 'click' THEN student_comment
      WHEN 'error' THEN '' WHEN 'view' THEN '  {{"k": 1, "long": true}}' WHEN 'signup' THEN 'short'
      ELSE reviewer_comment END AS text FROM actions)
    UNION ALL SELECT doc_id, {INPUT_SQL} FROM texts""")
def _(t):
    kind = F.col("event_type")
    made = t.actions.select("action_id", F.when(kind == "click", F.col("student_comment"))
                            .when(kind == "error", F.lit(""))
                            .when(kind == "view", F.lit('  {"k": 1, "long": true}'))
                            .when(kind == "signup", F.lit("short"))
                            .otherwise(F.col("reviewer_comment")).alias("text"))
    both = made.unionByName(t.texts.select(F.col("doc_id").alias("action_id"), "text"))
    return both.select("action_id", T.input_problem(F.col("text")).alias("problem"))


def _spacing_sql() -> str:
    sql = "text"
    for pattern in K.SPACING_PATTERNS:
        sql = f"regexp_replace({sql}, '{pattern}', '\\1 \\2', 'g')"
    sql = f"regexp_replace({sql}, '[' || {SQL_WHITE} || ']+', ' ', 'g')"
    for wrong, right in K.SPACING_FIXES:
        sql = f"replace({sql}, {sql_text(wrong)}, {sql_text(right)})"
    return sql_strip(sql)


@query("fix_word_spacing", f"SELECT doc_id, {_spacing_sql()} AS spaced FROM texts", heavy=True)
def _(t):
    return t.texts.select("doc_id", T.fix_word_spacing(F.col("text")).alias("spaced"))


def language_sql(keywords) -> str:
    hits = " OR ".join(f"contains(lower(text), {sql_text(w)})" for w in (*K.FINNISH_LETTERS, *keywords))
    return f"CASE WHEN text IS NULL OR text = '' THEN 'auto' WHEN {hits} THEN 'fin' ELSE 'eng' END"


@query("detect_language", f"""
    SELECT doc_id, {language_sql(K.WORKFLOW_KEYWORDS)} AS workflow_language,
      {language_sql(K.OCR_KEYWORDS)} AS ocr_language FROM texts""", heavy=True)
def _(t):
    text = F.col("text")
    return t.texts.select("doc_id", T.detect_language(text).alias("workflow_language"),
                          T.detect_language(text, K.OCR_KEYWORDS).alias("ocr_language"))


@query("diacritic_count", """
    SELECT doc_id, CAST(length(regexp_replace(lower(text), '[^äöå]', '', 'g')) AS INTEGER) AS n FROM texts""")
def _(t):
    return t.texts.select("doc_id", T.diacritic_count(F.col("text")).alias("n"))


_CONFIDENCE_SQL = ("least(1.0, 0.8 + CASE lang WHEN 'de' THEN 0.1 WHEN 'en' THEN 0.05 ELSE 0 END "
                   "+ CASE WHEN doc_id % 3 < 2 THEN 0.05 ELSE 0 END)")


def _confidence():
    language = F.when(F.col("lang") == "de", F.lit("fin")).when(F.col("lang") == "en", F.lit("eng")).otherwise(
        F.lit("auto"))
    suffix = F.element_at(F.array(F.lit(".pdf"), F.lit("docx"), F.lit(".png")), (F.col("doc_id") % 3 + 1).cast("int"))
    return T.text_confidence(suffix, language)


@query("text_confidence", f"SELECT doc_id, CAST(round({_CONFIDENCE_SQL}, 4) AS DOUBLE) AS confidence FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(_confidence(), 4).alias("confidence"))


@query("confidence_band", """
    SELECT doc_id, n_chars % 101 AS percent, CASE WHEN n_chars % 101 >= 80 THEN 'high' WHEN n_chars % 101 >= 50 THEN 'medium'
      ELSE 'low' END AS band FROM documents""")
def _(t):
    percent = F.col("n_chars") % 101
    return t.documents.select("doc_id", percent.alias("percent"), T.confidence_band(percent).alias("band"))


@query("media_type", """
    SELECT upload_id, CASE lower(ext) WHEN 'pdf' THEN 'application/pdf' WHEN 'jpg' THEN 'image/jpeg'
      WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png'
      WHEN 'doc' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
      WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
      ELSE 'application/octet-stream' END AS media_type
    FROM (SELECT upload_id, regexp_extract(filename, '\\.([^.]*)$', 1) AS ext FROM uploads
      UNION ALL SELECT certificate_id, filetype FROM certificates)""")
def _(t):
    kinds = t.uploads.select("upload_id", T.suffix_of(F.col("filename")).alias("ext")).unionByName(
        t.certificates.select(F.col("certificate_id").alias("upload_id"), F.col("filetype").alias("ext")))
    return kinds.select("upload_id", T.media_type(F.col("ext")).alias("media_type"))


@query("render_prompt", """
    SELECT doc_id, 'Is this company real? Name: ' || source || '. Address: ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END,
      'Not provided') || '. Business id: ' || CAST(n_chars AS VARCHAR) || '. Phone: Not provided. Email: Not provided.'
        AS company_prompt,
      'List employee, employer, issue date and positions of this certificate as JSON.' || chr(10) || chr(10) || text
        AS extraction_prompt
    FROM documents""")
def _(t):
    nothing = F.lit(None).cast("string")
    return t.documents.select(
        "doc_id",
        T.render_template(T.PROMPT_TEMPLATES["company"], {
            "company_name": F.col("source"), "address": F.when(F.col("doc_id") % 2 == 0, F.col("lang")),
            "business_id": F.col("n_chars"), "phone": nothing, "email": nothing,
        }, "Not provided").alias("company_prompt"),
        T.render_template(T.PROMPT_TEMPLATES["extraction"], {"document_text": F.col("text")}).alias("extraction_prompt"))


def template_sql(template: str, values: dict[str, str]) -> str:
    parts = []
    for token in re.split(r"(\{\w+\})", template):
        if token.startswith("{"):
            parts.append(f"coalesce(CAST({values[token[1:-1]]} AS VARCHAR), '')")
        elif token:
            parts.append(" || chr(10) || ".join(sql_text(line) for line in token.split("\n")))
    return " || ".join(parts)


_EXTRACTED_SQL = "json_object('employer', training_institution, 'duration', training_duration)"
_EVALUATED_SQL = "json_object('decision', ai_decision, 'hours', total_working_hours, 'comment', student_comment)"
_STAGE_SQL = {
    "current_date": sql_text(AS_OF), "student_degree": "degree", "requested_training_type": "lower(training_type)",
    "degree_specific_guidelines": "NULL", "additional_documents_section": "NULL", "additional_documents_text": "NULL",
    "document_text": "ai_justification", "ocr_text": "ai_justification", "extracted_info": _EXTRACTED_SQL,
    "extraction_results": _EXTRACTED_SQL, "evaluation_results": _EVALUATED_SQL, "validation_results": "ai_workflow_json",
}


@query("render_stage_prompts", f"""
    SELECT certificate_id, {', '.join(f'{template_sql(T.PROMPT_TEMPLATES[s], _STAGE_SQL)} AS {s}' for s in ('evaluation', 'validation', 'correction'))}
    FROM decisions JOIN certificates USING (certificate_id) JOIN students USING (student_id)""")
def _(t):
    keep = {"ignoreNullFields": "false"}
    nothing = F.lit(None).cast("string")
    extracted = F.to_json(F.struct(F.col("training_institution").alias("employer"),
                                   F.col("training_duration").alias("duration")), keep)
    evaluated = F.to_json(F.struct(F.col("ai_decision").alias("decision"), F.col("total_working_hours").alias("hours"),
                                   F.col("student_comment").alias("comment")), keep)
    values = {
        "current_date": F.lit(AS_OF), "student_degree": F.col("degree"),
        "requested_training_type": F.lower("training_type"), "degree_specific_guidelines": nothing,
        "additional_documents_section": nothing, "additional_documents_text": nothing,
        "document_text": F.col("ai_justification"), "ocr_text": F.col("ai_justification"), "extracted_info": extracted,
        "extraction_results": extracted, "evaluation_results": evaluated, "validation_results": F.col("ai_workflow_json")}
    rows = t.decisions.join(t.certificates, "certificate_id").join(t.students, "student_id")
    return rows.select("certificate_id", *[
        T.render_template(T.PROMPT_TEMPLATES[stage], values).alias(stage) for stage in ("evaluation", "validation", "correction")])


CATALOGUE_SQL = f"""catalogue AS (SELECT p.place, p.key AS programme_key, p.name,
      coalesce(list_sort(list(DISTINCT keyword) FILTER (kind = 'industry')), []) AS industries,
      coalesce(list_sort(list(DISTINCT keyword) FILTER (kind = 'role')), []) AS roles
    FROM {PROGRAMMES_SQL} LEFT JOIN keywords AS k ON k.programme_no = p.place GROUP BY ALL)"""


@query("degree_catalogue", f"""
    WITH {CATALOGUE_SQL}
    SELECT CAST(place AS INTEGER) AS place, programme_key, name,
      CASE WHEN programme_key = 'general' THEN '{', '.join(K.GENERAL_FIELDS)}' ELSE name END AS fields,
      array_to_string(industries, ', ') AS industries, array_to_string(roles, ', ') AS roles
    FROM catalogue""")
def _(t):
    return degree_catalogue(keyword_table(t)).select(
        "place", "programme_key", "name",
        *[F.array_join(c, ", ").alias(c) for c in ("fields", "industries", "roles")])


@query("degree_guidelines", f"""
    WITH {CATALOGUE_SQL}
    SELECT programme_key, 'GUIDELINES FOR ' || upper(name) || chr(10) || 'RELEVANT INDUSTRIES: '
      || array_to_string(industries, ', ') || chr(10) || 'RELEVANT ROLES: ' || array_to_string(roles, ', ') || chr(10)
      || 'Compare tasks, industry and skills with the ' || name || ' curriculum. Practical training is 30 credits: '
      || 'professional work at least 20, general work at most 10.' AS guidelines
    FROM catalogue""")
def _(t):
    return with_guidelines(degree_catalogue(keyword_table(t))).select("programme_key", "guidelines")


# --- names -----------------------------------------------------------------------------------------

def normal_sql(column: str) -> str:
    return (f"coalesce(regexp_replace(regexp_replace(translate({sql_strip(f'lower({column})')}, 'äöå', 'aoa'), "
            f"'[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'), '')")


@query("normalize_name", f"""
    SELECT certificate_id AS id, employee_name AS name, {normal_sql('employee_name')} AS normal FROM extractions
    UNION ALL SELECT doc_id, employee, {normal_sql('employee')} FROM (SELECT doc_id, source || ' ' || text AS employee FROM texts)""", heavy=True)
def _(t):
    names = t.extractions.select(F.col("certificate_id").alias("id"), F.col("employee_name").alias("name")).unionByName(
        t.texts.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "text").alias("name")))
    return names.select("id", "name", N.normalize_name(F.col("name")).alias("normal"))


def similarity_sql(a: str, b: str) -> str:
    same = (f"list_sum(list_transform(range(1, least(length({a}), length({b})) + 1), "
            f"lambda i: CASE WHEN substr({a}, i, 1) = substr({b}, i, 1) THEN 1 ELSE 0 END))")
    return (f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 "
            f"ELSE CAST(coalesce({same}, 0) AS DOUBLE) / greatest(length({a}), length({b})) END")


@query("positional_similarity", f"""
    SELECT certificate_id, round({similarity_sql('employee_name', 'email')}, 6) AS similarity,
      round({similarity_sql('last_name', 'email')}, 6) AS last_similarity
    FROM extractions JOIN certificates USING (certificate_id) JOIN students USING (student_id)""", heavy=True)
def _(t):
    rows = t.extractions.join(t.certificates, "certificate_id").join(t.students, "student_id")
    return rows.select("certificate_id", *[
        F.round(N.positional_similarity(F.col(name), F.col("email")), 6).alias(alias)
        for name, alias in (("employee_name", "similarity"), ("last_name", "last_similarity"))])


_TITLE = ("array_to_string(list_transform(regexp_extract_all(replace(split_part({0}, '@', 1), '.', ' '), "
          "'(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda w: upper(w[1]) || lower(w[2:])), '')")


@query("name_from_email", f"SELECT student_id, email, {_TITLE.format('email')} AS name FROM students")
def _(t):
    return t.students.select("student_id", "email", N.name_from_email(F.col("email")).alias("name"))


@query("reviewer_display_name", """
    SELECT reviewer_id, nullif(concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')), '') AS name FROM reviewers""")
def _(t):
    return t.reviewers.select("reviewer_id", N.reviewer_display_name(F.col("first_name"), F.col("last_name")).alias("name"))


_DOMAIN_RE = EMAIL_DOMAIN.replace(".", "\\.")


@query("student_email_ok", f"""
    SELECT id, email, regexp_matches(email, '^[A-Za-z0-9._%+-]+@{_DOMAIN_RE}$') AS form_ok,
      ends_with(lower({sql_strip('email')}), '@{EMAIL_DOMAIN}') AS ending_ok
    FROM (SELECT student_id AS id, CASE student_id % 4 WHEN 0 THEN email WHEN 1 THEN upper(email)
        WHEN 2 THEN replace(email, '.', ' ') ELSE email || ' ' END AS email FROM students
      UNION ALL SELECT reviewer_id, email FROM reviewers)""")
def _(t):
    key, email = F.col("student_id") % 4, F.col("email")
    changed = F.when(key == 0, email).when(key == 1, F.upper(email)).when(
        key == 2, F.replace(email, F.lit("."), F.lit(" "))).otherwise(F.concat(email, F.lit(" ")))
    both = t.students.select(F.col("student_id").alias("id"), changed.alias("email")).unionByName(
        t.reviewers.select(F.col("reviewer_id").alias("id"), "email"))
    return both.select("id", "email", N.student_email_ok(F.col("email"), EMAIL_DOMAIN).alias("form_ok"),
                       N.student_email_accepted(F.col("email"), EMAIL_DOMAIN).alias("ending_ok"))


# --- dates ------------------------------------------------------------------------------------------
# the same day written in five ways, one of them impossible
_WRITTEN_SQL = """written AS (SELECT o_orderkey, CASE o_orderkey % 5
      WHEN 0 THEN strftime(o_orderdate, '%-d. %-m. %Y') WHEN 1 THEN strftime(o_orderdate, ' %d/%m/%Y')
      WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN '31.' || strftime(o_orderdate, '%-m.%Y')
      ELSE strftime(o_orderdate, '%Y.%m.%d') END AS written, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def _written(t):
    key, when = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (F.when(key == 0, F.date_format(when, "d. M. yyyy")).when(key == 1, F.date_format(when, " dd/MM/yyyy"))
            .when(key == 2, F.date_format(when, "yyyy-MM-dd"))
            .when(key == 3, F.concat(F.lit("31."), F.date_format(when, "M.yyyy")))
            .otherwise(F.date_format(when, "yyyy.MM.dd")))
    return t.orders.select("o_orderkey", text.alias("written"), when.cast("date").alias("d"))


def date_sql(column: str) -> str:
    """ISO text of a written date or null."""
    s = sql_strip(column)
    iso = (f"regexp_replace(regexp_replace({s}, '^(\\d{{1,2}})\\s*\\.\\s*(\\d{{1,2}})\\s*\\.\\s*(\\d{{4}})$', '\\3-\\2-\\1'), "
           f"'^(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}})$', '\\3-\\2-\\1')")
    return (f"CASE WHEN regexp_matches({iso}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') "
            f"THEN strftime(try_strptime({iso}, '%Y-%m-%d'), '%Y-%m-%d') END")


@query("parse_finnish_date", f"WITH {_WRITTEN_SQL} SELECT o_orderkey, written, {date_sql('written')} AS parsed FROM written", heavy=True)
def _(t):
    return _written(t).select("o_orderkey", "written", D.iso(D.parse_finnish_date(F.col("written"))).alias("parsed"))


@query("is_future_date", f"""
    WITH {_WRITTEN_SQL} SELECT o_orderkey, coalesce({date_sql('written')} > '{AS_OF}', false) AS is_future FROM written""", heavy=True)
def _(t):
    return _written(t).select("o_orderkey", D.is_future_date(
        D.parse_finnish_date(F.col("written")), F.lit(AS_OF).cast("date")).alias("is_future"))


@query("date_range_problem", """
    SELECT certificate_id, line, part_id, supplier_id, CASE WHEN start_date > end_date THEN 'Start date ' ||
      strftime(start_date, '%Y-%m-%d') || ' is after end date ' || strftime(end_date, '%Y-%m-%d') END AS problem
    FROM (SELECT l_orderkey AS certificate_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supplier_id,
        CAST(l_shipdate AS DATE) AS start_date, CASE WHEN l_tax > 0 THEN CAST(o_orderdate AS DATE) + 60 END AS end_date
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.col("l_shipdate").cast("date")
    end = F.when(F.col("l_tax") > 0, F.date_add(F.col("o_orderdate").cast("date"), 60))
    return rows.select(F.col("l_orderkey").alias("certificate_id"), F.col("l_linenumber").alias("line"),
                       F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"),
                       D.date_range_problem(start, end).alias("problem"))


@query("parse_and_validate_dates", f"""
    WITH {_WRITTEN_SQL},
    pairs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, written AS a,
        CASE WHEN l_tax > 0.01 THEN strftime(l_shipdate, '%-d.%-m.%Y') WHEN l_tax > 0 THEN '' END AS b
      FROM lineitem JOIN written ON l_orderkey = o_orderkey),
    parsed AS (SELECT *, nullif(b, '') AS raw_b, {date_sql('a')} AS pa, {date_sql("nullif(b, '')")} AS pb FROM pairs),
    found AS (SELECT *, list_filter([CASE WHEN pa IS NULL THEN 'Could not parse start date: ' || a END,
        CASE WHEN raw_b IS NOT NULL AND pb IS NULL THEN 'Could not parse end date: ' || raw_b END,
        CASE WHEN pa > pb THEN 'Start date ' || pa || ' is after end date ' || pb END], lambda x: x IS NOT NULL) AS errors,
      list_filter([CASE WHEN pa > '{AS_OF}' THEN 'Start date ' || pa || ' is in the future' END,
        CASE WHEN pb > '{AS_OF}' THEN 'End date ' || pb || ' is in the future' END], lambda x: x IS NOT NULL) AS warnings
      FROM parsed)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pa AS start_parsed, pb AS end_parsed, len(errors) = 0 AS is_valid,
      array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings FROM found""", heavy=True)
def _(t):
    pairs = t.lineitem.join(_written(t), F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.when(F.col("l_tax") > 0.01, F.date_format("l_shipdate", "d.M.yyyy")).when(F.col("l_tax") > 0, F.lit(""))
    checked = pairs.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.parse_and_validate_dates(
        F.col("written"), end, F.lit(AS_OF).cast("date")).alias("r"))
    return checked.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.iso(F.col("r.start_date_parsed")).alias("start_parsed"),
        D.iso(F.col("r.end_date_parsed")).alias("end_parsed"), "r.is_valid",
        F.array_join("r.errors", "; ").alias("errors"), F.array_join("r.warnings", "; ").alias("warnings"))


@query("fix_extraction_dates", f"""
    WITH {_WRITTEN_SQL}
    SELECT o_orderkey, coalesce({date_sql('written')}, written) AS issue_date,
      coalesce({date_sql('written')}, written) || '..' || strftime(d + 30, '%Y-%m-%d') || ',n/a..' AS positions
    FROM written""", heavy=True)
def _(t):
    def position(start, end):
        return F.struct(start.alias("start_date"), end.alias("end_date"))

    rows = _written(t).select("o_orderkey", F.struct(
        F.col("written").alias("certificate_issue_date"),
        F.array(position(F.col("written"), F.date_format(F.date_add("d", 30), "d.M.yyyy")),
                position(F.lit("n/a"), F.lit(None).cast("string"))).alias("positions")).alias("x"))
    fixed = rows.select("o_orderkey", D.fix_extraction_dates(F.col("x")).alias("x"))
    shown = F.transform("x.positions", lambda p: F.concat(
        p["start_date"], F.lit(".."), F.coalesce(p["end_date"], F.lit(""))))
    return fixed.select("o_orderkey", F.col("x.certificate_issue_date").alias("issue_date"),
                        F.array_join(shown, ",").alias("positions"))


@query("position_duration", f"""
    SELECT certificate_id, line, part_id, supplier_id, {sql_day('start_date')},
      CAST(date_diff('day', start_date, end_date) AS INTEGER) AS days,
      round(nullif(date_diff('day', start_date, end_date), 0) / {K.DAYS_PER_YEAR}::DOUBLE, 6) AS years FROM positions""")
def _(t):
    days = D.duration_days(F.col("start_date"), F.col("end_date"))
    return t.positions.select("certificate_id", "line", "part_id", "supplier_id", day("start_date"),
                              days.alias("days"), F.round(D.years_of(days), 6).alias("years"))


# --- hours and credits ---------------------------------------------------------------------------------


@query("credits_from_hours", """
    SELECT certificate_id, total_working_hours, CAST(trunc(total_working_hours / 27.0) AS DOUBLE) AS credits
    FROM decisions""")
def _(t):
    return t.decisions.select("certificate_id", "total_working_hours",
                              C.credits_from_hours(F.col("total_working_hours")).alias("credits"))


@query("hours_problem", """
    SELECT certificate_id, CASE WHEN certificate_id % 5 = 4 THEN 'Working hours are not a number: 1040 hours' END AS problem
    FROM evaluation_answers""", heavy=True)
def _(t):
    from meritlake.functions.answers import clean_evaluation, parse_answers

    cleaned = clean_evaluation(parse_answers(t.evaluation_answers, "answer"))
    return cleaned.select("certificate_id", C.hours_problem(F.col("total_working_hours")).alias("problem"))


@query("cap_credits", """
    WITH base AS (SELECT certificate_id, total_working_hours AS h, trunc(total_working_hours / 27.0) AS b,
        CASE WHEN work_type = 'SELF_PACED' AND training_type = 'GENERAL' THEN 'other' ELSE lower(training_type) END AS kind
      FROM decisions JOIN certificates USING (certificate_id)),
    capped AS (SELECT *, CASE kind WHEN 'professional' THEN 30 WHEN 'general' THEN 10 END AS cap FROM base)
    SELECT certificate_id, kind, CAST(CASE WHEN b > cap THEN cap ELSE b END AS DOUBLE) AS credits,
      CASE WHEN b > cap THEN CAST(h AS VARCHAR) || ' hours / 27 hours per ECTS = ' || CAST(CAST(b AS INTEGER) AS VARCHAR)
        || '.0 credits, capped at ' || CAST(cap AS VARCHAR) || '.0 maximum for ' || kind || ' training' END AS breakdown
    FROM capped""")
def _(t):
    kind = F.when((F.col("work_type") == "SELF_PACED") & (F.col("training_type") == "GENERAL"),
                  F.lit("other")).otherwise(F.lower("training_type"))
    rows = t.decisions.join(t.certificates, "certificate_id").select(
        "certificate_id", C.effective_type(kind).alias("kind"), F.col("total_working_hours").alias("h"),
        C.credits_from_hours(F.col("total_working_hours")).alias("b"))
    return rows.select("certificate_id", "kind", C.cap_credits(F.col("b"), F.col("kind")).alias("credits"),
                       C.cap_breakdown(F.col("h"), F.col("b"), F.col("kind")).alias("breakdown"))


@query("hours_per_credit", """
    SELECT certificate_id, round(nullif(total_working_hours, 0) / nullif(credits_awarded, 0)::DOUBLE, 6) AS ratio
    FROM decisions""")
def _(t):
    return t.decisions.select("certificate_id", F.round(C.hours_per_credit(
        F.col("total_working_hours"), F.col("credits_awarded").cast("double")), 6).alias("ratio"))


@query("hours_from_dates", """
    SELECT certificate_id, line, part_id, supplier_id,
      CAST(round((date_diff('day', start_date, coalesce(end_date, issue_date)) + 1)
        * CASE line % 3 WHEN 0 THEN 40.0 WHEN 1 THEN 40.0 * 50 / 100 ELSE 20.0 END::DOUBLE / 7) AS INTEGER) AS hours
    FROM positions JOIN extractions USING (certificate_id)""")
def _(t):
    rows = t.positions.drop("duties").join(t.extractions, "certificate_id")
    third = F.col("line") % 3
    return rows.select("certificate_id", "line", "part_id", "supplier_id", C.hours_from_dates(
        F.col("start_date"), F.col("end_date"), F.col("issue_date"),
        weekly_hours=F.when(third == 2, F.lit(20.0)), percent=F.when(third == 1, F.lit(50.0))).alias("hours"))


@query("hours_source_choice", """
    WITH docs AS (SELECT certificate_id, sum(hours) AS h FROM additional_documents
      WHERE document_type = 'HOUR_DOCUMENTATION' GROUP BY certificate_id)
    SELECT certificate_id, CAST(CASE WHEN work_type = 'SELF_PACED' THEN coalesce(h, total_working_hours)
      ELSE total_working_hours END AS BIGINT) AS hours
    FROM certificates LEFT JOIN decisions USING (certificate_id) LEFT JOIN docs USING (certificate_id)""")
def _(t):
    docs = t.additional_documents.where("document_type = 'HOUR_DOCUMENTATION'").groupBy("certificate_id").agg(
        F.sum("hours").alias("h"))
    rows = t.certificates.join(t.decisions, "certificate_id", "left").join(docs, "certificate_id", "left")
    return rows.select("certificate_id", C.hours_source_choice(
        F.col("work_type"), F.col("h"), F.col("total_working_hours").cast("long")).alias("hours"))


@query("future_date_rejection", f"""
    WITH latest AS (SELECT certificate_id, max(greatest(start_date, end_date)) AS d FROM positions GROUP BY certificate_id)
    SELECT certificate_id, coalesce(greatest(d, issue_date) > DATE '{AS_OF}', false) AS has_future_date,
      CASE WHEN greatest(d, issue_date) > DATE '{AS_OF}' THEN 'REJECTED' END AS forced_decision,
      CASE WHEN greatest(d, issue_date) > DATE '{AS_OF}' THEN 'The work experience cannot be evaluated because it contains dates after the current date ({AS_OF}). Working hours cannot be calculated for employment periods that have not yet occurred. The certificate must be corrected to show valid past dates before it can be processed.' END AS justification
    FROM extractions LEFT JOIN latest USING (certificate_id)""")
def _(t):
    as_of = F.lit(AS_OF).cast("date")
    latest = t.positions.groupBy("certificate_id").agg(F.max(F.greatest("start_date", "end_date")).alias("d"))
    late = D.is_future_date(F.greatest("d", "issue_date"), as_of)
    return t.extractions.join(latest, "certificate_id", "left").select(
        "certificate_id", late.alias("has_future_date"), F.when(late, F.lit("REJECTED")).alias("forced_decision"),
        F.when(late, C.future_date_justification(as_of)).alias("justification"))
