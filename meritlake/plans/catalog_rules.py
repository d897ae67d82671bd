"""Matching, rules, whole evaluations, state changes, callers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.names import with_name_match
from meritlake.operators import degrees, identity, intake, state
from meritlake.operators import extraction as X
from meritlake.plans.catalog import PROGRAMMES_SQL, day, keyword_table, programme_key, query, sql_lines, sql_text
from meritlake.plans.catalog_relational import verdicts
from meritlake.plans.catalog_text import (
    AS_OF, CATALOGUE_SQL, INPUT_SQL, SANITIZED_SQL, date_sql, language_sql, normal_sql, similarity_sql)
from meritlake.plans.driver_views import EMAIL_DOMAIN
from meritlake.plans.evaluate import certificate_facts, evaluate_facts, evaluate_texts
from meritlake.plans.model_evaluation import evaluate_with_model
from meritlake.session import work_folder
from meritlake.sources.calls import ANSWERS, map_with_answers, map_with_caller
from meritlake.sources.documents import process_documents
from meritlake.sources.keyed_store import KeyedStore
from meritlake.streaming.certificates import last_status, read_arrivals, stream_evaluate, stream_status

# --- degrees -----------------------------------------------------------------------------------


def degree_sql(column: str) -> str:
    """Key of the programme a degree text means."""
    low = f"lower({column})"
    plain = f"replace(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), ' ', '_')"

    def first(test: str) -> str:
        return f"(SELECT arg_min(key, place) FROM {PROGRAMMES_SQL} WHERE {test})"

    return (f"coalesce({first(f'lower(name) = {low}')}, {first(f'key = {plain}')}, {first(f'key = {low}')}, "
            f"{first(f'contains(lower(name), {low})')}, 'general')")


# degree texts of students, and every segment, type and part name tried as one
_DEGREES_SQL = """degree_texts AS (SELECT student_id AS id, degree FROM students
      UNION ALL SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_type)
        WHEN 2 THEN 'Bachelor of Health Care, Nursing' ELSE 'medianomi amk' END FROM part)"""


def _degree_texts(t):
    key = F.col("p_partkey") % 4
    return t.students.select(F.col("student_id").alias("id"), "degree").unionByName(t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(key == 0, F.col("p_name")).when(key == 1, F.upper("p_type"))
        .when(key == 2, F.lit("Bachelor of Health Care, Nursing")).otherwise(F.lit("medianomi amk")).alias("degree")))


@query("match_degree", f"""
    WITH {_DEGREES_SQL}, once AS (SELECT DISTINCT degree AS d FROM degree_texts),
    matched AS (SELECT d, {degree_sql('d')} AS programme_key FROM once)
    SELECT id, degree, programme_key FROM degree_texts JOIN matched ON degree = d""")
def _(t):
    return _degree_texts(t).select("id", "degree", degrees.match_degree(F.col("degree")).alias("programme_key"))


@query("degree_supported", f"""
    WITH {_DEGREES_SQL}, once AS (SELECT DISTINCT degree AS d FROM degree_texts),
    checked AS (SELECT d, EXISTS (SELECT 1 FROM {PROGRAMMES_SQL} WHERE key = replace(lower(d), ' ', '_') OR key = lower(d)
      OR contains(lower(name), lower(d))) AS supported FROM once)
    SELECT id, degree, supported FROM degree_texts JOIN checked ON degree = d""")
def _(t):
    return _degree_texts(t).select("id", "degree", degrees.degree_supported(F.col("degree")).alias("supported"))


@query("match_degree_table", f"""
    WITH {_DEGREES_SQL}, once AS (SELECT DISTINCT degree AS d FROM degree_texts),
    matched AS (SELECT d, {degree_sql('d')} AS programme_key, EXISTS (SELECT 1 FROM {PROGRAMMES_SQL}
      WHERE key = replace(lower(d), ' ', '_') OR key = lower(d) OR contains(lower(name), lower(d))) AS supported FROM once)
    SELECT id, degree, programme_key, supported FROM degree_texts JOIN matched ON degree = d""")
def _(t):
    """Both answers from the programmes as a table."""
    programmes = t.spark.createDataFrame([(i, *p) for i, p in enumerate(K.DEGREE_PROGRAMMES)], "place int, key string, name string")
    texts = _degree_texts(t)
    return texts.join(degrees.match_degrees(texts, programmes), "degree").select("id", "degree", "programme_key", "supported")


def hits_sql(text: str) -> str:
    return f"len(list_filter(words, lambda w: contains(lower({text}), w)))"


_WORDS_SQL = ("word_lists AS (SELECT programme_key, list_distinct(list_transform(list_concat(industries, roles), "
              "lambda w: lower(w))) AS words FROM catalogue)")


def relevance_sql(hits: str) -> str:
    return f"CASE WHEN {hits} >= 3 THEN 'high' WHEN {hits} >= 1 THEN 'medium' ELSE 'low' END"


_PLACED_DOCS = f"""placed AS (SELECT doc_id, text, (SELECT key FROM {PROGRAMMES_SQL} WHERE place = doc_id % 36) AS programme_key
      FROM (SELECT doc_id, text FROM texts UNION ALL SELECT certificate_id, duties FROM extractions))"""


_SCORED_SQL = f"""
    WITH {CATALOGUE_SQL}, {_WORDS_SQL}, {_PLACED_DOCS},
    scored AS (SELECT doc_id, programme_key, CAST({hits_sql('text')} AS INTEGER) AS keyword_hits
      FROM placed JOIN word_lists USING (programme_key))
    SELECT doc_id, programme_key, keyword_hits, {relevance_sql('keyword_hits')} AS degree_relevance FROM scored"""


def _placed_texts(t):
    texts = t.texts.select("doc_id", "text").unionByName(
        t.extractions.select(F.col("certificate_id").alias("doc_id"), F.col("duties").alias("text")))
    return texts.withColumn("programme_key", programme_key((F.col("doc_id") % 36).cast("int")))


@query("degree_keyword_score", _SCORED_SQL, heavy=True)
def _(t):
    return degrees.degree_keyword_score(_placed_texts(t), degrees.degree_catalogue(keyword_table(t))).drop("text")


@query("degree_keyword_index", _SCORED_SQL, heavy=True)
def _(t):
    """The same by the trigram index of the keyword table."""
    return degrees.keyword_hits(_placed_texts(t), keyword_table(t)).drop("text")


# --- names -----------------------------------------------------------------------------------------

def names_sql(source: str, keep: str) -> str:
    """CTE ``named``: the verdict on first_name, last_name and employee_name of a source."""
    pct = "CAST(CAST(round_even(sim * 100, 0) AS INTEGER) AS VARCHAR) || '%'"
    said = "'''' || coalesce(employee_name, '') || ''''"
    known = "'''' || coalesce(first_name, '') || ' ' || coalesce(last_name, '') || ''''"
    turned = "'''' || coalesce(last_name, '') || ' ' || coalesce(first_name, '') || ''''"
    rules = [
        ("nx = '' OR nx IN ('unknown', 'unknown employee')", "unknown", "0.0",
         "'Could not extract employee name from certificate'"),
        ("nf = '' AND nl = ''", "unknown", "0.0", "'Student name not available in database'"),
        ("nx = straight", "match", "1.0", f"'Exact match: ' || {said} || ' matches ' || {known}"),
        ("nx = turned", "match", "0.95",
         f"'Name order match: ' || {said} || ' matches ' || {turned} || ' (reversed order)'"),
        ("contains(nx, nf) AND contains(nx, nl)", "match", "0.9",
         f"'Partial match: ' || {said} || ' contains both ''' || coalesce(first_name, '') || ''' and ''' || coalesce(last_name, '') || ''''"),
        ("contains(nx, nf) OR contains(nx, nl)", "partial_match", "0.6",
         f"'Partial match: ' || {said} || ' contains ''' || CASE WHEN contains(nx, nf) THEN nf ELSE nl END || ''''"),
        ("sim > 0.7", "partial_match", "sim", f"'Similar names: ' || {said} || ' is ' || {pct} || ' similar to ' || {known}"),
        ("sim > 0.4", "mismatch", "1.0 - sim",
         f"'Names appear different: ' || {said} || ' vs ' || {known} || ' (similarity: ' || {pct} || ')'"),
        ("true", "mismatch", "1.0", f"'Names do not match: ' || {said} || ' vs ' || {known}"),
    ]

    def chain(values) -> str:
        return "CASE " + " ".join(f"WHEN {rule[0]} THEN {value}" for rule, value in zip(rules, values)) + " END"

    return f"""n1 AS (SELECT *, {normal_sql('first_name')} AS nf, {normal_sql('last_name')} AS nl,
        {normal_sql('employee_name')} AS nx FROM {source}),
      n2 AS (SELECT *, trim(nf || ' ' || nl) AS straight, trim(nl || ' ' || nf) AS turned FROM n1),
      n3 AS (SELECT *, CAST(greatest({similarity_sql('nx', 'straight')}, {similarity_sql('nx', 'turned')}) AS DOUBLE) AS sim FROM n2),
      named AS (SELECT {keep}, {chain([f"'{r[1]}'" for r in rules])} AS match_result,
        CAST({chain([r[2] for r in rules])} AS DOUBLE) AS match_confidence,
        {chain([r[3] for r in rules])} AS match_explanation FROM n3)"""


_PEOPLE_SQL = """people AS (SELECT certificate_id, first_name, last_name, employee_name
      FROM extractions JOIN certificates USING (certificate_id) JOIN students USING (student_id)
      UNION ALL SELECT -1 - reviewer_id, first_name, last_name, employee_name FROM reviewers
        JOIN extractions ON reviewer_id = certificate_id)"""


@query("compare_names", f"""
    WITH {_PEOPLE_SQL}, {names_sql('people', 'certificate_id')}
    SELECT certificate_id, match_result, round(match_confidence, 6) AS match_confidence, match_explanation FROM named""", heavy=True)
def _(t):
    names = ["first_name", "last_name", "employee_name"]
    own = t.extractions.join(t.certificates, "certificate_id").join(t.students, "student_id").select("certificate_id", *names)
    others = t.reviewers.join(t.extractions, F.col("reviewer_id") == F.col("certificate_id")).select(
        (F.lit(-1) - F.col("reviewer_id")).alias("certificate_id"), *names)
    compared = with_name_match(own.unionByName(others), *names)
    return compared.select("certificate_id", "match_result", F.round("match_confidence", 6).alias("match_confidence"),
                           "match_explanation")


# one certificate in seven points at no student, so some have no known owner; student ids are never negative
_OWNER = "CASE WHEN certificate_id % 7 = 0 THEN -1 - student_id ELSE student_id END"
_CHECKED_SQL = f"""held AS (SELECT certificate_id, {_OWNER} AS student_id FROM certificates),
    owned AS (SELECT certificate_id, employee_name, first_name, last_name, k.student_id AS owner
      FROM extractions LEFT JOIN held USING (certificate_id) LEFT JOIN students AS k USING (student_id)),
    {names_sql('owned', 'certificate_id, owner, first_name, last_name')},
    checked AS (SELECT certificate_id, CASE WHEN owner IS NULL THEN 'unknown' ELSE match_result END AS match_result,
        CASE WHEN owner IS NULL THEN 0.5 ELSE match_confidence END AS match_confidence,
        CASE WHEN owner IS NULL THEN {sql_text(identity.NO_IDENTITY)} ELSE match_explanation END AS match_explanation,
        CASE WHEN owner IS NULL THEN 'Unknown' ELSE coalesce(first_name, '') END AS db_student_first_name,
        owner IS NULL OR match_result IN ('match', 'partial_match') AS name_match FROM named)"""


def _checked(t):
    return identity.validate_student_names(
        t.extractions.select("certificate_id", "employee_name"),
        t.certificates.withColumn("student_id", F.expr(_OWNER)), t.students)


@query("validate_student_names", f"""
    WITH {_CHECKED_SQL}
    SELECT certificate_id, db_student_first_name, match_result, round(match_confidence, 6) AS match_confidence,
      match_explanation, name_match FROM checked""", heavy=True)
def _(t):
    return _checked(t).select("certificate_id", "db_student_first_name", "match_result",
                              F.round("match_confidence", 6).alias("match_confidence"), "match_explanation", "name_match")


@query("reject_on_name_mismatch", f"""
    WITH {_CHECKED_SQL}
    SELECT certificate_id, name_match, CASE WHEN NOT name_match THEN 'REJECTED' END AS decision,
      CASE WHEN NOT name_match THEN 'Certificate rejected due to name mismatch: ' || match_explanation END AS justification,
      CASE WHEN NOT name_match THEN 0.0::DOUBLE END AS credits_qualified,
      CASE WHEN NOT name_match THEN 'critical' END AS issue_severity FROM checked""", heavy=True)
def _(t):
    return identity.with_rejection(_checked(t)).select(
        "certificate_id", "name_match", "decision", "justification", "credits_qualified", "issue_severity")


@query("check_constraints", f"""
    WITH crowd AS (SELECT student_id, CASE WHEN student_id % 5 = 0 THEN 'shared@{EMAIL_DOMAIN}' WHEN student_id % 5 = 1
          THEN email || ' ' ELSE email END AS email, CASE WHEN student_id % 6 = 0 THEN '' ELSE degree END AS degree,
        CASE WHEN student_id % 4 = 0 THEN repeat('x', 300) ELSE first_name END AS first_name, last_name FROM students),
    uploads2 AS (SELECT certificate_id, CASE WHEN work_type = 'SELF_PACED' THEN 'SOLO' ELSE work_type END AS work_type,
        CASE WHEN training_type = 'GENERAL' AND work_type = 'REGULAR' THEN NULL ELSE training_type END AS training_type FROM certificates)
    SELECT CAST(student_id AS VARCHAR) AS row_id, 'email: wrong form' AS problem FROM crowd
      WHERE NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@{EMAIL_DOMAIN}$')
    UNION ALL SELECT CAST(student_id AS VARCHAR), 'degree: empty' FROM crowd WHERE degree = ''
    UNION ALL SELECT CAST(student_id AS VARCHAR), 'first_name: too long' FROM crowd WHERE length(first_name) > 255
    UNION ALL SELECT email, 'email: not unique' FROM crowd GROUP BY email HAVING count(*) > 1
    UNION ALL SELECT CAST(certificate_id AS VARCHAR), 'work_type: not in domain' FROM uploads2 WHERE work_type = 'SOLO'
    UNION ALL SELECT CAST(certificate_id AS VARCHAR), 'training_type: not in domain' FROM uploads2 WHERE training_type IS NULL""")
def _(t):
    key = F.col("student_id")
    crowd = t.students.withColumns({
        "email": F.when(key % 5 == 0, F.lit(f"shared@{EMAIL_DOMAIN}")).when(key % 5 == 1, F.concat("email", F.lit(" ")))
        .otherwise(F.col("email")),
        "degree": F.when(key % 6 == 0, F.lit("")).otherwise(F.col("degree")),
        "first_name": F.when(key % 4 == 0, F.repeat(F.lit("x"), 300)).otherwise(F.col("first_name"))})
    regular = F.col("work_type") == "REGULAR"
    certificates = t.certificates.withColumns({
        "training_type": F.when((F.col("training_type") == "GENERAL") & regular, F.lit(None)).otherwise(F.col("training_type")),
        "work_type": F.when(regular, F.col("work_type")).otherwise(F.lit("SOLO"))})
    return intake.check_constraints(crowd, "student_id", EMAIL_DOMAIN).unionByName(
        intake.check_constraints(certificates, "certificate_id"))


# --- fields by rules -----------------------------------------------------------------------------------

def _found_sql(pattern: str) -> str:
    return f"nullif(regexp_extract(text, {sql_text(pattern)}, 1), '')"


def _all_sql(pattern: str, group: int) -> str:
    return f"regexp_extract_all(text, {sql_text(pattern)}, {group})"


EXTRACT_SQL = f"""extracted AS (SELECT *, {_found_sql(X.EMPLOYEE)} AS employee_name, {_found_sql(X.EMPLOYER)} AS employer,
      {date_sql(_found_sql(X.ISSUE_DATE))} AS issue_date,
      CASE WHEN {language_sql(K.WORKFLOW_KEYWORDS)} = 'fin' THEN 'fi' ELSE 'en' END AS document_language,
      CAST({_found_sql(X.WEEKLY_HOURS)} AS DOUBLE) AS weekly_hours, CAST({_found_sql(X.PERCENT)} AS DOUBLE) AS percent,
      {_all_sql(X.DATE_RANGE, 1)} AS starts, {_all_sql(X.DATE_RANGE, 2)} AS ends, {_all_sql(X.OPEN_RANGE, 1)} AS opens
      FROM prepared),
    spans AS (SELECT *, list_concat(
        list_transform(list_zip(starts, ends), lambda r: {{'a': {date_sql('r[1]')}, 'b': {date_sql('r[2]')}}}),
        list_transform(opens, lambda o: {{'a': {date_sql('o')}, 'b': issue_date}})) AS positions FROM extracted)"""


@query("extract_fields_by_rules", f"""
    WITH prepared AS (SELECT doc_id, text FROM texts), {EXTRACT_SQL}
    SELECT doc_id, employee_name, employer, issue_date, document_language, weekly_hours, percent,
      array_to_string(list_transform(positions, lambda p: coalesce(employer, 'Unknown Employer') || '@' || coalesce(p.a, '')
        || '..' || coalesce(p.b, '')), ';') AS positions FROM spans""", heavy=True)
def _(t):
    fields = X.extract_fields(t.texts.select("doc_id", "text"))
    shown = F.transform("positions", lambda p: F.concat(
        p["employer"], F.lit("@"), F.coalesce(p["start_date"], F.lit("")), F.lit(".."), F.coalesce(p["end_date"], F.lit(""))))
    return fields.select("doc_id", "employee_name", "employer", day("issue_date"), "document_language", "weekly_hours",
                         "percent", F.array_join(shown, ";").alias("positions"))


@query("credits_vs_hours", f"""
    SELECT doc_id, CAST({_found_sql(X.WEEKLY_HOURS)} AS DOUBLE) AS weekly_hours,
      array_to_string({_all_sql(X.CREDIT_NUMBERS, 1)}, ',') AS credit_numbers FROM texts""", heavy=True)
def _(t):
    text = F.col("text")
    return t.texts.select("doc_id", X.stated_weekly_hours(text).alias("weekly_hours"), F.array_join(
        F.transform(X.credit_numbers(text), lambda n: n.cast("string")), ",").alias("credit_numbers"))


# --- whole evaluations -----------------------------------------------------------------------------------
_SETTLE_SQL = f"""settled AS (SELECT *, CASE WHEN NOT name_match OR future THEN 0 ELSE coalesce(hours, 0) END AS total_working_hours
      FROM ready),
    counted AS (SELECT *, CAST(trunc(total_working_hours / 27.0) AS DOUBLE) AS credits_calculated,
      CASE requested_type WHEN 'professional' THEN 30 WHEN 'general' THEN 10 END AS cap FROM settled),
    decided AS (SELECT *, CASE WHEN credits_calculated > cap THEN CAST(cap AS DOUBLE) ELSE credits_calculated END AS credits_qualified,
      CASE WHEN credits_calculated > cap THEN CAST(total_working_hours AS VARCHAR) || ' hours / 27 hours per ECTS = '
        || CAST(CAST(credits_calculated AS INTEGER) AS VARCHAR) || '.0 credits, capped at ' || CAST(cap AS VARCHAR)
        || '.0 maximum for ' || requested_type || ' training' ELSE 'No calculation breakdown provided' END AS calculation_breakdown,
      CASE WHEN NOT name_match OR future THEN 'REJECTED' WHEN requested_type = 'general' OR relevance IN ('high', 'medium')
        THEN 'ACCEPTED' ELSE 'REJECTED' END AS ai_decision,
      CASE WHEN name_match THEN relevance ELSE 'low' END AS degree_relevance,
      CASE WHEN NOT name_match THEN 'Certificate rejected due to name mismatch: ' || match_explanation
        WHEN future THEN 'The work experience cannot be evaluated because it contains dates after the current date ({AS_OF}). Working hours cannot be calculated for employment periods that have not yet occurred. The certificate must be corrected to show valid past dates before it can be processed.'
        ELSE 'Degree relevance is ' || relevance || ' for ' || requested_type || ' training' END AS ai_justification FROM counted)"""

EVALUATE_SQL = f"""{CATALOGUE_SQL}, {_WORDS_SQL},
    judged AS (SELECT pos.*, coalesce(json_extract_string(v.answer, '$.status') IN ('NOT_LEGITIMATE', 'UNVERIFIED'), false) AS bad
      FROM positions AS pos LEFT JOIN verdict_answers AS v ON pos.employer = v.employer),
    totals AS (SELECT certificate_id, count(*) AS n_positions, sum(date_diff('day', start_date, coalesce(end_date, issue_date)) + 1) AS days,
        max(greatest(start_date, end_date)) AS last_date, count(*) FILTER (coalesce(employer, '') <> '') AS checked,
        count(*) FILTER (coalesce(employer, '') <> '' AND bad) AS bad
      FROM judged JOIN extractions USING (certificate_id) GROUP BY certificate_id),
    docs AS (SELECT certificate_id, CAST(sum(hours) AS INTEGER) AS document_hours FROM additional_documents
      WHERE document_type = 'HOUR_DOCUMENTATION' GROUP BY certificate_id),
    once AS (SELECT DISTINCT degree AS d FROM students),
    programmes AS (SELECT d, {degree_sql('d')} AS programme_key FROM once),
    base AS (SELECT certificate_id, student_id, lower(training_type) AS requested_type, work_type, first_name, last_name,
        employee_name, programme_key, duties, issue_date, n_positions, coalesce(days, 0) AS days, last_date, checked, bad, document_hours
      FROM certificates JOIN students USING (student_id) JOIN programmes ON degree = d JOIN extractions USING (certificate_id)
        LEFT JOIN totals USING (certificate_id) LEFT JOIN docs USING (certificate_id)),
    {names_sql('base', '*')},
    ready AS (SELECT *, match_result IN ('match', 'partial_match') AS name_match,
        coalesce(greatest(last_date, issue_date) > DATE '{AS_OF}', false) AS future,
        CASE WHEN work_type = 'SELF_PACED' AND document_hours IS NOT NULL THEN document_hours
          ELSE CAST(round(days * 40.0::DOUBLE / 7) AS INTEGER) END AS hours,
        {relevance_sql(hits_sql('duties'))} AS relevance FROM named JOIN word_lists USING (programme_key)),
    {_SETTLE_SQL}"""

_EVALUATED = f"""
    SELECT certificate_id, student_id, requested_type, programme_key, CAST(total_working_hours AS INTEGER) AS total_working_hours,
      credits_calculated, credits_qualified, calculation_breakdown, degree_relevance, ai_decision, ai_justification,
      CASE WHEN coalesce(n_positions, 0) = 0 THEN 'UNVERIFIED' WHEN bad = 0 THEN 'LEGITIMATE' WHEN bad = checked
        THEN 'NOT_LEGITIMATE' ELSE 'PARTIALLY_LEGITIMATE' END AS company_validation_status,
      match_result AS name_validation_match_result, match_explanation AS name_validation_explanation
    FROM decided"""


def _facts(t):
    """What the evaluation needs of each certificate's extraction, positions and documented hours."""
    hours = t.additional_documents.where("document_type = 'HOUR_DOCUMENTATION'").select("certificate_id", "hours")
    return certificate_facts(t.extractions, t.positions.drop("duties"), hours, verdicts(t))


def _evaluator(t, facts_of=None):
    """Evaluation of any set of certificates against the other tables; their facts may come from a function of them."""
    catalogue, facts = degrees.degree_catalogue(keyword_table(t)), _facts(t)
    return lambda certificates: evaluate_facts(
        certificates, t.students, facts_of(certificates) if facts_of else facts, catalogue, AS_OF)


@query("evaluate_certificates", f"WITH {EVALUATE_SQL} {_EVALUATED}")
def _(t):
    return _evaluator(t)(t.certificates)


def _owned_texts(t):
    """Each text with a student; their numbers run from 0 without a gap, so texts go round the whole table."""
    return t.texts.join(t.students, F.col("student_id") == F.col("doc_id") % max(1, t.students.count()))


# an unusable text keeps its row but gets no result
_USABLE_SQL = ", ".join(
    f"CASE WHEN input_error IS NULL THEN {value} END AS {name}" for name, value in {
        "total_working_hours": "CAST(total_working_hours AS INTEGER)", "credits_calculated": "credits_calculated",
        "credits_qualified": "credits_qualified", "degree_relevance": "degree_relevance", "ai_decision": "ai_decision",
        "ai_justification": "ai_justification", "match_result": "match_result"}.items())


@query("evaluate_texts", f"""
    WITH {CATALOGUE_SQL}, {_WORDS_SQL},
    once AS (SELECT DISTINCT degree AS d FROM students),
    programmes AS (SELECT d, {degree_sql('d')} AS programme_key FROM once),
    owned AS (SELECT doc_id AS certificate_id, text, {INPUT_SQL} AS input_error, CASE WHEN doc_id % 2 = 0 THEN 'Matti' ELSE first_name END AS first_name,
        CASE WHEN doc_id % 2 = 0 THEN 'Virtanen' ELSE last_name END AS last_name, programme_key,
        CASE WHEN doc_id % 3 = 0 THEN 'professional' ELSE 'general' END AS requested_type
      FROM texts JOIN students ON student_id = doc_id % (SELECT count(*) FROM students) JOIN programmes ON degree = d),
    clean AS (SELECT * EXCLUDE (text), {SANITIZED_SQL} AS s FROM owned),
    prepared AS (SELECT *, s AS text FROM clean),
    {EXTRACT_SQL}, {names_sql('spans', '*')},
    ready AS (SELECT *, match_result IN ('match', 'partial_match') AS name_match,
        len(list_filter(positions, lambda p: p.a > '{AS_OF}' OR p.b > '{AS_OF}')) > 0 OR coalesce(issue_date > '{AS_OF}', false) AS future,
        CAST(round(coalesce(list_sum(list_transform(positions, lambda p: coalesce(date_diff('day', CAST(p.a AS DATE), CAST(p.b AS DATE)) + 1, 0))), 0)
          * coalesce(weekly_hours, 40.0 * coalesce(percent, 100.0) / 100)::DOUBLE / 7) AS INTEGER) AS hours,
        {relevance_sql(hits_sql('text'))} AS relevance FROM named JOIN word_lists USING (programme_key)),
    {_SETTLE_SQL}
    SELECT certificate_id, input_error, employee_name, employer, requested_type, programme_key,
      {_USABLE_SQL} FROM decided""", heavy=True)
def _(t):
    even = F.col("doc_id") % 2 == 0
    texts = _owned_texts(t).select(
        F.col("doc_id").alias("certificate_id"), "text",
        F.when(even, F.lit("Matti")).otherwise(F.col("first_name")).alias("first_name"),
        F.when(even, F.lit("Virtanen")).otherwise(F.col("last_name")).alias("last_name"), "degree",
        F.when(F.col("doc_id") % 3 == 0, F.lit("PROFESSIONAL")).otherwise(F.lit("GENERAL")).alias("training_type"))
    return evaluate_texts(texts, degrees.degree_catalogue(keyword_table(t)), AS_OF)


# --- state changes ---------------------------------------------------------------------------------------
_STATE = ("decision_id", "certificate_id", "student_comment", "reviewer_id", "reviewer_decision", "reviewer_comment")
_STATE_SQL = ", ".join(_STATE)


def _acts(t, kind: str):
    return t.actions.where(F.col("event_type") == kind)


def _latest_sql(name: str, kind: str, extra: str = "true") -> str:
    return (f"{name} AS (SELECT * FROM actions WHERE event_type = '{kind}' AND {extra} "
            "QUALIFY row_number() OVER (PARTITION BY certificate_id ORDER BY action_at DESC, action_id DESC) = 1)")


_VALID = "upper(reviewer_decision) IN ('PASS', 'FAIL')"


_REVIEWED_SQL = f"""
    WITH {_latest_sql('review', 'click', _VALID)},
    {_latest_sql('comment', 'click', _VALID + ' AND student_comment IS NOT NULL')}
    SELECT d.decision_id, certificate_id, coalesce(c.student_comment, d.student_comment) AS student_comment, d.reviewer_id,
      CASE WHEN r.action_id IS NOT NULL THEN upper(r.reviewer_decision) ELSE d.reviewer_decision END AS reviewer_decision,
      CASE WHEN r.action_id IS NOT NULL THEN r.reviewer_comment ELSE d.reviewer_comment END AS reviewer_comment,
      strftime(CASE WHEN r.action_id IS NOT NULL THEN r.action_at ELSE d.reviewed_at END, '%Y-%m-%d') AS reviewed_at
    FROM decisions AS d LEFT JOIN review AS r USING (certificate_id) LEFT JOIN comment AS c USING (certificate_id)"""


@query("apply_reviews", _REVIEWED_SQL)
def _(t):
    return state.apply_reviews(t.decisions, _acts(t, "click")).select(*_STATE, day("reviewed_at"))


@query("store_reviews", _REVIEWED_SQL)
def _(t):
    """Reviews merged into the stored decisions, twice: the second run changes nothing."""
    decisions = t.decisions.select(*_STATE, "reviewed_at")
    store = KeyedStore(t.spark, work_folder(t.spark, "decision-store"), "certificate_id", decisions.schema)
    store.add(decisions)
    for _ in range(2):
        reviews = _acts(t, "click")
        store.upsert(state.apply_reviews(store.matching(reviews), reviews))
    return store.read().select(*_STATE, day("reviewed_at"))


@query("rejected_reviews", f"""
    SELECT action_id, certificate_id, CASE WHEN NOT {_VALID} THEN {sql_text(state.BAD_REVIEW)} ELSE '{state.NOT_FOUND}' END AS reason
    FROM actions WHERE event_type = 'click' AND (NOT {_VALID} OR certificate_id NOT IN (SELECT certificate_id FROM decisions))""")
def _(t):
    return state.rejected_reviews(t.decisions, _acts(t, "click"))


@query("apply_feedback", f"""
    WITH {_latest_sql('feedback', 'view')}, {_latest_sql('chosen', 'view', 'reviewer_id IS NOT NULL')}
    SELECT d.decision_id, certificate_id, CASE WHEN f.action_id IS NOT NULL THEN f.student_comment ELSE d.student_comment END AS student_comment,
      coalesce(c.reviewer_id, d.reviewer_id) AS reviewer_id, d.reviewer_decision, d.reviewer_comment
    FROM decisions AS d LEFT JOIN feedback AS f USING (certificate_id) LEFT JOIN chosen AS c USING (certificate_id)""")
def _(t):
    return state.apply_feedback(t.decisions, _acts(t, "view")).select(*_STATE)


def _firsts_sql(kind: str) -> str:
    return f"""open_ones AS (SELECT certificate_id, max(coalesce(student_comment, '') <> '') AS taken FROM decisions GROUP BY certificate_id),
    firsts AS (SELECT * FROM actions WHERE event_type = '{kind}'
      QUALIFY row_number() OVER (PARTITION BY certificate_id ORDER BY action_at, action_id) = 1)"""


def _outcome_sql(kind: str) -> str:
    return f"""WITH {_firsts_sql(kind)}
    SELECT a.action_id, a.certificate_id, CASE WHEN taken IS NULL THEN '{state.NOT_FOUND}'
        WHEN taken OR a.action_id <> f.action_id THEN '{state.COMMENT_EXISTS}' ELSE 'accepted' END AS outcome
    FROM actions AS a LEFT JOIN open_ones USING (certificate_id) LEFT JOIN firsts AS f USING (certificate_id)
    WHERE a.event_type = '{kind}'"""


@query("apply_first_comment", f"""
    WITH {_firsts_sql('error')}
    SELECT d.decision_id, certificate_id, CASE WHEN NOT taken THEN coalesce(f.student_comment, d.student_comment)
      ELSE d.student_comment END AS student_comment, d.reviewer_id, d.reviewer_decision, d.reviewer_comment
    FROM decisions AS d JOIN open_ones USING (certificate_id) LEFT JOIN firsts AS f USING (certificate_id)""")
def _(t):
    return state.apply_first_comment(t.decisions, _acts(t, "error")).select(*_STATE)


@query("comment_outcomes", _outcome_sql("error"))
def _(t):
    return state.comment_outcomes(t.decisions, _acts(t, "error"))


@query("send_for_approval", f"""
    WITH {_latest_sql('sent', 'purchase')}
    SELECT d.decision_id, certificate_id, d.student_comment, CASE WHEN s.action_id IS NOT NULL THEN s.reviewer_id ELSE d.reviewer_id END
      AS reviewer_id, d.reviewer_decision, d.reviewer_comment
    FROM decisions AS d LEFT JOIN sent AS s USING (certificate_id)""")
def _(t):
    return state.send_for_approval(t.decisions, _acts(t, "purchase")).select(*_STATE)


@query("apply_appeals", f"""
    WITH {_firsts_sql('signup')}
    SELECT d.decision_id, certificate_id, CASE WHEN NOT taken AND f.action_id IS NOT NULL THEN f.student_comment ELSE d.student_comment END AS student_comment,
      CASE WHEN NOT taken AND f.action_id IS NOT NULL THEN coalesce(f.reviewer_id, (SELECT reviewer_id FROM reviewers
        ORDER BY first_name NULLS LAST, last_name NULLS LAST, reviewer_id LIMIT 1)) ELSE d.reviewer_id END AS reviewer_id,
      d.reviewer_decision, d.reviewer_comment
    FROM decisions AS d JOIN open_ones USING (certificate_id) LEFT JOIN firsts AS f USING (certificate_id)""")
def _(t):
    return state.apply_appeals(t.decisions, _acts(t, "signup"), t.reviewers).select(*_STATE)


@query("appeal_outcomes", _outcome_sql("signup"))
def _(t):
    return state.appeal_outcomes(t.decisions, _acts(t, "signup"), t.reviewers)


@query("delete_certificates", """
    WITH gone AS (SELECT certificate_id FROM actions WHERE event_type = 'purchase')
    SELECT 'certificates' AS table_name, CAST(certificate_id AS VARCHAR) AS row_id FROM certificates
      WHERE certificate_id NOT IN (SELECT certificate_id FROM gone)
    UNION ALL SELECT 'decisions', decision_id FROM decisions WHERE certificate_id NOT IN (SELECT certificate_id FROM gone)
    UNION ALL SELECT 'additional_documents', document_id FROM additional_documents
      WHERE certificate_id NOT IN (SELECT certificate_id FROM gone)""")
def _(t):
    kept = state.delete_certificates(_acts(t, "purchase"), t.certificates, t.decisions, t.additional_documents)
    ids = {"certificates": "certificate_id", "decisions": "decision_id", "additional_documents": "document_id"}
    out = None
    for name, table in kept.items():
        part = table.select(F.lit(name).alias("table_name"), F.col(ids[name]).cast("string").alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("store_deletes", """
    SELECT certificate_id, student_id FROM certificates
    WHERE certificate_id NOT IN (SELECT certificate_id FROM actions WHERE event_type = 'purchase')""")
def _(t):
    """Certificates deleted from their store, twice: the second run finds none."""
    certificates = t.certificates.select("certificate_id", "student_id")
    store = KeyedStore(t.spark, work_folder(t.spark, "certificate-store"), "certificate_id", certificates.schema)
    store.insert_new(certificates)
    for _ in range(2):
        store.delete(_acts(t, "purchase"))
    return store.read()


@query("attach_text", """
    SELECT certificate_id, coalesce(text, 'old text') AS ocr_output FROM certificates LEFT JOIN documents ON certificate_id = doc_id""")
def _(t):
    old = t.certificates.withColumn("ocr_output", F.lit("old text"))
    texts = t.documents.select(F.col("doc_id").alias("certificate_id"), "text")
    return state.attach_text(old, texts, "certificate_id").select("certificate_id", "ocr_output")


# --- callers ---------------------------------------------------------------------------------------------
# Deterministic stand-ins. They never run out of quota, so the result does not depend on how
# rows fall into partitions. Inner functions travel to the workers by value.


def _stand_ins():
    def short_only():
        def call(value):
            if len(value) > 2000:
                raise ValueError("document too long")
            return value.lower()

        return call

    def reader():
        def call(value):
            if value.startswith("Is"):
                raise ValueError("unreadable scan")
            return value

        return call

    return short_only, reader


@query("map_with_caller", """
    SELECT doc_id, CASE WHEN length(text) <= 2000 THEN lower(text) END AS answer, length(text) <= 2000 AS success,
      CASE WHEN length(text) > 2000 THEN 'document too long' END AS error, 'short' AS caller FROM documents""", heavy=True)
def _(t):
    short_only, reader = _stand_ins()
    return map_with_caller(t.documents, "text", ["doc_id"], [("short", short_only), ("spare", reader)]).drop("elapsed")


@query("map_with_answers", """
    SELECT doc_id, CASE WHEN length(text) <= 2000 THEN lower(text) END AS answer, length(text) <= 2000 AS success,
      CASE WHEN length(text) > 2000 THEN 'document too long' END AS error FROM documents""", heavy=True)
def _(t):
    """Several calls at a time, each text once; a second run finds the answers in the store."""
    store = KeyedStore(t.spark, work_folder(t.spark, "answer-store"), "prompt_hash", ANSWERS)
    short_only, _ = _stand_ins()
    for _ in range(2):
        rows = map_with_answers(t.documents, "text", ["doc_id"], [("short", short_only)], store, in_flight=4)
    return rows.drop("caller")


@query("process_documents", f"""
    WITH read AS (SELECT doc_id, starts_with(text, 'Is') AS failed, {sql_lines('text', K.LINE_BREAK_CLASS, 1)} AS text FROM texts)
    SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS file_name, NOT failed AS success,
      CAST(CASE WHEN failed THEN 0 ELSE length(text) END AS INTEGER) AS text_length,
      CASE WHEN NOT failed THEN {language_sql(K.WORKFLOW_KEYWORDS)} END AS detected_language,
      CAST(CASE WHEN failed THEN 0 ELSE length(text) - length(translate(lower(text), 'äöå', '')) END AS INTEGER) AS finnish_chars_count,
      CAST(CASE WHEN failed THEN 0 WHEN {language_sql(K.WORKFLOW_KEYWORDS)} = 'fin' THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence,
      CASE WHEN failed THEN 'unreadable scan' END AS error FROM read""", heavy=True)
def _(t):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    documents = t.texts.select(F.concat_ws("/", "source", name).alias("path"), name.alias("file_name"),
                               F.length("text").cast("long").alias("size"), F.lit("pdf").alias("suffix"), "text")
    return process_documents(documents, "text", [("reader", _stand_ins()[1])]).select(
        "file_name", "success", "text_length", "detected_language", "finnish_chars_count",
        F.round("confidence", 4).alias("confidence"), "error")


# --- streams ------------------------------------------------------------------------------------------------
def _dropped(t, table, drops: int):
    """A table as drops of files that arrive, two drops at a time; a drop has as many files as its rows need."""
    folder = work_folder(t.spark, "drops")
    numbered = table.withColumn("drop", F.pmod(F.xxhash64("certificate_id"), F.lit(drops)).cast("int"))
    numbered.hint("rebalance", "drop").write.partitionBy("drop").parquet(folder)
    files = len(t.spark.read.schema(table.schema).parquet(folder).inputFiles())
    return read_arrivals(t.spark, table.schema, f"{folder}/*", files_per_batch=max(1, -(-2 * files // drops)))


@query("stream_evaluate", f"WITH {EVALUATE_SQL} {_EVALUATED}")
def _(t):
    """Certificates in several drops; ends when all are evaluated. What belongs to certificates is totalled once and
    lies in buckets: a batch reads its own, and none joins and totals the whole tables again."""
    rows = _facts(t)
    facts = KeyedStore(t.spark, work_folder(t.spark, "facts"), "certificate_id", rows.schema)
    facts.add(rows)
    evaluate = _evaluator(t, lambda certificates: facts.read(facts.buckets_of(certificates)))
    output = KeyedStore(t.spark, work_folder(t.spark, "stream-decisions"), "certificate_id", evaluate(t.certificates.limit(0)).schema)
    stream_evaluate(_dropped(t, t.certificates, 6), evaluate, output, work_folder(t.spark, "stream-state")).awaitTermination()
    return output.read()


@query("stream_status", """
    SELECT certificate_id, CASE WHEN decision_id IS NULL THEN 'processing' ELSE 'completed' END AS status,
      ai_decision, total_working_hours FROM certificates LEFT JOIN decisions USING (certificate_id)""")
def _(t):
    """Certificates and decisions in several drops; the last status of each certificate."""
    output = work_folder(t.spark, "stream-status")
    stream_status(_dropped(t, t.certificates, 6), _dropped(t, t.decisions, 4), output,
                  work_folder(t.spark, "stream-state")).awaitTermination()
    return last_status(t.spark.read.parquet(output)).select("certificate_id", "status", "ai_decision", "total_working_hours")


# --- evaluation with a model -------------------------------------------------------------------------------
# a scripted stand-in for the model: its answers depend on the prompt alone


def _scripted_model():
    def extraction():
        def call(prompt):
            if "Pekka Korhonen" in prompt:
                return ("```json\n{'employee_name': 'Pekka Korhonen', 'employer': 'Pohjola Terminal Oyj', 'employer_address': '', "
                        "'positions': [{'title': null, 'employer': 'Pohjola Terminal Oyj', 'start_date': '13.2.1984', "
                        "'end_date': '30.9.2009'}], 'total_employment_period': '25 years', 'document_language': 'fi',}\n```")
            if "Matti" in prompt:
                return ('{"employee_name": "Matti Virtanen", "employer": "Nordic Metal Oy", "positions": '
                        '[{"title": "Welder", "employer": "Nordic Metal Oy"}, {"title": "Clerk", "employer": "Paper Group"}]}')
            if "Acme Group" in prompt:
                raise RuntimeError("model overloaded")
            return "I could not find anything."

        return call

    def evaluation():
        def call(prompt):
            hours = "837" if "Requested: professional" in prompt else '"many"' if "Sosionomi" in prompt else "320"
            return ('{"Total Working Hours": ' + hours + ', "Degree Relevance": "closely related", '
                    '"Recommendation": "Approve"}')

        return call

    def company():
        def call(prompt):
            if "Paper Group" in prompt:
                return '{"status": "UNVERIFIED"}'
            return "The company is real."

        return call

    def validation():
        def call(prompt):
            return ('{"requires_correction": true, "issues_found": [{"type": "business_rule", "severity": "low", '
                    '"description": "d", "field_affected": "f", "suggestion": "s"}]}')

        return call

    def correction():
        def call(prompt):
            return '{"evaluation_results": {"credits_qualified": 5}}'

        return call

    return {f.__name__: [("scripted", f)] for f in (extraction, evaluation, company, validation, correction)}


_SCRIPT_SQL = f"""once AS (SELECT DISTINCT degree AS d FROM students),
    programmes AS (SELECT d, {degree_sql('d')} AS programme_key FROM once),
    owned AS (SELECT doc_id AS certificate_id, text, CASE WHEN doc_id % 3 = 0 THEN 'professional' ELSE 'general' END AS kind,
        CASE doc_id % 4 WHEN 0 THEN 'Matti' WHEN 1 THEN 'Pekka' ELSE first_name END AS first_name,
        CASE doc_id % 4 WHEN 0 THEN 'Virtanen' WHEN 1 THEN 'Korhonen' ELSE last_name END AS last_name, programme_key, {INPUT_SQL} AS problem
      FROM texts JOIN students ON student_id = doc_id % (SELECT count(*) FROM students) JOIN programmes ON degree = d),
    clean AS (SELECT *, {SANITIZED_SQL} AS s FROM owned),
    cut AS (SELECT *, s AS seen FROM clean),
    answered AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'unusable' WHEN contains(seen, 'Pekka Korhonen') THEN 'pekka'
      WHEN contains(seen, 'Matti') THEN 'matti' WHEN contains(seen, 'Acme Group') THEN 'failed' ELSE 'blank' END AS way FROM cut),
    outcome AS (SELECT *, CASE WHEN way = 'unusable' THEN problem WHEN way = 'failed' THEN 'Extraction failed: model overloaded'
        WHEN way IN ('pekka', 'matti') AND kind = 'general' AND programme_key LIKE 'sosionomi%' THEN 'Working hours are not a number: many' END AS error,
      way = 'blank' AS mismatch FROM answered)"""


@query("evaluate_with_model", f"""
    WITH {_SCRIPT_SQL}
    SELECT certificate_id, error IS NULL AS success, error,
      CASE WHEN error IS NULL THEN CASE WHEN mismatch THEN 'REJECTED' ELSE 'ACCEPTED' END END AS ai_decision,
      CASE WHEN error IS NULL THEN CASE WHEN mismatch THEN 0.0 WHEN kind = 'professional' THEN 837.0 ELSE 320.0 END END::DOUBLE AS total_working_hours,
      CASE WHEN error IS NULL THEN CASE WHEN mismatch THEN 0.0 WHEN kind = 'professional' THEN 30.0 ELSE 10.0 END END::DOUBLE AS credits_qualified,
      CASE WHEN error IS NULL THEN CASE WHEN mismatch THEN 'Unknown' WHEN way = 'pekka' THEN 'Pohjola Terminal Oyj'
        ELSE 'Nordic Metal Oy' END END AS training_institution,
      CASE WHEN error IS NULL THEN CASE WHEN mismatch THEN 'low' ELSE 'high' END END AS degree_relevance,
      CASE WHEN error IS NULL THEN CASE WHEN mismatch THEN 'UNVERIFIED' WHEN way = 'pekka' THEN 'LEGITIMATE'
        ELSE 'PARTIALLY_LEGITIMATE' END END AS company_validation_status,
      CASE WHEN error IS NULL THEN CASE WHEN mismatch THEN 'unknown' ELSE 'match' END END AS name_validation_match_result,
      CASE WHEN error IS NULL THEN CASE WHEN mismatch THEN 'name_mismatch' WHEN way = 'pekka' THEN 'business_rule'
        ELSE 'business_rule,company_validation_error' END END AS issue_types,
      CASE WHEN error IS NULL THEN false END AS corrected
    FROM outcome""", heavy=True)
def _(t):
    place = F.col("doc_id") % 4
    texts = _owned_texts(t)
    certificates = texts.select(
        F.col("doc_id").alias("certificate_id"), F.col("doc_id").alias("student_id"), "text",
        F.when(F.col("doc_id") % 3 == 0, F.lit("PROFESSIONAL")).otherwise(F.lit("GENERAL")).alias("training_type"))
    owners = texts.select(
        F.col("doc_id").alias("student_id"), "degree",
        F.when(place == 0, F.lit("Matti")).when(place == 1, F.lit("Pekka")).otherwise(F.col("first_name")).alias("first_name"),
        F.when(place == 0, F.lit("Virtanen")).when(place == 1, F.lit("Korhonen")).otherwise(F.col("last_name")).alias("last_name"))
    rows = evaluate_with_model(certificates, owners, degrees.degree_catalogue(keyword_table(t)), _scripted_model(), AS_OF)
    return rows.select(
        "certificate_id", "success", "error", "ai_decision", "total_working_hours", "credits_qualified",
        "training_institution", "degree_relevance", "company_validation_status", "name_validation_match_result",
        F.array_join(F.transform("issues_found", lambda i: i["type"]), ",").alias("issue_types"), "corrected")
