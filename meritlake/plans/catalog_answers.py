"""Model answers: slicing, repair, cleaning, company answers, nested workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions import answers as N
from meritlake.functions import companies as C
from meritlake.functions import rules as R
from meritlake.operators import nested
from meritlake.operators.segments import arrays_in_order
from meritlake.operators.statistics import company_issues
from meritlake.plans.catalog import query, sql_contains_any, sql_strip, sql_text
from meritlake.plans.catalog_relational import verdicts
from meritlake.schemas import ISSUE

_SLICE = "nullif(regexp_extract(answer, '(?s)\\{.*\\}', 0), '')"
_WORD = "[\\p{L}\\p{N}_]"
_REPAIR = (f"regexp_replace(replace(regexp_replace(s, '(\\s*)({_WORD}+)(\\s*):', '\\1\"\\2\"\\3:', 'g'), '''', '\"'), "
           "',(\\s*[}\\]])', '\\1', 'g')")


def _object(text: str) -> str:
    return f"CASE WHEN json_valid({text}) AND json_type({text}) = 'OBJECT' THEN {text} END"


def _parsed(view: str, key: str) -> str:
    """CTEs: sliced, repaired, and ``parsed`` with the usable JSON ``j`` and the path."""
    return f"""sliced AS (SELECT {key}, answer, {_SLICE} AS s FROM {view}),
    repaired AS (SELECT *, {_REPAIR} AS r FROM sliced),
    parsed AS (SELECT *, coalesce({_object('s')}, {_object('r')}) AS j,
      CASE WHEN {_object('s')} IS NOT NULL THEN 'direct' WHEN {_object('r')} IS NOT NULL THEN 'repaired'
        ELSE 'fallback' END AS parse_path FROM repaired)"""


_ANSWERS = _parsed("answers", "certificate_id")


@query("slice_json", f"""
    WITH {_ANSWERS} SELECT certificate_id, s AS sliced, {_object('s')} IS NOT NULL AS is_object FROM parsed""", heavy=True)
def _(t):
    sliced = t.answers.select("certificate_id", N.slice_json(F.col("answer")).alias("sliced"))
    return sliced.withColumn("is_object", N.parse_object(F.col("sliced")).isNotNull())


@query("repair_json", f"""
    WITH {_ANSWERS} SELECT certificate_id, r AS repaired, parse_path FROM parsed""", heavy=True)
def _(t):
    return N.parse_answers(t.answers, "answer", "repaired").select("certificate_id", "repaired", "parse_path")


def _fallback_sql(name: str) -> str:
    return (f"CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.{name}') ELSE "
            f"coalesce(nullif(regexp_extract(s, '\"{name}\"\\s*:\\s*\"([^\"]+)\"', 1), ''), 'Unknown') END")


@query("fallback_extraction", f"""
    WITH {_ANSWERS}
    SELECT certificate_id, parse_path, {_fallback_sql('employee_name')} AS employee_name,
      {_fallback_sql('employer')} AS employer, {_fallback_sql('position')} AS position,
      CASE WHEN j IS NULL THEN {sql_text(K.FALLBACK_NOTE)} ELSE json_extract_string(j, '$.extraction_notes') END AS extraction_notes
    FROM parsed""", heavy=True)
def _(t):
    m = F.col("fields")
    return N.parse_answers(t.answers, "answer").select(
        "certificate_id", "parse_path", *[m[name].alias(name) for name in (
            "employee_name", "employer", "position", "extraction_notes")])


@query("clean_extraction", f"""
    WITH {_ANSWERS},
    items AS (SELECT certificate_id, parse_path, s, j, list_filter(CAST(json_extract(j, '$.positions') AS JSON[]),
        lambda p: json_type(p) = 'OBJECT') AS ps FROM parsed)
    SELECT certificate_id, coalesce({_fallback_sql('employee_name')}, 'Unknown Employee') AS employee_name,
      array_to_string(list_transform(ps, lambda p: coalesce(json_extract_string(p, '$.title'), 'Unknown Position') || '@'
        || coalesce(json_extract_string(p, '$.employer'), 'Unknown Employer') || '@' || json_extract_string(p, '$.start_date')), ';') AS positions,
      CASE WHEN parse_path = 'fallback' THEN 'en' ELSE json_extract_string(j, '$.document_language') END AS document_language
    FROM items""", heavy=True)
def _(t):
    parsed = N.parse_answers(t.answers, "answer")
    cleaned = parsed.select("certificate_id", N.clean_extraction(F.col("fields")).alias("x"))
    return cleaned.select(
        "certificate_id", "x.employee_name",
        F.array_join(F.transform("x.positions", lambda p: F.concat_ws(
            "@", p["title"], p["employer"], p["start_date"])), ";").alias("positions"),
        "x.document_language")


# --- evaluation answers -----------------------------------------------------------------------
_EVALUATIONS = _parsed("evaluation_answers", "certificate_id")


def _has(key: str) -> str:
    return f"list_contains(json_keys(j), {sql_text(key)})"


def _get(key: str) -> str:
    return f"""json_extract_string(j, '$."{key}"')"""


def _first(*keys: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(k)} THEN {_get(k)}" for k in keys) + " END"


def _alias(target: str) -> str:
    return _first(target, *[s for s, f in K.EVALUATION_ALIASES if f == target and s != target])


_ALIASED = ("total_working_hours", "credits_calculated", "justification", "relevance_explanation",
            "calculation_breakdown", "summary_justification", "evidence_analysis")


@query("alias_evaluation_fields", f"""
    WITH {_EVALUATIONS} SELECT certificate_id, {', '.join(f'{_alias(n)} AS {n}' for n in _ALIASED)} FROM parsed""", heavy=True)
def _(t):
    parsed = N.parse_answers(t.evaluation_answers, "answer")
    return parsed.select("certificate_id", *[N.alias_field(F.col("fields"), n).alias(n) for n in _ALIASED])


def _category_sql(text: str) -> str:
    rules = " ".join(f"WHEN {sql_contains_any(f'lower({text})', phrases)} THEN '{level}'"
                     for level, phrases in K.RELEVANCE_RULES)
    return f"CASE {rules} ELSE 'low' END"


_RELEVANCE = (f"coalesce(CASE WHEN {_has('degree_relevance')} THEN {_get('degree_relevance')} "
              f"WHEN coalesce({_get('Degree Relevance')}, '') <> '' THEN {_category_sql(_get('Degree Relevance'))} END, 'low')")


@query("relevance_category", f"""
    WITH {_EVALUATIONS}
    SELECT certificate_id AS id, {_RELEVANCE} AS category FROM parsed
    UNION ALL SELECT doc_id, {_category_sql('text')} FROM texts""", heavy=True)
def _(t):
    parsed = N.parse_answers(t.evaluation_answers, "answer")
    return parsed.select(F.col("certificate_id").alias("id"), N.degree_relevance(F.col("fields")).alias("category")).unionByName(
        t.texts.select(F.col("doc_id").alias("id"), N.relevance_category(F.col("text")).alias("category")))


def _evidence_sql(side: str, field: str) -> str:
    source = _first("Evidence Analysis", "evidence_analysis")
    inner = f"""coalesce(json_extract_string(j, '$."Evidence Analysis".{side}_professional_training'), json_extract_string(j, '$.evidence_analysis.{side}_professional_training'))"""
    return f"coalesce(CASE WHEN starts_with({source}, '{{') THEN {inner} END, {_get(field)})"


@query("split_evidence", f"""
    WITH {_EVALUATIONS}
    SELECT certificate_id, {_evidence_sql('for', 'supporting_evidence')} AS supporting_evidence,
      {_evidence_sql('against', 'challenging_evidence')} AS challenging_evidence FROM parsed""", heavy=True)
def _(t):
    m = F.col("fields")
    return N.parse_answers(t.evaluation_answers, "answer").select(
        "certificate_id", N.evidence(m, "for", "supporting_evidence").alias("supporting_evidence"),
        N.evidence(m, "against", "challenging_evidence").alias("challenging_evidence"))


_ADVICE = f"lower(nullif({_first('Recommendation', 'recommendation')}, ''))"
_ECHOED = f"lower(coalesce({_get('requested_training_type')}, ''))"
_DECISION = f"""CASE WHEN {_has('decision')} OR {_has('Decision')} THEN coalesce({_first('decision', 'Decision')}, 'REJECTED')
      WHEN {_ADVICE} IS NULL THEN 'REJECTED'
      WHEN contains({_ADVICE}, 'general training') THEN CASE WHEN {_ECHOED} = 'professional' THEN 'REJECTED' ELSE 'ACCEPTED' END
      WHEN contains({_ADVICE}, 'professional training') THEN 'ACCEPTED'
      WHEN {sql_contains_any(_ADVICE, ('reject', 'deny'))} THEN 'REJECTED'
      WHEN {sql_contains_any(_ADVICE, ('accept', 'approve'))} THEN 'ACCEPTED'
      WHEN {_ECHOED} = 'professional' AND contains({_ADVICE}, 'general') THEN 'REJECTED' ELSE 'ACCEPTED' END"""


@query("infer_decision", f"WITH {_EVALUATIONS} SELECT certificate_id, {_DECISION} AS decision FROM parsed", heavy=True)
def _(t):
    m = F.col("fields")
    return N.parse_answers(t.evaluation_answers, "answer").select(
        "certificate_id", N.infer_decision(m, F.coalesce(m["requested_training_type"], F.lit(""))).alias("decision"))


_GIVEN = _alias("justification")
_JUSTIFICATION = f"""CASE WHEN {_GIVEN} IS NULL OR {_GIVEN} = '{K.NO_JUSTIFICATION}' THEN
        CASE WHEN {_has('recommendation')} OR {_has('Recommendation')} THEN {_first('recommendation', 'Recommendation')}
          ELSE '{K.NO_JUSTIFICATION}' END
      WHEN starts_with({_GIVEN}, '{{') THEN coalesce(json_extract_string(j, '$.justification.justification'), {_GIVEN})
      ELSE {_GIVEN} END"""


@query("normalise_justification", f"WITH {_EVALUATIONS} SELECT certificate_id, {_JUSTIFICATION} AS justification FROM parsed", heavy=True)
def _(t):
    return N.parse_answers(t.evaluation_answers, "answer").select(
        "certificate_id", N.normalise_justification(F.col("fields")).alias("justification"))


@query("fill_evaluation_defaults", f"""
    WITH {_EVALUATIONS}
    SELECT certificate_id, {_RELEVANCE} AS degree_relevance,
      coalesce({_alias('relevance_explanation')}, 'No explanation provided') AS relevance_explanation,
      coalesce({_alias('calculation_breakdown')}, 'No calculation breakdown provided') AS calculation_breakdown,
      coalesce({_alias('summary_justification')}, 'No summary justification provided') AS summary_justification,
      coalesce({_alias('total_working_hours')}, '0') AS total_working_hours,
      CAST(coalesce({_alias('credits_calculated')}, '0.0') AS DOUBLE) AS credits_calculated,
      CAST(coalesce({_get('credits_qualified')}, '0.0') AS DOUBLE) AS credits_qualified
    FROM parsed""", heavy=True)
def _(t):
    cleaned = N.clean_evaluation(N.parse_answers(t.evaluation_answers, "answer"))
    return cleaned.select(
        "certificate_id", "degree_relevance", "relevance_explanation", "calculation_breakdown",
        "summary_justification", "total_working_hours",
        F.col("credits_calculated").try_cast("double").alias("credits_calculated"),
        F.col("credits_qualified").try_cast("double").alias("credits_qualified"))


# --- company answers ------------------------------------------------------------------------------
_LOW = "lower(answer)"
_BAD = sql_contains_any(_LOW, K.SUSPICIOUS_WORDS)
_GOOD = sql_contains_any(_LOW, K.POSITIVE_WORDS)
_EVIDENCE = f"""list_filter([
      CASE WHEN contains({_LOW}, 'website') THEN CASE WHEN contains(answer, 'teboil.fi')
        THEN 'Website: teboil.fi (official company website)' ELSE 'Website: Company website found and verified' END END,
      CASE WHEN {sql_contains_any(_LOW, ('database', 'registry'))} THEN CASE WHEN contains({_LOW}, 'ytunnus')
        THEN 'Business Registry: Finnish Y-tunnus database verified' WHEN contains({_LOW}, 'business registry')
        THEN 'Business Registry: Business registry information found' END END,
      CASE WHEN contains({_LOW}, 'address') AND {sql_contains_any(_LOW, ('match', 'verified'))} THEN
        CASE WHEN contains({_LOW}, 'sauvontie') THEN 'Address Verification: Sauvontie 9, 21510 Hevonpää confirmed'
        ELSE 'Address Verification: Address verified online' END END,
      CASE WHEN {sql_contains_any(_LOW, ('fuel', 'retail'))} THEN 'Industry: Fuel retail operations confirmed'
        WHEN contains({_LOW}, 'industry') THEN 'Industry: Industry information verified' END,
      CASE WHEN {sql_contains_any(_LOW, ('news', 'article'))} THEN 'Media: News articles and media coverage found' END
    ], lambda x: x IS NOT NULL)"""
_DEFAULTS = "[" + ", ".join(sql_text(e) for e in K.DEFAULT_COMPANY_EVIDENCE) + "]"


def _field(name: str, default: str) -> str:
    return (f"CASE WHEN list_contains(json_keys(j), '{name}') THEN json_extract_string(j, '$.{name}') "
            f"ELSE {sql_text(default)} END")


@query("parse_company_answer", f"""
    WITH cut AS (SELECT doc_id, answer, {_SLICE} AS s FROM company_answers),
    way AS (SELECT *, CASE WHEN coalesce(answer, '') = '' THEN 'none'
        WHEN json_valid(answer) THEN CASE WHEN json_type(answer) = 'OBJECT' THEN 'json' ELSE 'none' END
        WHEN s IS NULL THEN 'paragraph' WHEN {_object('s')} IS NOT NULL THEN 'sliced' ELSE 'last_resort' END AS answer_path
      FROM cut),
    obj AS (SELECT *, CASE WHEN answer_path IN ('json', 'sliced') THEN s END AS j FROM way)
    SELECT doc_id, answer_path,
      CASE answer_path WHEN 'none' THEN 'UNVERIFIED' WHEN 'paragraph' THEN CASE WHEN {_BAD} THEN 'NOT_LEGITIMATE' ELSE 'LEGITIMATE' END
        WHEN 'last_resort' THEN CASE WHEN {_GOOD} OR NOT {_BAD} THEN 'LEGITIMATE' ELSE 'NOT_LEGITIMATE' END
        ELSE {_field('status', 'UNVERIFIED')} END AS status,
      CASE answer_path WHEN 'none' THEN 'low' WHEN 'paragraph' THEN CASE WHEN {_BAD} THEN 'low' ELSE 'high' END
        WHEN 'last_resort' THEN CASE WHEN {_GOOD} OR NOT {_BAD} THEN 'medium' ELSE 'low' END
        ELSE {_field('confidence', 'low')} END AS confidence,
      CASE answer_path WHEN 'none' THEN 'medium' WHEN 'paragraph' THEN CASE WHEN {_BAD} THEN 'high' ELSE 'very_low' END
        WHEN 'last_resort' THEN CASE WHEN {_GOOD} THEN 'low' WHEN {_BAD} THEN 'high' ELSE 'medium' END
        ELSE {_field('risk_level', 'unknown')} END AS risk_level,
      CASE answer_path WHEN 'none' THEN 'LLM validation failed, defaulting to unverified' WHEN 'paragraph' THEN {sql_strip('answer')}
        WHEN 'last_resort' THEN 'LLM response parsing failed. Fallback analysis suggests: ' || CASE WHEN {_GOOD} OR NOT {_BAD}
          THEN 'legitimate' ELSE 'suspicious' END || ' company. Raw response: ' || substr(answer, 1, 100) || '...'
        ELSE {_field('justification', 'No detailed explanation provided')} END AS justification,
      array_to_string(CASE answer_path WHEN 'none' THEN ['LLM validation failed'] WHEN 'paragraph' THEN
          CASE WHEN len({_EVIDENCE}) > 0 THEN {_EVIDENCE} ELSE {_DEFAULTS} END
        WHEN 'last_resort' THEN ['Fallback analysis due to parsing error']
        ELSE coalesce(CAST(json_extract(j, '$.supporting_evidence') AS VARCHAR[]), []) END, '; ') AS evidence,
      CASE answer_path WHEN 'none' THEN true WHEN 'paragraph' THEN {_BAD} WHEN 'last_resort' THEN true
        ELSE coalesce(json_extract_string(j, '$.requires_review') = 'true', false) END AS requires_review,
      coalesce(CASE answer_path WHEN 'none' THEN false WHEN 'paragraph' THEN {_BAD} WHEN 'last_resort' THEN NOT ({_GOOD} OR NOT {_BAD})
        ELSE {_field('status', 'UNVERIFIED')} IN ('NOT_LEGITIMATE', 'UNVERIFIED') END, false) AS counts_as_bad
    FROM obj""", heavy=True)
def _(t):
    return C.parse_company_answers(t.company_answers, "answer").select(
        "doc_id", "answer_path", "company.status", "company.confidence", "company.risk_level",
        "company.justification", F.array_join("company.supporting_evidence", "; ").alias("evidence"),
        "company.requires_review", "counts_as_bad")


# --- nested workflows --------------------------------------------------------------------------------
_J = "ai_workflow_json"


def _at(path: str) -> str:
    return f"json_extract_string({_J}, '$.{path}')"


_COMPANIES = f"json_array_length({_J}, '$.validation_results.results.company_validation.companies')"


@query("flatten_decision", f"""
    SELECT certificate_id, CASE WHEN {_at('evaluation_results.results.decision')} = 'ACCEPTED' THEN 'ACCEPTED' ELSE 'REJECTED' END AS ai_decision,
      {_at('evaluation_results.results.justification')} AS ai_justification,
      CAST({_at('evaluation_results.results.total_working_hours')} AS INTEGER) AS total_working_hours,
      CAST(CAST({_at('evaluation_results.results.credits_qualified')} AS DOUBLE) AS INTEGER) AS credits_awarded,
      coalesce({_at('extraction_results.results.total_employment_period')}, 'Not specified') AS training_duration,
      coalesce({_at('extraction_results.results.employer')}, 'Not specified') AS training_institution,
      {_at('evaluation_results.results.degree_relevance')} AS degree_relevance,
      coalesce({_at('evaluation_results.results.recommendation')}, '') AS recommendation,
      coalesce({_at('validation_results.results.company_validation.status')}, 'UNVERIFIED') AS company_validation_status,
      CASE WHEN {_COMPANIES} > 0 THEN '[' || json_object('name', {_at('validation_results.results.company_validation.companies[0].name')},
          'status', 'LEGITIMATE', 'confidence', 'high') || ']'
        ELSE 'Overall Status: ' || {_at('validation_results.results.company_validation.status')} || chr(10) || 'No individual company details available.'
        END AS company_validation_justification,
      {_at('validation_results.results.name_validation.match_result')} AS name_validation_match_result,
      {_at('validation_results.results.name_validation.explanation')} AS name_validation_explanation
    FROM workflows""")
def _(t):
    w = t.workflows.select("certificate_id", nested.parse_workflow(F.col(_J)).alias("workflow"))
    return nested.flatten_decision(w).drop("ai_workflow_json", "supporting_evidence", "challenging_evidence")


@query("failed_workflows", """
    SELECT certificate_id, CASE certificate_id % 9 WHEN 0 THEN 'Extraction failed' ELSE 'Unknown error' END AS error
    FROM workflows WHERE certificate_id % 9 IN (0, 1, 2)""")
def _(t):
    """Of nine workflows one failed with an error, one without, and one is no JSON."""
    place = F.col("certificate_id") % 9
    stored = (F.when(place == 0, F.lit('{"success":false,"error":"Extraction failed"}')).when(place == 1, F.lit('{"success":false}'))
              .when(place == 2, F.substring(_J, 2, 40)).otherwise(F.col(_J)))
    return nested.failed_workflows(t.workflows.select("certificate_id", nested.parse_workflow(stored).alias("workflow")))


@query("merge_validation", f"""
    WITH added AS (SELECT certificate_id, count(*) AS n, string_agg(employer, ',' ORDER BY employer) AS names
      FROM positions JOIN verdict_answers USING (employer)
      WHERE json_extract_string(answer, '$.status') IN ('NOT_LEGITIMATE', 'UNVERIFIED') GROUP BY certificate_id)
    SELECT certificate_id, CAST(json_array_length({_J}, '$.validation_results.results.issues_found') + coalesce(n, 0) AS INTEGER) AS n_issues,
      coalesce(names, '') AS company_names, 'UNVERIFIED' AS company_status, 'match' AS match_result
    FROM workflows LEFT JOIN added USING (certificate_id)""")
def _(t):
    """One row for each answer, with the issues of all its companies after its own."""
    place = ["line", "part_id", "supplier_id", "start_date"]
    issues = company_issues(t.positions, verdicts(t), place)
    added = arrays_in_order(
        issues, ["certificate_id"], [F.col(c) for c in place],
        F.struct(*[c for c in issues.columns if c not in ("certificate_id", *place)]).cast(ISSUE), "added")
    w = t.workflows.select("certificate_id", nested.parse_workflow(F.col(_J)).alias("w"))
    joined = w.join(added, "certificate_id", "left")
    validation = F.col("w.validation_results.results")
    merged = joined.select("certificate_id", nested.merge_validation(
        validation, validation["company_validation"].withField("status", F.lit("UNVERIFIED")),
        F.struct(F.lit("match").alias("match_result"), F.lit(1.0).alias("match_confidence"), F.lit("").alias("explanation")),
        F.col("added")).alias("v"))
    names = F.transform(
        F.filter("v.issues_found", lambda i: i["type"] == "company_validation_error"),
        lambda i: F.regexp_extract(i["description"], ": (.*)$", 1))
    return merged.select(
        "certificate_id", F.size("v.issues_found").alias("n_issues"),
        F.array_join(F.array_sort(names), ",").alias("company_names"),
        F.col("v.company_validation.status").alias("company_status"), F.col("v.name_validation.match_result"))


_ENTITY_SQL = {
    "students": "json_object('student_id', CAST(student_id AS VARCHAR), 'email', email, 'degree', degree, 'first_name', first_name, 'last_name', last_name)",
    "certificates": "json_object('certificate_id', CAST(certificate_id AS VARCHAR), 'filename', filename, 'training_type', training_type, 'uploaded_at', strftime(uploaded_at, '%Y-%m-%d %H:%M:%S'))",
    "reviewers": "json_object('reviewer_id', CAST(reviewer_id AS VARCHAR), 'email', email, 'first_name', first_name, 'last_name', last_name, 'position', position, 'department', department)",
    "additional_documents": "json_object('document_id', document_id, 'certificate_id', CAST(certificate_id AS VARCHAR), 'document_type', document_type, 'filename', filename, 'filetype', filetype, 'uploaded_at', strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S'), 'ocr_output', ocr_output)",
    "decisions": "json_object(" + ", ".join(
        f"'{c}', " + (f"strftime({c}, '%Y-%m-%dT%H:%M:%S')" if c in ("created_at", "reviewed_at")
                      else f"CAST({c} AS VARCHAR)" if c.endswith("_id") else c)
        for c in nested.ENTITY_FIELDS["decisions"])
    + ", 'name_validation', CASE WHEN name_validation_match_result IS NOT NULL THEN json_object('match_result', "
      "name_validation_match_result, 'explanation', name_validation_explanation) END)",
}


@query("entity_to_json", " UNION ALL ".join(
    f"SELECT '{name}' AS entity, CAST({sql} AS VARCHAR) AS json FROM {name}" for name, sql in _ENTITY_SQL.items()))
def _(t):
    out = None
    for name in _ENTITY_SQL:
        part = getattr(t, name).select(F.lit(name).alias("entity"), nested.entity_to_json(name).alias("json"))
        out = part if out is None else out.unionByName(part)
    return out


_ISSUE_ITEMS = f"""unnest(CASE WHEN json_array_length({_J}, '$.validation_results.results.issues_found') = 0 THEN [NULL]
      ELSE CAST(json_extract({_J}, '$.validation_results.results.issues_found') AS JSON[]) END) AS i"""


@query("explode_issues", f"""
    SELECT certificate_id, json_extract_string(i, '$.type') AS type, json_extract_string(i, '$.severity') AS severity,
      json_extract_string(i, '$.description') AS description, json_extract_string(i, '$.field_affected') AS field_affected,
      json_extract_string(i, '$.suggestion') AS suggestion, CAST(json_extract_string(i, '$.position_index') AS INTEGER) AS position_index
    FROM (SELECT certificate_id, {_ISSUE_ITEMS} FROM workflows)""")
def _(t):
    return nested.explode_issues(_issues(t))


def _issues(t):
    return t.workflows.select("certificate_id", nested.parse_workflow(F.col(_J)).alias("w")).select(
        "certificate_id", F.col("w.validation_results.results.issues_found"))


@query("issue_counts", f"""
    SELECT json_extract_string(i, '$.severity') AS severity, count(*) AS n
    FROM (SELECT certificate_id, {_ISSUE_ITEMS} FROM workflows) WHERE i IS NOT NULL GROUP BY 1""")
def _(t):
    return nested.issue_counts(nested.explode_issues(_issues(t)))


# --- checks and gates -----------------------------------------------------------------------------------
_AS_OF = "2000-01-15"


def _bad_text(path: str, nullable: bool) -> str:
    allowed = "('VARCHAR', 'NULL')" if nullable else "('VARCHAR')"
    return f"coalesce(json_type(s, '$.{path}') NOT IN {allowed}, false)"


@query("check_extraction", f"""
    WITH {_ANSWERS},
    valid AS (SELECT certificate_id, coalesce(j, '{{}}') AS s FROM parsed),
    checked AS (SELECT certificate_id, list_filter([
        CASE WHEN {_bad_text('employee_name', True)} THEN 'employee_name: not a text' END,
        CASE WHEN {_bad_text('document_language', False)} THEN 'document_language: not a text' END,
        CASE WHEN json_type(s, '$.positions') <> 'ARRAY' THEN 'positions: not a list' END,
        CASE WHEN len(list_filter(CAST(json_extract(s, '$.positions') AS JSON[]), lambda p: json_type(p) <> 'OBJECT')) > 0
          THEN 'positions: item of wrong type' END], lambda x: x IS NOT NULL) AS problems FROM valid)
    SELECT certificate_id, len(problems) = 0 AS validation_passed, CASE WHEN len(problems) > 0 THEN 'data_type' END AS issue_type,
      CASE WHEN len(problems) > 0 THEN 'Extraction validation failed: ' || array_to_string(problems, '; ')
        ELSE 'Extraction validation passed' END AS summary
    FROM checked""", heavy=True)
def _(t):
    """An answer that had to be read by pattern has only text fields, so it passes."""
    checked = N.parse_answers(t.answers, "answer", used="usable").select(
        "certificate_id", F.try_parse_json("usable").alias("v")).select(
        # a column of its own, or every field of the result would look for the problems again
        "certificate_id", R.extraction_problems(F.col("v")).alias("problems")).select(
        "certificate_id", R.structural_result(F.col("problems"), "extraction").alias("r"))
    return checked.select("certificate_id", "r.validation_passed", "r.issue_type", "r.summary")


def _when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN '{text}' END"




@query("extraction_warnings", f"""
    WITH {_ANSWERS},
    dated AS (SELECT certificate_id, json_extract_string(j, '$.certificate_issue_date') AS issued, parse_path FROM parsed)
    SELECT certificate_id, CASE WHEN parse_path = 'fallback' THEN '' ELSE array_to_string(list_filter([
      {_when(f"issued > '{_AS_OF}'", 'certificate_issue_date: in the future')},
      'positions[0].end_date: invalid date', 'positions[1].end_date: in the future'], lambda x: x IS NOT NULL), '; ') END AS warnings
    FROM dated""", heavy=True)
def _(t):
    parsed = N.parse_answers(t.answers, "answer")
    cleaned = parsed.select("certificate_id", N.clean_extraction(F.col("fields")).alias("x"))
    return cleaned.select("certificate_id", F.array_join(R.extraction_warnings(
        F.col("x.certificate_issue_date"), F.col("x.positions"), F.lit(_AS_OF).cast("date")), "; ").alias("warnings"))


@query("check_evaluation", """
    WITH e AS (SELECT certificate_id, CASE WHEN total_working_hours % 50 = 0 THEN -total_working_hours ELSE total_working_hours * 90 END AS h,
        CASE WHEN work_type = 'SELF_PACED' THEN 'special' ELSE lower(training_type) END AS kind,
        CASE WHEN total_working_hours % 6 = 0 THEN NULL ELSE credits_awarded + 5.0 END AS credits, degree_relevance,
        CASE WHEN reviewer_decision IS NULL THEN ai_decision ELSE reviewer_decision END AS decision, reviewer_comment AS explanation
      FROM decisions JOIN certificates USING (certificate_id)),
    p AS (SELECT certificate_id, kind, degree_relevance, list_filter([
        CASE WHEN h < 0 THEN 'total_working_hours: negative' END,
        CASE WHEN h > 100000 THEN 'total_working_hours: unreasonably high' END,
        CASE WHEN kind NOT IN ('general', 'professional') THEN 'requested_training_type: not allowed' END,
        CASE WHEN credits IS NULL THEN 'credits_qualified: missing' END,
        CASE WHEN credits > 30 THEN 'credits_qualified: above maximum' END,
        CASE WHEN kind = 'general' AND credits > 10 AND credits <= 30 THEN 'credits_qualified: above maximum for general training' END,
        CASE WHEN decision NOT IN ('ACCEPTED', 'REJECTED') THEN 'decision: not allowed' END,
        CASE WHEN explanation IS NULL THEN 'relevance_explanation: missing' END], lambda x: x IS NOT NULL) AS problems FROM e)
    SELECT certificate_id, len(problems) = 0 AS validation_passed, array_to_string(problems, '; ') AS problems,
      CASE WHEN degree_relevance IN ('high', 'medium') AND kind = 'general' THEN 'relevance suggests professional training'
        WHEN degree_relevance = 'low' AND kind = 'professional' THEN 'relevance suggests general training' ELSE '' END AS warnings
    FROM p""")
def _(t):
    rows = t.decisions.join(t.certificates, "certificate_id")
    hours = F.col("total_working_hours")
    some = F.lit("given")
    fields = {
        "total_working_hours": F.when(hours % 50 == 0, -hours).otherwise(hours * 90),
        "requested_training_type": F.when(F.col("work_type") == "SELF_PACED", F.lit("special")).otherwise(F.lower("training_type")),
        "credits_qualified": F.when(hours % 6 == 0, F.lit(None)).otherwise(F.col("credits_awarded") + F.lit(5.0)),
        "degree_relevance": F.col("degree_relevance"),
        "decision": F.coalesce("reviewer_decision", "ai_decision"),
        "relevance_explanation": F.col("reviewer_comment"),
        "calculation_breakdown": some, "summary_justification": some, "justification": some,
    }
    problems = R.evaluation_problems(fields)
    return rows.select(
        "certificate_id", (F.size(problems) == 0).alias("validation_passed"), F.array_join(problems, "; ").alias("problems"),
        F.array_join(R.evaluation_warnings(fields["requested_training_type"], fields["degree_relevance"]), "; ").alias("warnings"))


_CREDITS = f"CAST({_at('evaluation_results.results.credits_qualified')} AS DOUBLE)"
_STATED = _at("evaluation_results.results.decision")


@query("needs_correction", f"""
    SELECT certificate_id, {_at('validation_results.results.requires_correction')} = 'true'
      AND NOT ({_CREDITS} <= 30 AND {_STATED} IN ('ACCEPTED', 'REJECTED')) AS needs_correction FROM workflows""")
def _(t):
    w = t.workflows.select("certificate_id", nested.parse_workflow(F.col(_J)).alias("w"))
    e = F.col("w.evaluation_results.results")
    return w.select("certificate_id", R.needs_correction(
        F.col("w.validation_results.results.requires_correction"), e["credits_qualified"], e["decision"]).alias("needs_correction"))


_CORRECTED = f"CAST({_at('correction_results.results.evaluation_results.credits_qualified')} AS DOUBLE)"


@query("final_evaluation", f"""
    SELECT certificate_id, coalesce({_CORRECTED} <= 30, false) AS corrected,
      CASE WHEN {_CORRECTED} <= 30 THEN {_CORRECTED} ELSE {_CREDITS} END AS credits,
      CASE WHEN {_CORRECTED} <= 30 THEN 'ACCEPTED' ELSE {_STATED} END AS decision FROM workflows""")
def _(t):
    w = t.workflows.select("certificate_id", nested.parse_workflow(F.col(_J)).alias("w"))
    corrected = F.col("w.correction_results.results.evaluation_results")
    use = R.use_correction(F.col("w.correction_results.success"), corrected["credits_qualified"])
    final = F.when(use, corrected).otherwise(F.col("w.evaluation_results.results"))
    return w.select("certificate_id", use.alias("corrected"), final["credits_qualified"].alias("credits"),
                    final["decision"].alias("decision"))


@query("stage_flags", f"""
    SELECT certificate_id, true AS name_validation, true AS extraction, true AS evaluation,
      {_at('validation_results.success')} = 'true' AS validation,
      coalesce({_at('correction_results.success')} = 'true', false) AS correction FROM workflows""")
def _(t):
    w = t.workflows.select("certificate_id", nested.parse_workflow(F.col(_J)).alias("w"))
    stages = [F.col(f"w.{stage}_results.success") for stage in ("extraction", "evaluation", "validation", "correction")]
    return w.select("certificate_id", R.stage_flags(*stages).alias("f")).select("certificate_id", "f.*")
