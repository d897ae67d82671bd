"""The evaluation with a caller-supplied model, stage by stage.

Model calls are the dear part, so every stage's answers are written once to the shared
working folder: neither a lost executor nor a later branch of the plan asks again. Rows that
are decided early (unusable text, failed call, name mismatch) never reach the next stage,
and a company is asked about once however many certificates name it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.functions import answers as N
from meritlake.functions.companies import company_issue, parse_company_answers, rollup_status
from meritlake.functions.credits import (
    cap_breakdown, cap_credits, credits_from_hours, effective_type, hours_problem)
from meritlake.functions.dates import fix_extraction_dates
from meritlake.functions.names import with_name_match
from meritlake.functions.rules import needs_correction, use_correction
from meritlake.functions.text import (
    PROMPT_TEMPLATES, degree_guidelines, input_problem, render_template, sanitize_text)
from meritlake.operators.degrees import match_degree
from meritlake.operators.identity import NO_IDENTITY
from meritlake.schemas import ISSUE
from meritlake.session import work_folder
from meritlake.sources.calls import Call, map_with_caller

Callers = dict[str, list[tuple[str, Callable[[], Call]]]]
_CONTACT = {"address": "employer_address", "business_id": "employer_business_id",
            "phone": "employer_phone", "email": "employer_email"}
RESULT = ("certificate_id", "success", "error", "ai_decision", "ai_justification", "total_working_hours",
          "credits_calculated", "credits_qualified", "calculation_breakdown", "training_duration",
          "training_institution", "degree_relevance", "supporting_evidence", "challenging_evidence",
          "recommendation", "company_validation_status", "name_validation_match_result",
          "name_validation_explanation", "issues_found", "corrected")


def _ask(df: DataFrame, stage: str, prompt: Column, callers: Callers, partitions: int | None) -> DataFrame:
    """Answers of one stage next to the columns of ``df``, stored."""
    keep = df.columns
    path = work_folder(df.sparkSession, f"{stage}-answers")
    map_with_caller(df.withColumn("_prompt", prompt), "_prompt", keep, callers[stage], partitions).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return stored.select(*keep, "answer", "success", "error")


def _json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _failed(df: DataFrame, error: Column) -> DataFrame:
    return df.select("certificate_id", F.lit(False).alias("success"), error.alias("error"))


def _companies(named: DataFrame, templates: dict[str, str], callers: Callers, partitions: int | None) -> DataFrame:
    """Per certificate: overall company status and the issues of bad companies.

    The companies of one certificate are those of its own answer, so the arrays are short.
    """
    contact = [F.coalesce(F.nullif(F.col("fields")[field], F.lit("")), F.lit("Not provided")).alias(name)
               for name, field in _CONTACT.items()]
    listed = named.select("certificate_id", *contact, F.posexplode("extraction.positions").alias("_at", "_p")).select(
        "certificate_id", "_at", F.col("_p.employer").alias("employer"), *_CONTACT)
    key = ["employer", *_CONTACT]
    employers = listed.where(F.coalesce("employer", F.lit("")) != "")
    prompt = render_template(templates["company"], {"company_name": F.col("employer"), **{n: F.col(n) for n in _CONTACT}})
    asked = _ask(employers.select(*key).distinct(), "company", prompt, callers, partitions)
    verdicts = parse_company_answers(asked.select(*key, "answer"), "answer").select(*key, "company", "counts_as_bad")
    bad = F.coalesce("counts_as_bad", F.lit(False))
    return (
        listed.join(verdicts, key, "left").groupBy("certificate_id")
        .agg(F.count(F.lit(1)).alias("_positions"), F.count("company").alias("_checked"), F.count_if(bad).alias("_bad"),
             F.sort_array(F.collect_list(F.when(bad, F.struct(
                 "_at", company_issue(F.col("employer"), F.col("company.status")).alias("issue"))))).alias("_issues"))
        .select("certificate_id",
                rollup_status(F.col("_bad"), F.col("_checked"), F.col("_positions")).alias("company_status"),
                F.transform("_issues", lambda i: i["issue"]).cast(f"array<{ISSUE}>").alias("company_issues"))
    )


def evaluate_with_model(certificates: DataFrame, students: DataFrame, catalogue: DataFrame, callers: Callers,
                        as_of: str, templates: dict[str, str] = PROMPT_TEMPLATES,
                        partitions: int | None = None, limit: int | None = None) -> DataFrame:
    """One result row per certificate.

    ``certificates``: certificate_id, student_id, training_type, text. ``students``: student_id,
    first_name, last_name, degree. ``catalogue``: programme_key, name, industries, roles.
    ``callers``: for each of extraction, evaluation, company, validation and correction the
    ordered (name, factory) pairs. ``partitions`` evens out the load of the calls. Prompts hold
    the whole text, or its first ``limit`` characters.
    """
    date = F.lit(as_of)
    prepared = certificates.select(
        "certificate_id", "student_id", F.lower("training_type").alias("requested_type"),
        input_problem(F.col("text")).alias("_problem"), sanitize_text(F.col("text"), limit).alias("text"))
    unusable = _failed(prepared.where(F.col("_problem").isNotNull()), F.col("_problem"))

    # 1. extraction, dates
    extracted = _ask(prepared.where(F.col("_problem").isNull()).drop("_problem"), "extraction",
                     render_template(templates["extraction"], {"document_text": F.col("text")}), callers, partitions)
    not_extracted = _failed(extracted.where(~F.col("success")), F.concat(F.lit("Extraction failed: "), "error"))
    read = (
        N.parse_answers(extracted.where("success").drop("success", "error"), "answer").drop("answer", "parse_path")
        .withColumn("extraction", fix_extraction_dates(N.clean_extraction(F.col("fields"))))
        .withColumn("employee_name", F.col("extraction.employee_name"))
    )

    # 2. names: a mismatch ends here
    people = students.select("student_id", "first_name", "last_name", "degree", F.lit(True).alias("_known"))
    compared = with_name_match(read.join(people, "student_id", "left"), "first_name", "last_name", "employee_name")
    unknown = F.col("_known").isNull()
    named = compared.withColumns({
        "match_result": F.when(unknown, F.lit("unknown")).otherwise(F.col("match_result")),
        "match_explanation": F.when(unknown, F.lit(NO_IDENTITY)).otherwise(F.col("match_explanation")),
        "name_match": unknown | F.col("match_result").isin("match", "partial_match")})
    about_name = [F.col("match_result").alias("name_validation_match_result"),
                  F.col("match_explanation").alias("name_validation_explanation")]
    about_work = [F.coalesce("extraction.total_employment_period", F.lit("Not specified")).alias("training_duration"),
                  F.coalesce("extraction.employer", F.lit("Not specified")).alias("training_institution")]
    mismatch_issue = F.struct(
        F.lit("name_mismatch").alias("type"), F.lit("critical").alias("severity"),
        F.concat(F.lit("Student name mismatch: "), "match_explanation").alias("description"),
        F.lit("name_validation").alias("field_affected"),
        F.lit("Verify student identity and certificate authenticity").alias("suggestion"),
        F.lit(None).cast("int").alias("position_index"))
    rejected = named.where(~F.col("name_match")).select(
        "certificate_id", F.lit(True).alias("success"), F.lit("REJECTED").alias("ai_decision"),
        F.concat(F.lit("Certificate rejected due to name mismatch: "), "match_explanation").alias("ai_justification"),
        F.lit(0.0).alias("total_working_hours"), F.lit(0.0).alias("credits_qualified"),
        F.lit("Not calculated due to name mismatch").alias("calculation_breakdown"),
        F.lit("low").alias("degree_relevance"), F.lit("REJECT - Name validation failed").alias("recommendation"),
        *about_work, *about_name, F.lit("UNVERIFIED").alias("company_validation_status"),
        F.array(mismatch_issue).cast(f"array<{ISSUE}>").alias("issues_found"), F.lit(False).alias("corrected"))

    # 3. evaluation, credits
    guides = catalogue.select("programme_key", degree_guidelines(
        F.col("name"), F.col("industries"), F.col("roles")).alias("guidelines"))
    to_evaluate = (
        named.where("name_match").drop("_known", "first_name", "last_name", "employee_name", "match_confidence", "name_match")
        .withColumn("programme_key", match_degree(F.col("degree"))).join(guides, "programme_key", "left"))
    values = {
        "current_date": date, "student_degree": F.col("degree"), "requested_training_type": F.col("requested_type"),
        "degree_specific_guidelines": F.col("guidelines"), "additional_documents_section": F.lit(""),
        "additional_documents_text": F.lit(""), "document_text": F.col("text"), "ocr_text": F.col("text"),
        "extracted_info": F.to_json("extraction"), "extraction_results": F.to_json("extraction")}
    evaluated = _ask(to_evaluate, "evaluation", render_template(templates["evaluation"], values), callers, partitions)
    no_evaluation = _failed(evaluated.where(~F.col("success")), F.concat(F.lit("Evaluation failed: "), "error"))
    clean = N.clean_evaluation(N.parse_answers(
        evaluated.where("success").drop("success", "error").withColumnRenamed("fields", "_extraction_fields"), "answer")
        .drop("answer", "parse_path").withColumnRenamed("fields", "_evaluation"), "_evaluation"
    ).withColumn("_hours_problem", hours_problem(F.col("total_working_hours")))
    bad_hours = _failed(clean.where(F.col("_hours_problem").isNotNull()), F.col("_hours_problem"))
    base, kind = F.col("credits_calculated"), F.col("requested_type")
    credited = (
        clean.where(F.col("_hours_problem").isNull()).withColumnRenamed("_extraction_fields", "fields")
        .withColumn("_hours_text", F.col("total_working_hours"))
        .withColumn("total_working_hours", F.col("total_working_hours").try_cast("double"))
        .withColumn("requested_type", effective_type(kind, F.col("_evaluation")["training_type"]))
        .withColumn("credits_calculated", credits_from_hours(F.col("total_working_hours")))
        .withColumn("credits_qualified", cap_credits(base, kind))
        .withColumn("credits_qualified", F.coalesce("credits_qualified", base))
        .withColumn("calculation_breakdown", F.coalesce(
            cap_breakdown(F.col("_hours_text"), base, kind), "calculation_breakdown"))
    )

    # 4. companies, validation
    companies = _companies(credited, templates, callers, partitions)
    evaluation_json = _json("total_working_hours", "credits_calculated", "credits_qualified", "degree_relevance",
                            "decision", "justification", "recommendation")
    to_validate = credited.join(companies, "certificate_id", "left").withColumn("evaluation_json", evaluation_json)
    values["evaluation_results"] = F.col("evaluation_json")
    validated = _ask(
        to_validate.drop("fields", "_evaluation"), "validation",
        F.concat(render_template(templates["validation"], values), F.lit("\n\nCOMPANY VALIDATION RESULTS:\n"),
                 F.coalesce(_json("company_status", "company_issues"), F.lit(""))), callers, partitions)
    checked = N.parse_answers(validated.drop("error").withColumnRenamed("success", "_valid"), "answer").withColumns({
        "_own_issues": F.from_json(F.col("fields")["issues_found"], f"array<{ISSUE}>"),
        "_wanted": F.col("_valid") & F.coalesce(F.col("fields")["requires_correction"].try_cast("boolean"), F.lit(False)),
        "_findings": F.to_json("fields")}).drop("answer", "parse_path", "fields")
    none = F.array().cast(f"array<{ISSUE}>")
    decided = checked.withColumn("_correct", needs_correction(
        F.col("_wanted"), F.col("credits_qualified"), F.col("decision"))).withColumn(
        "issues_found", F.concat(F.coalesce("_own_issues", none), F.coalesce("company_issues", none)))

    # 5. correction, asked for only where it is needed
    values["validation_results"] = F.col("_findings")
    corrected = _ask(decided.where("_correct").drop("_own_issues", "company_issues", "issues_found"), "correction",
                     render_template(templates["correction"], values), callers, partitions)
    answer = F.from_json(F.col("fields")["evaluation_results"], "map<string,string>")
    taken = N.parse_answers(corrected.select("certificate_id", "answer", F.col("success").alias("_ok")), "answer").select(
        "certificate_id", "_ok", answer.alias("_answer")).where(use_correction(
            F.col("_ok"), F.col("_answer")["credits_qualified"].try_cast("double")) & F.col("_answer").isNotNull())

    def given(name: str, kind: str = "string") -> Column:
        """The corrected value where there is a usable one, else the first answer's."""
        return F.coalesce(F.col("_answer")[name].try_cast(kind), F.col(name))

    decided = decided.join(taken.select("certificate_id", "_answer"), "certificate_id", "left").withColumns({
        "corrected": F.col("_answer").isNotNull(),
        **{name: given(name) for name in ("decision", "justification", "degree_relevance", "recommendation",
                                          "calculation_breakdown", "supporting_evidence", "challenging_evidence")},
        **{name: given(name, "double") for name in ("total_working_hours", "credits_calculated", "credits_qualified")}})
    finished = decided.select(
        "certificate_id", F.lit(True).alias("success"),
        F.when(F.col("decision") == "ACCEPTED", F.lit("ACCEPTED")).otherwise(F.lit("REJECTED")).alias("ai_decision"),
        F.col("justification").alias("ai_justification"), "total_working_hours", "credits_calculated",
        "credits_qualified", "calculation_breakdown", *about_work, "degree_relevance", "supporting_evidence",
        "challenging_evidence", "recommendation", F.coalesce("company_status", F.lit("UNVERIFIED")).alias(
            "company_validation_status"), *about_name, "issues_found", "corrected")
    parts = [finished, rejected, unusable, not_extracted, no_evaluation, bad_hours]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*RESULT)
