"""Checks on answers and rows: each rule yields a message or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.binding import let
from meritlake.functions.dates import parse_finnish_date


def messages(*rules: Column) -> Column:
    """The messages there are; none is empty. Removing '' stays in generated code, a filter's lambda would not."""
    return F.array_remove(F.array(*[F.coalesce(rule, F.lit("")) for rule in rules]), F.lit(""))


def broken(condition: Column, message: str) -> Column:
    """The message where the condition holds; an unknown condition is no finding."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(message))


# --- extraction answers -------------------------------------------------------------------
_EXTRACTION_TEXTS = ("employee_name", "employer", "certificate_issue_date",
                     "total_employment_period", "confidence_level")
_POSITION_TEXTS = ("title", "employer", "start_date", "end_date", "duration", "responsibilities")
_ALL_TEXTS = r"^OBJECT<\w+: (?:STRING|VOID)(?:, \w+: (?:STRING|VOID))*+>$"


def _kind(value: Column, path: str) -> Column:
    """JSON kind at a path: 'STRING', 'VOID' for null, null when missing, ..."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def extraction_problems(answer: Column) -> Column:
    """Type errors of a parsed extraction (variant).

    Text fields may be null or missing; the language may be missing but not null; positions
    may be missing but must be a list of objects.
    """
    def not_text(value: Column, path: str, nullable: bool) -> Column:
        allowed = ("STRING", "VOID") if nullable else ("STRING",)
        return ~_kind(value, path).isin(*allowed)

    def bad_position(p: Column) -> Column:
        wrong = F.lit(False)
        for name in _POSITION_TEXTS:
            wrong = wrong | F.coalesce(not_text(p, f"$.{name}", True), F.lit(False))
        # an object of nothing but texts needs no look at its fields
        return let(F.schema_of_variant(p), lambda kind: F.when(kind.rlike(_ALL_TEXTS), F.lit(False)).otherwise(
            ~kind.startswith("OBJECT") | wrong))

    listed = F.try_variant_get(answer, "$.positions", "array<variant>")
    return messages(
        *[broken(not_text(answer, f"$.{name}", True), f"{name}: not a text") for name in _EXTRACTION_TEXTS],
        broken(not_text(answer, "$.document_language", False), "document_language: not a text"),
        broken(~_kind(answer, "$.positions").startswith("ARRAY"), "positions: not a list"),
        broken(F.exists(listed, bad_position), "positions: item of wrong type"),
    )


def extraction_warnings(issue_date: Column, positions: Column, as_of: Column) -> Column:
    """Findings that never fail an extraction: unreadable, future or reversed dates."""
    own = let(F.try_to_date(issue_date, "yyyy-MM-dd"), lambda issued: messages(
        broken(issue_date.isNotNull() & issued.isNull(), "certificate_issue_date: invalid date"),
        broken(issued > as_of, "certificate_issue_date: in the future"),
    ))

    def of_position(p: Column, index: Column) -> Column:
        # each date is read once, not in every rule that names it
        read = F.struct(parse_finnish_date(p["start_date"]).alias("start"), parse_finnish_date(p["end_date"]).alias("end"))
        return let(read, lambda d: findings(p, d["start"], d["end"], index))

    def findings(p: Column, start: Column, end: Column, index: Column) -> Column:
        at = F.concat(F.lit("positions["), index.cast("string"), F.lit("]."))

        def tell(condition: Column, text: str) -> Column:
            return F.when(F.coalesce(condition, F.lit(False)), F.concat(at, F.lit(text)))

        return messages(
            tell(p["start_date"].isNotNull() & start.isNull(), "start_date: invalid date"),
            tell(start > as_of, "start_date: in the future"),
            tell(p["end_date"].isNotNull() & end.isNull(), "end_date: invalid date"),
            tell(end > as_of, "end_date: in the future"),
            tell(end < start, "end_date: before start_date"),
        )

    listed = F.coalesce(F.flatten(F.transform(positions, of_position)),
                        F.array().cast("array<string>"))
    return F.concat(own, listed)


# --- evaluation answers ---------------------------------------------------------------------
REQUIRED_TEXTS = ("relevance_explanation", "calculation_breakdown", "summary_justification",
                  "justification")


def evaluation_problems(e: dict[str, Column]) -> Column:
    """Broken business rules of an evaluation."""
    credits, kind = e["credits_qualified"], e["requested_training_type"]

    def outside(column: Column, allowed: tuple[str, ...]) -> Column:
        return column.isNull() | ~column.isin(*allowed)

    return messages(
        broken(e["total_working_hours"] < 0, "total_working_hours: negative"),
        broken(e["total_working_hours"] > K.MAX_WORKING_HOURS, "total_working_hours: unreasonably high"),
        broken(outside(kind, ("general", "professional")), "requested_training_type: not allowed"),
        broken(credits.isNull(), "credits_qualified: missing"),
        broken(credits < 0, "credits_qualified: negative"),
        broken(credits > K.MAX_CREDITS, "credits_qualified: above maximum"),
        broken((kind == "general") & (credits > K.CREDIT_CAPS["general"]) & (credits <= K.MAX_CREDITS),
               "credits_qualified: above maximum for general training"),
        broken(outside(e["degree_relevance"], K.RELEVANCE_LEVELS), "degree_relevance: not allowed"),
        broken(outside(e["decision"], K.DECISION_STATUSES), "decision: not allowed"),
        *[broken(e[name].isNull(), f"{name}: missing") for name in REQUIRED_TEXTS],
    )


def evaluation_warnings(kind: Column, relevance: Column) -> Column:
    """Type against relevance; reported, never failing."""
    return messages(
        broken(relevance.isin("high", "medium") & (kind == "general"),
               "relevance suggests professional training"),
        broken((relevance == "low") & (kind == "professional"),
               "relevance suggests general training"),
    )


def structural_result(problems: Column, side: str) -> Column:
    """Result block of a check: passed, one high issue on failure, summary."""
    passed = F.size(problems) == 0
    label = "Extraction" if side == "extraction" else "Evaluation"
    kind = "data_type" if side == "extraction" else "business_rule"
    advice = ("Review data structure and format" if side == "extraction"
              else "Review evaluation logic and business rules")
    text = F.array_join(problems, "; ")
    return F.struct(
        passed.alias("validation_passed"),
        F.when(~passed, F.lit(kind)).alias("issue_type"),
        F.when(~passed, F.lit("high")).alias("issue_severity"),
        F.when(~passed, F.concat(F.lit("Validation error: "), text)).alias("issue_description"),
        F.when(~passed, F.lit(f"{side}_results")).alias("field_affected"),
        F.when(~passed, F.lit(advice)).alias("suggestion"),
        F.when(passed, F.lit(f"{label} validation passed"))
        .otherwise(F.concat(F.lit(f"{label} validation failed: "), text)).alias("summary"),
    )


# --- stages -----------------------------------------------------------------------------------

def needs_correction(requires_correction: Column, credits: Column, decision: Column) -> Column:
    """Asked for by validation, and the evaluation is not already within cap and decided."""
    settled = (F.coalesce(credits, F.lit(0.0)) <= K.MAX_CREDITS) & F.coalesce(
        decision.isin(*K.DECISION_STATUSES), F.lit(False))
    return F.coalesce(requires_correction, F.lit(False)) & ~settled


def use_correction(correction_success: Column, corrected_credits: Column) -> Column:
    """Take the corrected evaluation when it succeeded and respects the cap."""
    return F.coalesce(correction_success, F.lit(False)) & (
        F.coalesce(corrected_credits, F.lit(0.0)) <= K.MAX_CREDITS)


def stage_flags(extraction: Column, evaluation: Column, validation: Column,
                correction: Column) -> Column:
    no = F.lit(False)
    return F.struct(
        F.lit(True).alias("name_validation"),
        F.coalesce(extraction, no).alias("extraction"),
        F.coalesce(evaluation, no).alias("evaluation"),
        F.coalesce(validation, no).alias("validation"),
        F.coalesce(correction, no).alias("correction"),
    )
