"""Company answers: JSON, sliced JSON, or a paragraph read by its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.binding import let
from meritlake.functions.answers import contains_any, parse_object
from meritlake.functions.text import strip
from meritlake.schemas import COMPANY_ANSWER


def _answer(status, confidence, risk, justification, evidence, review) -> Column:
    def literal(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        literal(status).alias("status"),
        literal(confidence).alias("confidence"),
        literal(risk).alias("risk_level"),
        literal(justification).alias("justification"),
        evidence.alias("supporting_evidence"),
        literal(review).alias("requires_review"),
    )


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(value) for value in values])


def paragraph_evidence(text: Column, low: Column) -> Column:
    """Evidence lines a paragraph gives rise to, or the default list (wordings are fixed values).

    ``low`` is the text in lower case, here and below.
    """
    website = F.when(
        low.contains("website"),
        F.when(text.contains("teboil.fi"), F.lit("Website: teboil.fi (official company website)"))
        .otherwise(F.lit("Website: Company website found and verified")),
    )
    registry = F.when(
        low.contains("database") | low.contains("registry"),
        F.when(low.contains("ytunnus"), F.lit("Business Registry: Finnish Y-tunnus database verified"))
        .when(low.contains("business registry"),
              F.lit("Business Registry: Business registry information found")),
    )
    address = F.when(
        low.contains("address") & contains_any(low, ("match", "verified")),
        F.when(low.contains("sauvontie"),
               F.lit("Address Verification: Sauvontie 9, 21510 Hevonpää confirmed"))
        .otherwise(F.lit("Address Verification: Address verified online")),
    )
    industry = F.when(
        contains_any(low, ("fuel", "retail")), F.lit("Industry: Fuel retail operations confirmed")
    ).when(low.contains("industry"), F.lit("Industry: Industry information verified"))
    media = F.when(
        contains_any(low, ("news", "article")), F.lit("Media: News articles and media coverage found"))
    found = F.array_compact(F.array(website, registry, address, industry, media))
    return let(found, lambda lines: F.when(F.size(lines) > 0, lines).otherwise(
        _texts(*K.DEFAULT_COMPANY_EVIDENCE)))


def paragraph_answer(text: Column, low: Column) -> Column:
    """Legitimate unless a suspicious word occurs anywhere, even inside another word."""
    return let(contains_any(low, K.SUSPICIOUS_WORDS), lambda bad: _answer(
        F.when(bad, F.lit("NOT_LEGITIMATE")).otherwise(F.lit("LEGITIMATE")),
        F.when(bad, F.lit("low")).otherwise(F.lit("high")),
        F.when(bad, F.lit("high")).otherwise(F.lit("very_low")),
        strip(text), paragraph_evidence(text, low), bad,
    ))


def last_resort_answer(text: Column, low: Column) -> Column:
    """For answers whose JSON is broken: positive words win over suspicious ones."""
    words = F.struct(contains_any(low, K.POSITIVE_WORDS).alias("good"),
                     contains_any(low, K.SUSPICIOUS_WORDS).alias("bad"))
    return let(words, lambda w: _last_resort(text, w["good"], w["bad"]))


def _last_resort(text: Column, good: Column, bad: Column) -> Column:
    legitimate = good | ~bad
    return _answer(
        F.when(legitimate, F.lit("LEGITIMATE")).otherwise(F.lit("NOT_LEGITIMATE")),
        F.when(good | ~bad, F.lit("medium")).otherwise(F.lit("low")),
        F.when(good, F.lit("low")).when(bad, F.lit("high")).otherwise(F.lit("medium")),
        F.concat(
            F.lit("LLM response parsing failed. Fallback analysis suggests: "),
            F.when(legitimate, F.lit("legitimate")).otherwise(F.lit("suspicious")),
            F.lit(" company. Raw response: "), F.substring(text, 1, 100), F.lit("..."),
        ),
        _texts("Fallback analysis due to parsing error"), True,
    )


def unverified_answer() -> Column:
    """Recorded when there is no usable answer; it does not count as a bad company."""
    return _answer("UNVERIFIED", "low", "medium", "LLM validation failed, defaulting to unverified",
                   _texts("LLM validation failed"), True)


def _from_fields(fields: Column) -> Column:
    return _answer(
        F.when(F.map_contains_key(fields, "status"), fields["status"]).otherwise(F.lit("UNVERIFIED")),
        F.when(F.map_contains_key(fields, "confidence"), fields["confidence"]).otherwise(F.lit("low")),
        F.when(F.map_contains_key(fields, "risk_level"), fields["risk_level"]).otherwise(F.lit("unknown")),
        F.when(F.map_contains_key(fields, "justification"), fields["justification"])
        .otherwise(F.lit("No detailed explanation provided")),
        F.coalesce(F.from_json(fields["supporting_evidence"], "array<string>"),
                   F.array().cast("array<string>")),
        F.coalesce(fields["requires_review"].try_cast("boolean"), F.lit(False)),
    )


def parse_company_answers(df: DataFrame, answer: str) -> DataFrame:
    """Add ``company`` (struct), ``answer_path`` and ``counts_as_bad``.

    Paths: json, sliced, paragraph, last_resort, none. ``counts_as_bad`` holds for a parsed
    answer of status NOT_LEGITIMATE or UNVERIFIED, not for a missing one.
    """
    raw = F.col(answer)
    empty = raw.isNull() | (raw == "")
    cut = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    path = (
        F.when(empty, F.lit("none"))
        .when(F.col("_json").isNotNull(), F.lit("json"))
        .when(F.col("_is_value"), F.lit("none"))
        .when(F.col("_cut").isNull(), F.lit("paragraph"))
        .when(F.col("_sliced").isNotNull(), F.lit("sliced"))
        .otherwise(F.lit("last_resort"))
    )
    parsed = (
        df.select("*", parse_object(raw).alias("_json"), cut.alias("_cut"))
        .select(
            "*",
            # valid JSON that is no object is no answer
            F.when(F.col("_json").isNull() & ~strip(raw).startswith("{"),
                   F.size(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>",
                                      {"allowSingleQuotes": "false"})) == 1).alias("_is_value"),
            F.when(F.col("_json").isNull(), parse_object(F.col("_cut"))).alias("_sliced"),
        )
        .select("*", path.alias("answer_path"), F.lower(raw).alias("_low"))
    )
    low = F.col("_low")
    way = F.col("answer_path")
    company = (
        F.when(way.isin("json", "sliced"), _from_fields(F.coalesce(F.col("_json"), F.col("_sliced"))))
        .when(way == "paragraph", paragraph_answer(raw, low))
        .when(way == "last_resort", last_resort_answer(raw, low))
        .otherwise(unverified_answer())
        .cast(COMPANY_ANSWER)
    )
    return parsed.select(*df.columns, company.alias("company"), "answer_path").select(
        "*",
        ((F.col("answer_path") != "none")
         & F.coalesce(F.col("company.status").isin("NOT_LEGITIMATE", "UNVERIFIED"), F.lit(False))
         ).alias("counts_as_bad"),
    )


def rollup_status(bad: Column, checked: Column, positions: Column) -> Column:
    """Overall status from counts: bad companies, companies checked, positions."""
    return (
        F.when(F.coalesce(positions, F.lit(0)) == 0, F.lit("UNVERIFIED"))
        .when(F.coalesce(bad, F.lit(0)) == 0, F.lit("LEGITIMATE"))
        .when(bad == checked, F.lit("NOT_LEGITIMATE"))
        .otherwise(F.lit("PARTIALLY_LEGITIMATE"))
    )


def company_issue(name: Column, status: Column) -> Column:
    """Issue row of a bad company: high when not legitimate, medium when unverified."""
    def issue(severity: str, description: Column, suggestion: Column) -> Column:
        return F.struct(
            F.lit("company_validation_error").alias("type"),
            F.lit(severity).alias("severity"),
            description.alias("description"),
            F.lit("company_validation").alias("field_affected"),
            suggestion.alias("suggestion"),
            F.lit(None).cast("int").alias("position_index"),
        )

    return F.when(
        status == "NOT_LEGITIMATE",
        issue("high", F.concat(F.lit("Suspicious company detected: "), name),
              F.concat(F.lit("Review company '"), name, F.lit("' for legitimacy"))),
    ).when(
        status == "UNVERIFIED",
        issue("medium", F.concat(F.lit("Company could not be verified: "), name),
              F.concat(F.lit("Manual verification required for company '"), name, F.lit("'"))),
    )
