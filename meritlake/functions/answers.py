"""Model answers: cutting out the JSON, repairing it, and cleaning its fields.

A parsed answer is a ``map<string,string>``: text values as they are, everything else as
its JSON text. A key with an explicit null is present with a null value, which the rules
below tell apart from a missing key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.binding import let
from meritlake.functions.text import strip
from meritlake.schemas import POSITION

_STRICT = {"allowSingleQuotes": "false"}
_WORD = r"[\p{L}\p{N}_]"


def slice_json(answer: Column) -> Column:
    """From the first ``{`` to the last ``}``; null when there is no such stretch."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))


def parse_object(text: Column) -> Column:
    """One JSON object as a map, or null.

    Wrapping the text in brackets makes the parser read to the end, so leftovers behind the
    object count as an error.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _STRICT)
    return let(wrapped, lambda objects: F.when(F.size(objects) == 1, objects[0]))


def repair_json(text: Column) -> Column:
    """Quote bare keys, turn single quotes to double ones, drop trailing commas.

    A word before a colon inside a text is quoted as well; that is how it has always worked.
    """
    # possessive, and only from the start of a word: what fails once cannot match further on in the same word
    fixed = F.regexp_replace(text, rf"(\s*+)(?<!{_WORD})({_WORD}++)(\s*+):", '$1"$2"$3:')
    fixed = F.replace(fixed, F.lit("'"), F.lit('"'))
    return F.regexp_replace(fixed, r",(\s*[}\]])", "$1")


def fallback_fields(partial: Column) -> Column:
    """What can be read by pattern from an answer that is no JSON."""

    def field(name: str) -> Column:
        found = F.regexp_extract(partial, rf'"{name}"\s*:\s*"([^"]+)"', 1)
        return F.coalesce(F.nullif(found, F.lit("")), F.lit("Unknown"))

    return F.create_map(
        F.lit("employee_name"), field("employee_name"),
        F.lit("position"), field("position"),
        F.lit("employer"), field("employer"),
        F.lit("start_date"), F.lit(None).cast("string"),
        F.lit("end_date"), F.lit(None).cast("string"),
        F.lit("employment_period"), F.lit("Unknown"),
        F.lit("document_language"), F.lit("en"),
        F.lit("confidence_level"), F.lit("low"),
        F.lit("extraction_notes"), F.lit(K.FALLBACK_NOTE),
    )


def parse_answers(df: DataFrame, answer: str, repaired: str | None = None, used: str | None = None) -> DataFrame:
    """Add ``fields`` (the map) and ``parse_path``: direct, repaired or fallback.

    Each step is its own projection and asks for the next only where it failed, so a clean
    answer is parsed once. ``repaired`` names a column for the repaired text, then made for every row;
    ``used`` one for the text that was parsed (null: neither could be).
    """
    text = repair_json(F.col("_slice"))
    return (
        df.select("*", slice_json(F.col(answer)).alias("_slice"))
        .select("*", parse_object(F.col("_slice")).alias("_direct"))
        .select("*", (text if repaired else F.when(F.col("_direct").isNull(), text)).alias("_text"))
        .select("*", F.when(F.col("_direct").isNull(), parse_object(F.col("_text"))).alias("_repaired"))
        .select(
            *df.columns, *([F.col("_text").alias(repaired)] if repaired else []),
            *([F.when(F.col("_direct").isNotNull(), F.col("_slice")).when(F.col("_repaired").isNotNull(), F.col("_text"))
               .alias(used)] if used else []),
            F.coalesce(
                F.col("_direct"), F.col("_repaired"),
                fallback_fields(F.coalesce(F.col("_slice"), F.lit(""))),
            ).alias("fields"),
            F.when(F.col("_direct").isNotNull(), F.lit("direct"))
            .when(F.col("_repaired").isNotNull(), F.lit("repaired"))
            .otherwise(F.lit("fallback")).alias("parse_path"),
        )
    )


def has(fields: Column, key: str) -> Column:
    return F.map_contains_key(fields, key)


def first_present(fields: Column, keys: list[str]) -> Column:
    """Value of the first key that is there, even when that value is null."""
    chain = F.when(has(fields, keys[0]), fields[keys[0]])
    for key in keys[1:]:
        chain = chain.when(has(fields, key), fields[key])
    return chain


# --- extraction answers -----------------------------------------------------------------

def clean_positions(positions: Column) -> Column:
    """Drop what is no object; unnamed titles and employers get their default."""
    return F.transform(
        F.filter(positions, lambda p: p.isNotNull()),
        lambda p: p.withField("title", F.coalesce(p["title"], F.lit("Unknown Position")))
        .withField("employer", F.coalesce(p["employer"], F.lit("Unknown Employer"))),
    )


def clean_extraction(fields: Column) -> Column:
    """Typed extraction from the map, with defaults where a value is null."""
    texts = F.from_json(fields["positions"], "array<string>", _STRICT)
    objects = F.transform(
        F.filter(texts, lambda t: strip(t).startswith("{")), lambda t: F.from_json(t, POSITION, _STRICT))
    return F.struct(
        F.coalesce(fields["employee_name"], F.lit("Unknown Employee")).alias("employee_name"),
        fields["employer"].alias("employer"),
        fields["certificate_issue_date"].alias("certificate_issue_date"),
        clean_positions(objects).alias("positions"),
        fields["total_employment_period"].alias("total_employment_period"),
        fields["document_language"].alias("document_language"),
        fields["confidence_level"].alias("confidence_level"),
    )


# --- evaluation answers -----------------------------------------------------------------

def alias_field(fields: Column, target: str) -> Column:
    """A field by its own name, else by the first of its other names that is there."""
    names = [source for source, field in K.EVALUATION_ALIASES if field == target and source != target]
    return first_present(fields, [target, *names])


def alias_targets() -> list[str]:
    return list(dict.fromkeys(target for _, target in K.EVALUATION_ALIASES))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """One pass over the text for all phrases."""
    return text.rlike("|".join(rf"\Q{phrase}\E" for phrase in phrases))


def relevance_category(description: Column) -> Column:
    """Free text -> low, high or medium by the first rule with a phrase in it; default low."""
    def by_rules(lowered: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for level, phrases in K.RELEVANCE_RULES:
            chain = chain.when(contains_any(lowered, phrases), F.lit(level))
        return chain.otherwise(F.lit("low"))

    return let(F.lower(description), by_rules)


def degree_relevance(fields: Column) -> Column:
    """Categorised only when the answer has no ``degree_relevance`` of its own."""
    described = F.nullif(fields["Degree Relevance"], F.lit(""))
    return F.coalesce(
        F.when(has(fields, "degree_relevance"), fields["degree_relevance"])
        .when(described.isNotNull(), relevance_category(described)),
        F.lit("low"),
    )


def evidence(fields: Column, side: str, field: str) -> Column:
    """``for``/``against`` text of the evidence object, else the field of its own."""
    source = first_present(fields, ["Evidence Analysis", "evidence_analysis"])
    split = F.when(source.startswith("{"), F.get_json_object(source, f"$.{side}_professional_training"))
    return F.coalesce(split, fields[field])


def infer_decision(fields: Column, echoed_type: Column) -> Column:
    """The stated decision, or one read from the recommendation; REJECTED without either."""
    stated = first_present(fields, ["decision", "Decision"])
    stated_key = has(fields, "decision") | has(fields, "Decision")
    advice_text = F.lower(F.nullif(first_present(fields, ["Recommendation", "recommendation"]), F.lit("")))
    wants_professional = F.lower(echoed_type) == "professional"
    accepted, rejected = F.lit("ACCEPTED"), F.lit("REJECTED")

    def read(advice: Column) -> Column:
        return (
            F.when(advice.isNull(), rejected)
            .when(advice.contains("general training"),
                  F.when(wants_professional, rejected).otherwise(accepted))
            .when(advice.contains("professional training"), accepted)
            .when(contains_any(advice, ("reject", "deny")), rejected)
            .when(contains_any(advice, ("accept", "approve")), accepted)
            .when(wants_professional & advice.contains("general"), rejected)
            .otherwise(accepted)
        )

    return F.when(stated_key, F.coalesce(stated, rejected)).otherwise(let(advice_text, read))


def normalise_justification(fields: Column) -> Column:
    """A readable justification: missing ones come from the recommendation, objects are unwrapped."""
    given = alias_field(fields, "justification")
    advice = first_present(fields, ["recommendation", "Recommendation"])
    has_advice = has(fields, "recommendation") | has(fields, "Recommendation")
    inner = F.when(given.startswith("{"), F.get_json_object(given, "$.justification"))
    return (
        F.when(
            given.isNull() | (given == K.NO_JUSTIFICATION),
            F.when(has_advice, advice).otherwise(F.lit(K.NO_JUSTIFICATION)),
        )
        .otherwise(F.coalesce(inner, given))
    )


def clean_evaluation(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Add the cleaned evaluation fields as columns (texts still texts, numbers as text)."""
    m = F.col(fields)
    columns = {target: alias_field(m, target) for target in alias_targets()}
    columns["justification"] = normalise_justification(m)
    columns["degree_relevance"] = degree_relevance(m)
    columns["supporting_evidence"] = evidence(m, "for", "supporting_evidence")
    columns["challenging_evidence"] = evidence(m, "against", "challenging_evidence")
    columns["decision"] = infer_decision(m, F.coalesce(m["requested_training_type"], F.lit("")))
    columns["recommendation"] = m["recommendation"]
    columns["credits_qualified"] = m["credits_qualified"]
    for name, default in K.EVALUATION_TEXT_DEFAULTS.items():
        columns[name] = F.coalesce(columns.get(name, m[name]), F.lit(default))
    columns["total_working_hours"] = F.coalesce(columns["total_working_hours"], F.lit("0"))
    columns["credits_calculated"] = F.coalesce(columns["credits_calculated"], F.lit("0.0"))
    columns["credits_qualified"] = F.coalesce(columns["credits_qualified"], F.lit("0.0"))
    return df.withColumns(columns)
