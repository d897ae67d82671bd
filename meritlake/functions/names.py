"""Names of people: normalising, comparing, displaying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.functions.text import strip


def normalize_name(name: Column) -> Column:
    """Lower case, a/o for ä/å/ö, no punctuation, single spaces. Null becomes ''."""
    plain = F.translate(strip(F.lower(name)), "äöå", "aoa")
    plain = F.regexp_replace(plain, r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.coalesce(F.regexp_replace(plain, r"(?U)\s+", " "), F.lit(""))


def positional_similarity(left: Column, right: Column) -> Column:
    """Share of places holding the same character, over the longer length."""
    same = F.aggregate(
        F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: a == b),
        F.lit(0),
        lambda total, equal: total + F.when(equal, 1).otherwise(0),
    )
    longer = F.greatest(F.length(left), F.length(right))
    return F.when((left == "") | (right == "") | left.isNull() | right.isNull(), F.lit(0.0)).otherwise(
        same / longer
    )


def title_case(text: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def name_from_email(email: Column) -> Column:
    return title_case(F.replace(F.split_part(email, F.lit("@"), F.lit(1)), F.lit("."), F.lit(" ")))


def _joined(first: Column, last: Column) -> Column:
    empty = F.lit("")
    return F.nullif(F.concat_ws(" ", F.nullif(first, empty), F.nullif(last, empty)), empty)


def reviewer_display_name(first: Column, last: Column) -> Column:
    """'first last', or the one that exists, or null."""
    return _joined(first, last)


def full_name(first: Column, last: Column) -> Column:
    return F.coalesce(_joined(strip(first), strip(last)), F.lit("Unknown"))


def student_email_ok(email: Column, domain: str) -> Column:
    escaped = domain.replace(".", r"\.")
    return F.coalesce(email.rlike(rf"^[A-Za-z0-9._%+-]+@{escaped}$"), F.lit(False))


def student_email_accepted(email: Column, domain: str) -> Column:
    """The looser interactive test: the ending only, in any case."""
    return F.coalesce(F.lower(strip(email)).endswith(f"@{domain}"), F.lit(False))


def _percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def with_name_match(df: DataFrame, first: str, last: str, extracted: str) -> DataFrame:
    """Add ``match_result``, ``match_confidence`` and ``match_explanation``.

    The normalised names and the similarity are columns of earlier projections, so no
    branch of the verdict computes them again.
    """
    db_first = F.coalesce(F.col(first), F.lit(""))
    db_last = F.coalesce(F.col(last), F.lit(""))
    shown = F.coalesce(F.col(extracted), F.lit(""))
    nf, nl, nx = F.col("_first"), F.col("_last"), F.col("_extracted")
    straight, turned, sim = F.col("_straight"), F.col("_turned"), F.col("_similarity")

    step1 = df.select(
        "*",
        normalize_name(F.col(first)).alias("_first"),
        normalize_name(F.col(last)).alias("_last"),
        normalize_name(F.col(extracted)).alias("_extracted"),
    )
    step2 = step1.select(
        "*",
        strip(F.concat(nf, F.lit(" "), nl)).alias("_straight"),
        strip(F.concat(nl, F.lit(" "), nf)).alias("_turned"),
    )
    has_first, has_last = nx.contains(nf), nx.contains(nl)
    settled = (nx == straight) | (nx == turned) | has_first | has_last
    step3 = step2.select(
        "*",
        F.when(
            ~settled,
            F.greatest(positional_similarity(nx, straight), positional_similarity(nx, turned)),
        ).alias("_similarity"),
    )

    q = F.lit("'")
    said = F.concat(q, shown, q)
    known = F.concat(q, db_first, F.lit(" "), db_last, q)
    known_turned = F.concat(q, db_last, F.lit(" "), db_first, q)

    def verdict(result: str, confidence: Column, *explanation: Column) -> Column:
        return F.struct(
            F.lit(result).alias("result"),
            confidence.alias("confidence"),
            F.concat(*explanation).alias("explanation"),
        )

    unreadable = (nx == "") | nx.isin("unknown", "unknown employee")
    chain = (
        F.when(unreadable, verdict("unknown", F.lit(0.0),
               F.lit("Could not extract employee name from certificate")))
        .when((nf == "") & (nl == ""), verdict("unknown", F.lit(0.0),
              F.lit("Student name not available in database")))
        .when(nx == straight, verdict("match", F.lit(1.0),
              F.lit("Exact match: "), said, F.lit(" matches "), known))
        .when(nx == turned, verdict("match", F.lit(0.95),
              F.lit("Name order match: "), said, F.lit(" matches "), known_turned,
              F.lit(" (reversed order)")))
        .when(has_first & has_last, verdict("match", F.lit(0.9),
              F.lit("Partial match: "), said, F.lit(" contains both '"), db_first,
              F.lit("' and '"), db_last, q))
        .when(has_first | has_last, verdict("partial_match", F.lit(0.6),
              F.lit("Partial match: "), said, F.lit(" contains '"),
              F.when(has_first, nf).otherwise(nl), q))
        .when(sim > 0.7, verdict("partial_match", sim,
              F.lit("Similar names: "), said, F.lit(" is "), _percent(sim),
              F.lit(" similar to "), known))
        .when(sim > 0.4, verdict("mismatch", F.lit(1.0) - sim,
              F.lit("Names appear different: "), said, F.lit(" vs "), known,
              F.lit(" (similarity: "), _percent(sim), F.lit(")")))
        .otherwise(verdict("mismatch", F.lit(1.0),
                   F.lit("Names do not match: "), said, F.lit(" vs "), known))
    )
    return (
        step3.select("*", chain.alias("_verdict"))
        .select(
            *df.columns,
            F.col("_verdict.result").alias("match_result"),
            F.col("_verdict.confidence").alias("match_confidence"),
            F.col("_verdict.explanation").alias("match_explanation"),
        )
    )
