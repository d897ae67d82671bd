"""Degree programmes.

The programme list is a fixed list of a few dozen entries, so it sits in the plan as an
array literal: matching is a projection, with neither join nor shuffle. Keywords are data
the caller supplies: (programme_key, kind 'industry'|'role', keyword).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.binding import let
from meritlake.functions.text import degree_guidelines
from meritlake.operators.grams import with_contained

Programmes = tuple[tuple[str, str], ...]


def _listed(programmes: Programmes) -> Column:
    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    entries = [f"named_struct('key', {quoted(key)}, 'lower_name', {quoted(name.lower())})"
               for key, name in programmes]
    return F.expr(f"array({', '.join(entries)})")


def _first(programmes: Column, test) -> Column:
    return F.try_element_at(F.filter(programmes, test), F.lit(1))["key"]


def match_degree(degree: Column, programmes: Programmes = K.DEGREE_PROGRAMMES) -> Column:
    """Programme key: exact name, normalised key, lower-case key, name containing the text
    (first in the list), else 'general'."""
    lowered = F.lower(degree)
    plain = F.replace(F.regexp_replace(lowered, r"(?U)[^\p{L}\p{N}_\s]", ""), F.lit(" "), F.lit("_"))
    listed = _listed(programmes)
    return let(F.struct(lowered.alias("low"), plain.alias("plain")), lambda d: F.coalesce(
        _first(listed, lambda p: p["lower_name"] == d["low"]),
        _first(listed, lambda p: p["key"] == d["plain"]),
        _first(listed, lambda p: p["key"] == d["low"]),
        _first(listed, lambda p: p["lower_name"].contains(d["low"])),
        F.lit("general"),
    ))


def degree_supported(degree: Column, programmes: Programmes = K.DEGREE_PROGRAMMES) -> Column:
    """Known by key or by part of its name; unlike matching, punctuation stays."""
    lowered = F.lower(degree)
    spaced = F.replace(lowered, F.lit(" "), F.lit("_"))
    found = let(F.struct(lowered.alias("low"), spaced.alias("spaced")), lambda d: F.exists(
        _listed(programmes),
        lambda p: (p["key"] == d["spaced"]) | (p["key"] == d["low"]) | p["lower_name"].contains(d["low"])))
    return F.coalesce(found, F.lit(False))


def degree_catalogue(keywords: DataFrame, programmes: Programmes = K.DEGREE_PROGRAMMES) -> DataFrame:
    """Programmes in list order with their fields, industries and roles."""
    def texts(*values: str) -> Column:
        return F.array(*[F.lit(value) for value in values])

    rows = keywords.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(place).alias("place"), F.lit(key).alias("programme_key"), F.lit(name).alias("name"),
                 texts(*(K.GENERAL_FIELDS if key == "general" else (name,))).alias("fields"))
        for place, (key, name) in enumerate(programmes)])))

    def words(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("keyword"))))

    grouped = keywords.groupBy("programme_key").agg(
        words("industry").alias("industries"), words("role").alias("roles"))
    none = F.array().cast("array<string>")
    return rows.join(grouped, "programme_key", "left").withColumns(
        {"industries": F.coalesce("industries", none), "roles": F.coalesce("roles", none)})


def with_guidelines(catalogue: DataFrame) -> DataFrame:
    return catalogue.withColumn("guidelines", degree_guidelines(
        F.col("name"), F.col("industries"), F.col("roles")))


def keyword_relevance(hits: Column, medium_from: int = 1, high_from: int = 3) -> Column:
    return (
        F.when(hits >= high_from, F.lit("high"))
        .when(hits >= medium_from, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


MAX_BROADCAST_KEYWORDS = 500_000


def degree_keyword_score(texts: DataFrame, catalogue: DataFrame, medium_from: int = 1,
                         high_from: int = 3) -> DataFrame:
    """Number of the programme's keywords found in each text, and the relevance from it.

    ``texts``: programme_key, text and any other columns. The catalogue has one row per
    programme; while it holds few keywords in all (the count is checked) it travels to the
    texts, which are then neither shuffled nor multiplied. A larger one is joined by key.
    Our own rule: the thresholds are arguments.
    """
    words = F.concat("industries", "roles")
    lists = catalogue.select("programme_key", F.array_distinct(F.transform(words, F.lower)).alias("_words"))
    total = lists.agg(F.coalesce(F.sum(F.size("_words")), F.lit(0)).alias("n")).first()["n"]
    small = total <= MAX_BROADCAST_KEYWORDS
    # keywords by their longest word: a text without it holds none of them
    longest = F.array_max(F.transform(F.split("_word", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    shelves = (lists.select("programme_key", F.explode("_words").alias("_word")).where(F.col("_word").isNotNull())
               .groupBy("programme_key", longest.alias("longest")).agg(F.collect_list("_word").alias("words"))
               .groupBy("programme_key").agg(F.collect_list(F.struct("longest", "words")).alias("_shelves")))

    def held(text: Column) -> Column:
        return F.aggregate(
            F.filter("_shelves", lambda s: F.contains(text, s["longest"])), F.lit(0),
            lambda n, s: n + F.size(F.filter(s["words"], lambda w: F.contains(text, w))))

    # bound, or the text would be put in lower case once per keyword
    hits = let(F.lower("text"), held)
    return (
        texts.join(F.broadcast(shelves) if small else shelves, "programme_key", "left")
        .withColumn("keyword_hits", F.when(F.col("_shelves").isNull(), F.lit(0)).otherwise(hits))
        .withColumn("degree_relevance", keyword_relevance(F.col("keyword_hits"), medium_from, high_from))
        .drop("_shelves")
    )


def keyword_hits(texts: DataFrame, keywords: DataFrame, medium_from: int = 1, high_from: int = 3) -> DataFrame:
    """The same from a keyword table of any size (programme_key, keyword), by an index of trigrams.

    No list is gathered, counted or sent: one plan for every size.
    """
    needles = keywords.select("programme_key", F.lower("keyword").alias("_keyword"))
    found = with_contained(texts, F.lower("text"), needles, "_keyword", ["programme_key"], "_found")
    return found.withColumn("keyword_hits", F.size("_found")).withColumn(
        "degree_relevance", keyword_relevance(F.col("keyword_hits"), medium_from, high_from)).drop("_found")


def _by_name(degrees: DataFrame, programmes: DataFrame) -> DataFrame:
    """Degree texts (``low``) that are part of a programme's name, with the first such programme by place."""
    named = programmes.select("place", "key", F.lower("name").alias("_name_text"))
    found = with_contained(named, F.col("_name_text"), degrees, "low")
    held = found.select("place", "key", F.explode("found").alias("low"))
    # the empty text is part of every name
    first = programmes.where(F.col("name").isNotNull()).agg(F.min("place").alias("place"), F.min_by("key", "place").alias("key"))
    empty = first.where(F.col("place").isNotNull()).select("place", "key", F.lit("").alias("low"))
    return held.unionByName(empty).groupBy("low").agg(F.min_by("key", "place").alias("part"))


def match_degrees(degrees: DataFrame, programmes: DataFrame) -> DataFrame:
    """programme_key and supported of every distinct text in ``degree``, from a programme table of any size.

    ``programmes``: place (order in the list), key, name. The rules are those of :func:`match_degree` and
    :func:`degree_supported`; equal texts join, parts of names are found by an index of trigrams.
    """
    texts = degrees.select("degree").distinct().withColumn("low", F.lower("degree"))
    texts = texts.withColumns({
        "plain": F.replace(F.regexp_replace("low", r"(?U)[^\p{L}\p{N}_\s]", ""), F.lit(" "), F.lit("_")),
        "spaced": F.replace("low", F.lit(" "), F.lit("_"))})

    def first(of: Column, name: str, to: str) -> DataFrame:
        return programmes.groupBy(of.alias(to)).agg(F.min_by("key", "place").alias(name))

    joined = (texts.join(first(F.lower("name"), "by_name", "low"), "low", "left")
              .join(first(F.col("key"), "by_plain", "plain"), "plain", "left")
              .join(first(F.col("key"), "by_low", "low"), "low", "left")
              .join(first(F.col("key"), "by_spaced", "spaced"), "spaced", "left")
              .join(_by_name(texts, programmes), "low", "left"))
    return joined.select(
        "degree", F.coalesce("by_name", "by_plain", "by_low", "part", F.lit("general")).alias("programme_key"),
        (F.col("by_spaced").isNotNull() | F.col("by_low").isNotNull() | F.col("part").isNotNull()).alias("supported"))
