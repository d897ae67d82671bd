"""Substring matching between two tables by an inverted index of character trigrams.

A text that holds a needle holds all its trigrams. Every needle is indexed under one of them, the one that fewest
needles have, where those across words, which are in most texts, count as so many more; texts give out their
trigrams, but only those that some needle is indexed under (a pattern of characters by place, then a filter, both of
bounded size). Candidates meet on the trigram, and each text then checks its own exactly. Texts are moved
once, for that check; needles of any number are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 64-bit words of the filter over trigrams: 128 KB, whatever the tables' size.
FILTER_WORDS = 1 << 14
# A trigram across words is taken only if so many times fewer needles have it than any inside a word.
ACROSS_WORDS = 16


def grams(text: Column) -> Column:
    """Distinct trigrams; a shorter text is its own only one."""
    return F.array_distinct(F.when(F.length(text) < 3, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))))


def _short_grams(text: Column) -> Column:
    """Trigrams, pairs and single characters: needles may be shorter than three."""
    parts = [F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)) for n in (1, 2, 3)]
    return F.array_distinct(F.concat(*parts))


def _word(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FILTER_WORDS)).cast("int")


def _bit(gram: Column) -> Column:
    place = F.pmod(F.shiftrightunsigned(F.xxhash64(gram), 32), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def indexed(needles: DataFrame, needle: str, keys: list[str]) -> DataFrame:
    """Distinct needles with the trigram they are indexed under; null and empty ones are left out."""
    distinct = needles.where(F.length(needle) > 0).select(*keys, needle).distinct()
    each = distinct.withColumn("gram", F.explode(grams(F.col(needle))))
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    weight = F.col("n") * F.when(F.col("gram").rlike(r"\s"), ACROSS_WORDS).otherwise(1)
    return (each.join(shared, "gram").groupBy(*keys, needle)
            .agg(F.min_by("gram", F.struct(weight.alias("weight"), "gram")).alias("gram")))


def _pattern_of(index: DataFrame) -> Column:
    """Trigrams with, at each place, an ASCII character of an indexed one there, or any other if one has such: at most 387 characters."""
    def place(number: int) -> Column:
        code = F.ascii(F.substring("gram", number, 1))
        seen = F.sort_array(F.collect_set(F.when(code < 128, F.concat(F.lit(r"\x"), F.lpad(F.hex(code), 2, "0")))))
        beyond = F.when(F.count_if(code >= 128) > 0, r"\x{80}-\x{10FFFF}").otherwise("")
        # a class must not be empty
        return F.concat(F.lit(r"[\x00"), F.array_join(seen, ""), beyond, F.lit("]"))

    return index.agg(F.concat(F.lit("(?s)(?=("), place(1), place(2), place(3), F.lit("))")).alias("pattern")).scalar()


def _filter_of(index: DataFrame) -> Column:
    """Which trigrams are indexed, as an array of ``FILTER_WORDS`` bit sets: one value for the whole table."""
    words = index.groupBy(_word(F.col("gram")).alias("word")).agg(F.bit_or(_bit(F.col("gram"))).alias("bits"))
    every = index.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("word"))
    dense = every.join(words, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("entry"))
    return dense.agg(F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["bits"]).alias("bits")).scalar()


def with_contained(rows: DataFrame, text: Column, needles: DataFrame, needle: str, keys: list[str] | None = None,
                   found: str = "found") -> DataFrame:
    """Rows with the needles that their text holds, as an array (empty without any, also for a null text).

    ``needles`` has the column ``needle`` and the ``keys``, in which a row and a needle have to agree (nulls
    never do). Null and empty needles are found nowhere; repeated ones count once.
    """
    keys = keys or []
    index = indexed(needles, needle, keys)
    named = rows.withColumn("_text", text).withColumn("_name", F.unhex(F.sha2(F.col("_text"), 256)))
    shortest = index.agg(F.min(F.length(needle)).alias("shortest")).scalar()
    # pairs and single characters matter only while there are needles that short
    own = F.when(shortest < 3, _short_grams(F.col("_text"))).otherwise(
        F.regexp_extract_all(F.col("_text"), _pattern_of(index), F.lit(1)))
    # the filter is looked up row by row, as a column it would be copied into every row
    known = F.get(_filter_of(index), _word(F.col("gram"))).bitwiseAND(_bit(F.col("gram"))) != 0
    asking = (named.where(F.col("_text").isNotNull()).select(*keys, "_name", F.explode(own).alias("gram"))
              .where(known).distinct())
    candidates = (asking.join(index, [*keys, "gram"]).groupBy(*keys, "_name")
                  .agg(F.collect_set(needle).alias("_candidates")))
    none = F.array().cast("array<string>")
    held = F.filter(F.coalesce("_candidates", none), lambda n: F.contains(F.col("_text"), n))
    return (named.join(candidates, [*keys, "_name"], "left").withColumn(found, F.coalesce(held, none))
            .select(*rows.columns, found))
