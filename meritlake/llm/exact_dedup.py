"""Exact copies by two-pass Bloom filtering, in built-in functions only.

First pass: every text's hash goes to a cell of a counting filter that is kept sparse (one row
per used cell, combined before the shuffle). Cells counted twice are folded into a Bloom filter
of fixed size. Second pass: rows that the filter does not know cannot have a copy and pass
straight through; only the others are written once, grouped by the digest of their text, and
joined with their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.session import work_folder

# Deleted before texts are compared: space and the characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
CELLS = 1 << 40
# 64-bit words of the second filter: 16 bytes a row, 16 MB at most, whatever the input.
FILTER_WORDS = 1 << 20


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _word(cell: Column) -> Column:
    return F.pmod(F.xxhash64(cell, F.lit("word")), F.lit(FILTER_WORDS))


def _mask(cell: Column) -> Column:
    """Two bits of a word."""
    mixed = F.xxhash64(cell, F.lit("bits"))
    first = F.pmod(mixed, F.lit(64)).cast("int")
    second = F.pmod(F.shiftrightunsigned(mixed, 6), F.lit(64)).cast("int")
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, first).bitwiseOR(F.call_function("shiftleft", one, second))


def bloom_filter(keys: DataFrame, key: str) -> DataFrame:
    """Bloom filter of the values of a column: word, bits; at most FILTER_WORDS rows."""
    return (keys.select(_word(F.col(key)).alias("word"), _mask(F.col(key)).alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("bits")))


def perhaps_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be one of the keys, none of these left out; nothing but the filter moves."""
    known = bloom_filter(keys, key)
    return (rows.withColumn("word", _word(F.col(key))).join(F.broadcast(known), "word")
            .filter(F.col("bits").bitwiseAND(_mask(F.col(key))) == _mask(F.col(key))).drop("word", "bits"))


def without(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among the keys. Rows that the filter does not know stay where they lie; the others, few, are joined."""
    flagged = rows.withColumn("word", _word(F.col(key))).join(F.broadcast(bloom_filter(keys, key)), "word", "left").withColumn(
        "maybe", F.coalesce(F.col("bits").bitwiseAND(_mask(F.col(key))) == _mask(F.col(key)), F.lit(False)))
    apart = flagged.filter(~F.col("maybe")).select(*rows.columns)
    return apart.unionByName(flagged.filter("maybe").select(*rows.columns).join(keys, key, "left_anti"))


def repeated_filter(cells: DataFrame) -> DataFrame:
    """Bloom filter of the cells that more than one row has: word, bits; at most FILTER_WORDS rows."""
    return bloom_filter(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "cell")


def mark_copies(docs: DataFrame, text: str = "text", key: str = "doc_id",
                carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) with keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting white space. The row with the most code points,
    then the smallest key, stays. A null text counts as empty; all empty texts are one group. A
    null key comes after all others; if every key of the group is null, keep_id is null. Rows
    repeated with the same key stay once. Input columns named like one of the four results are
    replaced by it. An empty table gives an empty table.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    carry = [c for c in (carry or docs.columns) if c not in results]
    plain = normalised(docs[text])
    rows = docs.select(
        F.struct(*[docs[c] for c in carry]).alias("row"),
        docs[key].alias("key"),
        F.length(F.coalesce(docs[text], F.lit(""))).alias("size"),
        F.sha2(plain, 256).alias("sha"),
        F.pmod(F.xxhash64(plain), F.lit(CELLS)).alias("cell"))
    known = repeated_filter(rows.select("cell"))
    rows = rows.withColumn("word", _word(F.col("cell")))
    marked = rows.join(F.broadcast(known), "word", "left").withColumn(
        "maybe", F.coalesce(F.col("bits").bitwiseAND(_mask(F.col("cell"))) == _mask(F.col("cell")), F.lit(False)))

    alone = marked.filter(~F.col("maybe")).select(
        "row.*", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))

    spark = docs.sparkSession
    folder = work_folder(spark, "maybe-copies")
    # the place numbers break ties between repeated rows; written, so that every reader sees the same
    (marked.filter("maybe").select("row", "key", "size", "sha", F.monotonically_increasing_id().alias("place"))
     .write.parquet(folder))
    several = spark.read.parquet(folder)
    best = several.groupBy("sha").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("size")).alias("size"), F.col("key").isNull().alias("last"), "key", "place"))
        .alias("best"))
    grouped = several.join(best, "sha").select(
        "row.*", F.col("best.key").alias("keep_id"), "group_size",
        (F.col("place") == F.col("best.place")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of equal texts, with the columns of the input."""
    wrapped = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"),
                          docs[text].alias("text"), docs[key].alias("doc_id"))
    return mark_copies(wrapped, carry=["document"]).filter("kept").select("document.*")
