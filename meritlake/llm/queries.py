"""Queries of the corpus operators and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlake.llm.byte_bpe import decode_ids, encode_texts
from meritlake.llm.exact_dedup import mark_copies
from meritlake.llm.hard_negatives import mine_hard_negatives
from meritlake.llm.main_text import extract_main_text
from meritlake.llm.merkle import folded, leaf_digest, merkle_manifest, proof_digest
from meritlake.llm.near_dedup import near_duplicates
from meritlake.llm.neighbours import nearest
from meritlake.llm.packing import pack_documents
from meritlake.llm.quality import score, train
from meritlake.llm.repeated_spans import remove_repeats
from meritlake.llm.surrogates import replace_personal_data
from meritlake.llm.token_files import read_token_files, write_token_files
from meritlake.llm.url_templates import Rule, judge_urls
from meritlake.session import work_folder

END_ID = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    files = work_folder(spark, "token-planes")
    write_token_files(table(spark, folder, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"),
                      public_tokenizers.PATTERN, END_ID)
    return read_token_files(spark, files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = encode_texts(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN,
                          keep=["doc_id"])
    # the places are digested before the ids go to the decoding workers, which need nothing else
    tokens = tokens.select("doc_id", "ids", F.xxhash64("starts", "ends").alias("places_hash"))
    return decode_ids(tokens, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "places_hash")


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"), keep=["page_id", "url"])


# Whoever replaces data of their own passes a secret of their own.
SURROGATE_SECRET = b"surrogates of the test corpus"


def op4_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return replace_personal_data(docs, SURROGATE_SECRET)


QUALITY_LIMIT = 0.3


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, folder, "labels").filter(fold != 0)
    model = train(docs, labels, label="quality")
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"))


URL_RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"),
             Rule("allow", "org/fr/")]


def op6_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """A page is labelled as the document whose id ends its url's path."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    document = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)\A.*?://[^?#]*/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|\z)", 1)
    labels = (pages.select("page_id", document.try_cast("long").alias("doc_id"))
              .join(table(spark, folder, "labels"), "doc_id")
              .select(F.col("page_id").alias("key"), F.col("quality").alias("label")))
    return judge_urls(pages, labels, URL_RULES)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return mark_copies(docs, carry=["doc_id"])


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Tampering with every other document: its line feeds go."""
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    shown = leaf_digest([docs[c] if c != "text" else F.translate(docs[c], "\n", "") for c in fields])
    found = merkle_manifest(docs, fields, carry={"shown": F.when(touched, shown)})
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.coalesce("shown", "leaf"), F.col("proof")).alias("folded_root")).withColumn(
            "verified", F.col("folded_root") == F.col("root"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh label is moved on by one first."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), texts=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM plain WINDOW best AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST)
"""

_VALUE = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_PARENTS = ("list_transform(range(0, len(nodes), 3), lambda i: "
            "sha256(array_to_string(list_slice(nodes, i + 1, i + 3), '')))")
# SQL has no crc32, so the usual table of 256 steps is built first
OP11_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(b)),
crc AS (SELECT list(v ORDER BY b) AS steps FROM bits),
leaves AS (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="replace(text, chr(10), '')")} AS shown,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
      lambda c, d: xor(c >> 8, steps[(xor(c, d) & 255) + 1])), 4294967295) % 2 = 0 AS touched
  FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
tree AS (
  SELECT source, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY source
  UNION ALL SELECT source, level + 1, {_PARENTS} FROM tree WHERE len(nodes) > 1),
subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1),
crown AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_PARENTS} FROM crown WHERE len(nodes) > 1),
fold AS (
  SELECT p.doc_id, p.source, false AS above, 0 AS level, p.place, CASE WHEN touched THEN shown ELSE leaf END AS digest,
    '' AS siblings, p.leaf, p.place AS seat FROM placed p
  UNION ALL
  SELECT doc_id, f.source, above OR last, CASE WHEN last THEN 0 ELSE f.level + 1 END, CASE WHEN last THEN s.place ELSE f.place // 3 END,
    CASE WHEN last THEN digest ELSE sha256(before || digest || after) END, CASE WHEN last THEN siblings ELSE siblings || before || after END,
    leaf, seat
  FROM (SELECT fold.*, len(nodes) = 1 AS last,
      array_to_string(list_slice(nodes, fold.place // 3 * 3 + 1, fold.place), '') AS before,
      array_to_string(list_slice(nodes, fold.place + 2, fold.place // 3 * 3 + 3), '') AS after
    FROM fold JOIN (SELECT false AS above, source, level, nodes FROM tree UNION ALL SELECT true, NULL, level, nodes FROM crown) n
      ON n.level = fold.level AND n.above = fold.above AND (fold.above OR n.source IS NOT DISTINCT FROM fold.source)
    WHERE NOT (fold.above AND len(nodes) = 1)) f
  JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, leaf, subroot, top.nodes[1] AS root, sha256(siblings) AS proof_sha256, digest AS folded_root, digest = top.nodes[1] AS verified
FROM fold JOIN crown top ON len(top.nodes) = 1 AND above AND fold.level = top.level
JOIN subroots s ON s.source IS NOT DISTINCT FROM fold.source
"""

OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.vector, b.vector) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
  n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""

OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS document FROM documents),
windows AS (
  SELECT document, start, array_to_string(list_slice(words, start, start + 34), ' ') AS said
  FROM (SELECT document, words, unnest(range(1, len(words) - 33)) AS start FROM words)),
repeated AS (
  SELECT document, start FROM windows SEMI JOIN (SELECT said FROM windows GROUP BY said HAVING count(*) > 1) USING (said)),
gone AS (SELECT document, list(DISTINCT place) AS places FROM (
  SELECT document, unnest(range(start, start + 35)) AS place FROM repeated) GROUP BY document)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN places IS NULL THEN array_to_string(words, ' ')
    ELSE coalesce(kept, '') END) AS kept_sha256
FROM words LEFT JOIN gone USING (document)
LEFT JOIN (
  SELECT document, string_agg(word, ' ' ORDER BY place) AS kept
  FROM (SELECT document, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM words SEMI JOIN gone USING (document))
  ANTI JOIN (SELECT document, unnest(places) AS place FROM gone) USING (document, place) GROUP BY document) USING (document)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_planes": op1_token_planes,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_main_text": op3_main_text,
        "op4_surrogates": op4_surrogates,
        "op5_quality": op5_quality,
        "op6_url_templates": op6_url_templates,
        "op7_packing": op7_packing,
        "op8_neighbours": op8_neighbours,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_near_dedup": op10_near_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_repeated_spans": op13_repeated_spans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": OP9_SQL,
        "op11_merkle_manifest": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_repeated_spans": OP13_SQL,
    }
