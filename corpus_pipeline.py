"""The corpus pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlake.llm.exact_dedup import drop_copies
from meritlake.llm.near_dedup import drop_near_duplicates
from meritlake.llm.packing import pack_documents
from meritlake.llm.quality import score, train
from meritlake.llm.queries import END_ID, QUALITY_LIMIT, SURROGATE_SECRET
from meritlake.llm.surrogates import replace_personal_data
from meritlake.session import work_folder


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier scores as good stay; it learns from the labels of four of five rows."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(fold != 0)
    model = train(docs, labels, label="quality")
    others = [docs[c] for c in docs.columns if c != "text"]
    wrapped = docs.select(F.struct(F.lit(0).alias("none"), *others).alias("document"), "text")
    good = score(wrapped, model, keep=["document", "text"]).filter(F.col("score") >= QUALITY_LIMIT)
    return good.select(*[F.col("text") if c == "text" else F.col("document").getField(c).alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data becomes surrogates; n_chars follows the text."""
    changed = replace_personal_data(docs, SURROGATE_SECRET)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(
            F.col("n_replaced") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sequences of token ids, one per piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

# scores, samples and token ids are not SQL's to compute; tests hold each stage against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        place = work_folder(spark, name)
        stage(spark, docs, folder).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
