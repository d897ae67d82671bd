"""Document files and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.text import (
    clean_text, detect_language, diacritic_count, suffix_of, text_confidence)
from meritlake.sources.calls import Call, map_with_caller


def scan_document_inventory(spark: SparkSession, folder: str,
                            suffixes: tuple[str, ...] = K.UPLOAD_SUFFIXES) -> DataFrame:
    """Files below a folder with an allowed suffix, by path. File bytes are not read.

    Spark's file source leaves out files of zero bytes; uploads refuse them as well.
    """
    return (
        _files(spark, folder, suffixes).select("path", "file_name", "size", "suffix").orderBy("path")
    )


def read_documents(spark: SparkSession, folder: str,
                   suffixes: tuple[str, ...] = K.UPLOAD_SUFFIXES) -> DataFrame:
    """The same files with their bytes, for an extractor."""
    return _files(spark, folder, suffixes).select("path", "file_name", "size", "suffix", "content")


def _files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .withColumn("file_name", F.element_at(F.split("path", "/"), -1))
        .withColumn("suffix", suffix_of(F.col("file_name")))
        .where(F.col("suffix").isin(*suffixes))
        .withColumnRenamed("length", "size")
    )


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))


def describe_results(extracted: DataFrame) -> DataFrame:
    """Result row per document from its extracted text (``answer``) and error."""
    found = F.col("success") & (F.coalesce(F.col("text"), F.lit("")) != "")
    language = detect_language(F.col("text"))
    cleaned = extracted.withColumn("text", clean_text(F.col("answer")))
    described = cleaned.withColumns({
        "success": found,
        "error": F.when(~found, F.coalesce(F.col("error"), F.lit("No text extracted from document"))),
        "text_length": F.when(found, F.length("text")).otherwise(F.lit(0)),
        "detected_language": F.when(found, language),
        "finnish_chars_count": F.when(found, diacritic_count(F.col("text"))).otherwise(F.lit(0)),
    })
    return described.withColumn(
        "confidence",
        F.when(F.col("success"), text_confidence(F.col("suffix"), F.col("detected_language")))
        .otherwise(F.lit(0.0)),
    ).select("path", "file_name", "size", "suffix", "success", "text_length", "detected_language",
             "finnish_chars_count", "confidence", "error", F.col("text").alias("extracted_text"))


def process_documents(documents: DataFrame, column: str,
                      extractors: list[tuple[str, Callable[[], Call]]],
                      partitions: int | None = None) -> DataFrame:
    """Extract and describe every document; a failing one becomes a result row with its error.

    ``documents``: path, file_name, size, suffix and the column the extractors read.
    """
    extracted = map_with_caller(
        documents, column, ["path", "file_name", "size", "suffix"], extractors, partitions)
    return describe_results(extracted)
