"""Counts, totals and summaries. Every aggregate combines on the map side first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.companies import company_issue, rollup_status
from meritlake.operators.intake import row_rules


def statistics(students, certificates, decisions) -> DataFrame:
    """(metric, key, n): totals, and counts by AI decision, review and training type.

    Pending reviews are the group with a null key. Each table is scanned once: a first
    aggregate over few values, from which the measures are drawn.
    """
    def measures(df: DataFrame, total: str, groups: dict[str, str]) -> DataFrame:
        counted = df.groupBy(*groups.values()).agg(F.count(F.lit(1)).alias("_n"))
        entries = [F.struct(F.lit(total).alias("metric"), F.lit(None).cast("string").alias("key"))]
        entries += [F.struct(F.lit(metric).alias("metric"), F.col(column).cast("string").alias("key"))
                    for metric, column in groups.items()]
        return (
            counted.select("_n", F.inline(F.array(*entries)))
            .groupBy("metric", "key").agg(F.sum("_n").alias("n"))
        )

    total_students = students.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total_students").alias("metric"), F.lit(None).cast("string").alias("key"), "n")
    return total_students.unionByName(
        measures(certificates, "total_certificates", {"training_type": "training_type"})
    ).unionByName(
        measures(decisions, "total_decisions",
                 {"ai_decision": "ai_decision", "reviewer_decision": "reviewer_decision"}))


def certificate_counts_by_type(students, certificates) -> DataFrame:
    """Per student the count of each training type, zero included."""
    counts = certificates.groupBy("student_id").agg(
        *[F.count_if(F.col("training_type") == kind).alias(kind.lower()) for kind in K.TRAINING_TYPES])
    return students.select("student_id").join(counts, "student_id", "left").na.fill(
        0, [kind.lower() for kind in K.TRAINING_TYPES])


def certificate_limits(students, certificates) -> DataFrame:
    """Per student and training type: may one more be added, and the message if not."""
    counts = certificate_counts_by_type(students, certificates)
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("training_type"), F.col(kind.lower()).alias("n"),
                 F.lit(K.CERTIFICATES_ALLOWED[kind]).alias("allowed"),
                 F.lit(K.LIMIT_MESSAGES[kind]).alias("_message"))
        for kind in K.TRAINING_TYPES])
    return counts.select("student_id", F.inline(kinds)).select(
        "student_id", "training_type",
        (F.col("n") < F.col("allowed")).alias("is_allowed"),
        F.when(F.col("n") >= F.col("allowed"), F.col("_message")).otherwise(F.lit("")).alias("message"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """One row about a document run; means are over all files, failed ones included."""
    one = F.count(F.lit(1))
    ok = F.count_if("success")
    chars = F.coalesce(F.sum("text_length"), F.lit(0))

    def one_decimal(value):
        return F.bround(value.cast("decimal(38,6)"), 1).cast("double")

    totals = results.agg(
        one.alias("total_files"), ok.alias("successful_files"),
        F.count_if(F.col("detected_language") == "fin").alias("finnish_files"),
        F.count_if(F.col("detected_language") == "eng").alias("english_files"),
        chars.cast("long").alias("total_characters"),
    )
    total = F.col("total_files")
    return totals.select(
        "total_files", "successful_files",
        (total - F.col("successful_files")).alias("failed_files"),
        F.when(total > 0, one_decimal(F.col("successful_files") / total * 100))
        .otherwise(F.lit(0.0)).alias("success_rate"),
        "finnish_files", "english_files", "total_characters",
        F.when(total > 0, one_decimal(F.col("total_characters") / total))
        .otherwise(F.lit(0.0)).alias("average_characters"),
    )


def finnish_summary(results: DataFrame, shown: int = 5) -> DataFrame:
    """(section, item, n): Finnish totals, the first names by path, and every failure.

    Reads ``results`` once per section, so they should be a stored table.
    """
    finnish = F.col("success") & (
        (F.col("finnish_chars_count") > 0) | F.coalesce(F.col("detected_language") == "fin", F.lit(False)))
    totals = results.agg(
        F.count_if(finnish).alias("documents"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("finnish_chars_count"))), F.lit(0)).alias("letters"),
    ).select(F.inline(F.array(
        F.struct(F.lit("finnish_documents").alias("section"), F.lit(None).cast("string").alias("item"),
                 F.col("documents").cast("long").alias("n")),
        F.struct(F.lit("finnish_characters").alias("section"), F.lit(None).cast("string").alias("item"),
                 F.col("letters").cast("long").alias("n")),
    )))
    first = results.where(finnish).orderBy("file_path").limit(shown).select(
        F.lit("finnish_file").alias("section"), F.col("file_name").alias("item"),
        F.col("finnish_chars_count").cast("long").alias("n"))
    failures = results.where(~F.col("success")).select(
        F.lit("failed").alias("section"),
        F.concat(F.col("file_path"), F.lit(": "), F.col("error")).alias("item"),
        F.lit(None).cast("long").alias("n"))
    return totals.unionByName(first).unionByName(failures)


def table_health(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Row count per table; a table that is not there is reported with a null count."""
    def one(name: str, df: DataFrame | None, any_df: DataFrame) -> DataFrame:
        if df is None:
            return any_df.sparkSession.range(1).select(
                F.lit(name).alias("table_name"), F.lit(False).alias("present"),
                F.lit(None).cast("long").alias("row_count"))
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(True).alias("present"), "row_count")

    existing = next(df for df in tables.values() if df is not None)
    return reduce(DataFrame.unionByName, [one(n, d, existing) for n, d in tables.items()])


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of each table; read from the plans, no data is touched."""
    rows = [F.struct(F.lit(table).alias("table_name"), F.lit(field.name).alias("column_name"),
                     F.lit(field.dataType.simpleString()).alias("data_type"),
                     F.lit(field.nullable).alias("nullable"), F.lit(place).alias("ordinal"))
            for table, df in tables.items()
            for place, field in enumerate(df.schema.fields, 1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.range(1).select(F.inline(F.array(*rows)))


def column_fill(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and filled values per table and column, each table scanned once."""
    def one(name: str, df: DataFrame) -> DataFrame:
        counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
        return counted.select(F.lit(name).alias("table_name"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("n_rows"), F.col(c).alias("n_filled"))
            for c in df.columns])))

    return reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])


def employment_totals(positions: DataFrame) -> DataFrame:
    """Days of all positions (overlaps counted twice, reversed ones negative) and years."""
    days = F.coalesce(F.sum(F.datediff("end_date", "start_date")), F.lit(0)).cast("long")
    return positions.groupBy("certificate_id").agg(days.alias("total_employment_days")).withColumn(
        "total_employment_years",
        F.when(F.col("total_employment_days") > 0,
               F.col("total_employment_days") / F.lit(K.DAYS_PER_YEAR)).otherwise(F.lit(0.0)))


def employer_consistency(positions: DataFrame) -> DataFrame:
    """Certificates where some positions name an employer and others have none.

    Smallest and largest employer tell whether there is only one, without a distinct count.
    """
    named = F.nullif(F.col("employer"), F.lit(""))
    return (
        positions.groupBy("certificate_id")
        .agg(F.count(F.lit(1)).alias("n_positions"), F.count(named).alias("n_named"),
             F.count_if(F.col("employer").isNull()).alias("n_null"),
             F.min(named).alias("_low"), F.max(named).alias("_high"))
        .withColumn(
            "inconsistent",
            (F.col("n_positions") >= 2) & (F.col("n_named") > 0) & (F.col("n_null") > 0)
            & ~(F.col("_low") == F.col("_high")))
        .select("certificate_id", "n_positions", F.col("n_null").alias("n_null_employers"),
                F.coalesce("inconsistent", F.lit(False)).alias("inconsistent"))
    )


def _judged(positions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Positions with their company's verdict where it is a bad one; only those matter, and they are few."""
    bad = verdicts.where("counts_as_bad").select("employer", "company", "counts_as_bad")
    return positions.join(bad, "employer", "left")


def company_rollup(certificates, positions, verdicts) -> DataFrame:
    """Per certificate the overall company status and its counts.

    ``verdicts`` has one row per employer: company struct and ``counts_as_bad``.
    """
    named = F.coalesce(F.col("employer"), F.lit("")) != ""
    per_certificate = _judged(positions, verdicts).groupBy("certificate_id").agg(
        F.count(F.lit(1)).alias("_positions"),
        F.count_if(named).alias("companies_checked"),
        F.count_if(named & F.coalesce("counts_as_bad", F.lit(False))).alias("bad_companies"))
    return (
        certificates.select("certificate_id").join(per_certificate, "certificate_id", "left")
        .select(
            "certificate_id",
            rollup_status(F.col("bad_companies"), F.col("companies_checked"), F.col("_positions"))
            .alias("status"),
            F.coalesce("companies_checked", F.lit(0)).alias("companies_checked"),
            F.coalesce("bad_companies", F.lit(0)).alias("bad_companies"),
            (F.coalesce("bad_companies", F.lit(0)) == 0).alias("validation_passed"),
        )
    )


def company_issues(positions, verdicts, keep: list[str] | None = None) -> DataFrame:
    """One issue per position at a bad company, with the position columns in ``keep``."""
    judged = _judged(positions, verdicts).where("counts_as_bad")
    return judged.select(
        "certificate_id", *(keep or []), F.inline(F.array(company_issue(F.col("employer"), F.col("company.status")))))


def combine_documents(main_texts: DataFrame, documents: DataFrame, order: list[str]) -> DataFrame:
    """Main text followed by its numbered extra documents under headers, one whole text per certificate.

    ``main_texts``: certificate_id, text. ``documents``: certificate_id, document_type,
    filename, ocr_text and the order columns, which are distinct within a certificate. The text
    of one certificate has to fit a cell (2 GB).
    """
    return _numbered(
        documents, order, F.coalesce("ocr_text", F.lit("")),
        lambda i, d: F.concat(
            F.lit("ADDITIONAL DOCUMENT "), i, F.lit(" ("),
            F.coalesce(d["document_type"], F.lit("ADDITIONAL_DOCUMENT")), F.lit(" - "),
            F.coalesce(d["filename"], F.concat(F.lit("document_"), i)), F.lit("):\n"), d["body"], F.lit("\n\n")),
        separator="", main=main_texts,
        head=F.concat(F.lit("MAIN CERTIFICATE:\n"), F.coalesce("text", F.lit("")), F.lit("\n\n")),
        empty="", name="combined_text")


def additional_doc_digest(main_texts: DataFrame, documents: DataFrame, order: list[str]) -> DataFrame:
    """Numbered digest: file name, type and the start of each document's text, one per certificate.

    Texts are cut to their start before they move.
    """
    cut = K.DIGEST_TEXT_LIMIT
    text = F.coalesce("ocr_text", F.lit(""))
    return _numbered(
        documents, order,
        F.concat(F.substring(text, 1, cut), F.when(F.length(text) > cut, F.lit("...")).otherwise(F.lit(""))),
        lambda i, d: F.concat(
            F.lit("\nAdditional Document "), i, F.lit(":\n- Filename: "),
            F.coalesce(d["filename"], F.concat(F.lit("Document "), i)),
            F.lit("\n- Type: "), F.coalesce(d["document_type"], F.lit("Unknown")),
            F.lit("\n- Content: "), d["body"], F.lit("\n")),
        separator="\n", main=main_texts, head=F.lit(""), empty="No additional documents provided.", name="digest")


def _numbered(documents, order, body, entry, separator, main, head, empty, name) -> DataFrame:
    document = F.struct(F.struct(*order).alias("place"), "document_type", "filename", body.alias("body"))
    whole = documents.groupBy("certificate_id").agg(F.sort_array(F.collect_list(document)).alias("_documents"))
    entries = F.transform("_documents", lambda d, i: entry((i + 1).cast("string"), d))
    return main.join(whole, "certificate_id", "left").select(
        "certificate_id", F.concat(head, F.coalesce(F.array_join(entries, separator), F.lit(empty))).alias(name))


def write_observed(df: DataFrame, path: str, name: str) -> DataFrame:
    """Store a table and give figures gathered while it was written: no second scan.

    table_name, row_count and, for each column, column_name and n_filled; for each row rule that some row
    breaks, problem and n_broken.
    """
    rules, found = row_rules(df.columns), Observation()
    df.observe(
        found, F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"filled {c}") for c in df.columns],
        *[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"broken {rule}") for rule, bad in rules.items()],
    ).write.mode("append").parquet(path)
    got = found.get
    rows = [(name, got["rows"], c, got[f"filled {c}"], None, None) for c in df.columns]
    rows += [(name, got["rows"], None, None, rule, got[f"broken {rule}"]) for rule in rules if got[f"broken {rule}"]]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, row_count long, column_name string, n_filled long, problem string, n_broken long")
