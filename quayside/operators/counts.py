"""Small aggregates and status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.config_tables import PREVIEW_CHARS
from quayside.functions.text import or_else, prefix, remainder_length, text_length
from quayside.operators.joins import record_counts
from quayside.operators.select import by_filename, only_errors


def status_summary(attachments: DataFrame) -> DataFrame:
    counts = attachments.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))
    return counts.orderBy(F.col("n_files").desc(), "status")


def total_records(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total_records"))


def extraction_total(counts: DataFrame, column: str = "record_count") -> DataFrame:
    """Sum of per-attachment counts; a failed attachment (null) adds nothing."""
    return counts.agg(F.coalesce(F.sum(F.coalesce(column, F.lit(0))), F.lit(0)).alias("total_records"))


def error_details(attachments: DataFrame) -> DataFrame:
    failed = only_errors(attachments).select(
        "attachment_id", "filename", "error_message", text_length("raw_text").alias("raw_length")
    )
    return by_filename(failed)


def error_previews(attachments: DataFrame, n: int = PREVIEW_CHARS) -> DataFrame:
    """Beginning of each failed text and how much more there is."""
    failed = only_errors(attachments).select(
        "attachment_id", "filename",
        or_else(prefix("raw_text", n), F.lit("[NO RAW TEXT]")).alias("preview"),
        remainder_length("raw_text", n).alias("more_chars"),
    )
    return by_filename(failed)


def counts_report(attachments: DataFrame, records: DataFrame) -> DataFrame:
    """Records per attachment with a marker on failed ones."""
    marked = record_counts(attachments, records).withColumn(
        "marker", F.when(F.col("status") == "error", F.lit(" ← ERROR")).otherwise(F.lit(""))
    )
    return by_filename(marked)


def grid_stats(records: DataFrame, by: list[str], supersets: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """Rows, distinct sources, distinct non-empty regions and superset size per group."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    stats = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"),
        distinct(F.nullif(F.col("attachment_id"), F.lit(""))).alias("n_sources"),
        distinct(F.nullif(F.col("region"), F.lit(""))).alias("n_regions"),
    )
    if supersets is None:
        return stats
    return stats.join(supersets.select(*by, F.size("superset").alias("n_columns")), by, "left").withColumn(
        "n_columns", F.coalesce("n_columns", F.lit(0))
    )


def normalisation_counts(records: DataFrame, supersets: DataFrame, by: str = "email_id") -> DataFrame:
    counts = records.groupBy(by).agg(F.count(F.lit(1)).alias("record_count"))
    return counts.join(
        supersets.select(by, F.size("superset").alias("column_count"), F.col("superset").alias("columns")), by
    )
