"""Read flows: the validation grid and the inbox."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.config_tables import PRIORITY_KEYS
from quayside.functions.dates import display_date, display_time
from quayside.functions.text import file_stem, or_else, status_label
from quayside.operators.counts import grid_stats
from quayside.operators.joins import live_over_stored
from quayside.operators.ranking import grid_rows, number_rows, with_first_row_flag
from quayside.operators.select import grid_columns, is_previewable
from quayside.operators.superset import key_superset


class Grid(NamedTuple):
    rows: DataFrame
    columns: DataFrame
    stats: DataFrame


def grid(records: DataFrame, by: str = "email_id", priority: list[str] = PRIORITY_KEYS) -> Grid:
    """Numbered rows, columns with labels and totals, for every e-mail at once."""
    supersets = key_superset(records, [by], priority=priority)
    rows = grid_rows(records, [by]).withColumn(
        "source_label", file_stem(or_else("filename", F.col("attachment_id").cast("string"), F.lit("Unknown Source")))
    )
    return Grid(
        rows,
        supersets.select(by, grid_columns("superset").alias("columns")),
        grid_stats(records, [by], supersets),
    )


def inbox(emails: DataFrame, attachments: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """One row per attachment, newest e-mail first, with live status and the action flag."""
    shown = attachments.select("attachment_id", "email_id", "part_index", "filename", "status")
    if latest is not None:
        shown = live_over_stored(shown, latest)
    rows = shown.join(
        emails.select("email_id", "date_received", "sender", "subject", F.col("status").alias("email_status")), "email_id"
    )
    newest = [F.col("date_received").desc_nulls_first(), F.col("email_id"), F.col("part_index"), F.col("attachment_id")]
    numbered = number_rows(rows, [], newest, "list_pos")
    return with_first_row_flag(numbered, "email_id", "list_pos").select(
        "list_pos", "attachment_id", "email_id", display_date("date_received").alias("date"),
        display_time("date_received").alias("time"), "sender", "subject", "filename", "status",
        status_label("status").alias("status_label"), is_previewable().alias("can_preview"), "show_action",
    )
