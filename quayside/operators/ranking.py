"""Order-dependent operators.

Only the top-n ones use a window: Catalyst limits each map task to n rows per key before the
shuffle. Firsts, lasts and breaks are aggregates. Full numbering spreads a hot group over
many tasks by sorting the whole table instead of one window partition per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.config_tables import RECENT_EVENTS
from quayside.functions.text import ColumnLike, col
from quayside.operators.joins import attach
from quayside.operators.numbering import number_rows
from quayside.operators.select import contains_ignoring_case, is_ready, source_key


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def first_n_attachments(attachments: DataFrame, n: int = 0, by: str = "email_id", order: str = "part_index") -> DataFrame:
    """First ``n`` attachments of each e-mail; all of them when ``n`` is not positive."""
    return top_n(attachments, [by], [F.col(order)], n) if n > 0 else attachments


def recent_per_job(events: DataFrame, n: int = RECENT_EVENTS) -> DataFrame:
    return top_n(events, ["job_id"], [F.col("seq").desc()], n)


def stripe(row_index: ColumnLike) -> Column:
    """0 for the first, third, ... row of a group, 1 for the others."""
    return ((col(row_index) - 1) % 2).cast("int")


def with_group_break(df: DataFrame, by: list[str], group: str, position: str) -> DataFrame:
    """True on the first row of each source. Sources are contiguous in grid order, so the row
    that differs from its predecessor is the source's lowest one; no look-back is needed."""
    first = df.groupBy(*by, group).agg(F.min(position).alias("_first"))
    return attach(df, first, [*by, group]).withColumn("is_break", F.col(position) == F.col("_first")).drop("_first")


def with_first_row_flag(rows: DataFrame, by: str, position: str, status: ColumnLike = "email_status") -> DataFrame:
    """True on the first row, in list order, of each e-mail that is ready."""
    ready = rows.where(is_ready(status)).groupBy(by).agg(F.min(position).alias("_first"))
    return attach(rows, ready, [by]).withColumn(
        "show_action", F.coalesce(F.col(position) == F.col("_first"), F.lit(False))
    ).drop("_first")


def latest_message(messages: DataFrame, order: str, sender: str | None = None, subject: str | None = None,
                   by: list[str] | None = None) -> DataFrame:
    """Newest message that passes the filters, over all or per group.

    The newest ``order`` of each group is found without the texts; only the rows that have it meet again.
    """
    matching = messages
    if sender is not None:
        matching = matching.where(contains_ignoring_case("sender", sender))
    if subject is not None:
        matching = matching.where(contains_ignoring_case("subject", subject))
    if not by:
        return matching.where(F.col(order).isNotNull()).orderBy(F.col(order).desc()).limit(1)
    rest = [c for c in messages.columns if c not in by]
    tops = matching.groupBy(*by).agg(F.max(order).alias("_top"))
    newest = attach(matching, tops, by, "inner", nulls=True).where(F.col(order) == F.col("_top"))
    return newest.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_m")).select(*by, "_m.*")


def first_attachment(attachments: DataFrame, by: str = "email_id") -> DataFrame:
    """First attachment of each e-mail by creation time, then part order."""
    return attachments.groupBy(by).agg(
        F.min_by("attachment_id", F.struct("created_at", "part_index", "attachment_id")).alias("attachment_id")
    )


def grid_rows(records: DataFrame, by: list[str]) -> DataFrame:
    """Records with display number and source break. Needs attachment_id, filename, record_pos."""
    keyed = records.withColumn("_source", source_key())
    numbered = number_rows(
        keyed, by, [F.col("_source"), F.col("attachment_id"), F.col("record_pos"), F.col("record_id")]
    )
    return with_group_break(numbered, by, "attachment_id", "row_index").drop("_source")
