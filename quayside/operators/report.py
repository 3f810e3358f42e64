"""Zone report: active columns, table rows and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.config_tables import DEFAULT_INTRO, REPORT_COLUMNS
from quayside.functions.maps import filled_mask, mask_has, report_cells
from quayside.functions.text import escape_html, or_dash
from quayside.functions.zones import zone_position
from quayside.operators.joins import attach
from quayside.operators.numbering import number_rows
from quayside.operators.ranking import stripe
from quayside.operators.select import source_key
from quayside.operators.zones import in_zone_order, with_zone, zone_counts
from quayside.session import pin

ROWS_PER_FRAGMENT = 1_000

Columns = list[tuple[str, list[str]]]


def with_cells(records: DataFrame, columns: Columns = REPORT_COLUMNS) -> DataFrame:
    """Add ``cells`` (one text per report column) and ``filled`` (bit per non-empty cell)."""
    return records.withColumn("cells", report_cells("dynamic_data", columns)).withColumn(
        "filled", filled_mask("cells", len(columns))
    )


def zone_summary(cells: DataFrame, by: list[str]) -> DataFrame:
    """Row count and active columns per zone in one pass; a group ships one long per map task."""
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"), F.bit_or("filled").alias("active")
    )


def active_columns(summary: DataFrame, by: list[str], columns: Columns = REPORT_COLUMNS) -> DataFrame:
    """Headers with at least one non-empty cell, in column order."""
    headers = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(h).alias("header")) for i, (h, _) in enumerate(columns)])
    return summary.select(*by, "active", F.inline(headers)).where(mask_has("active", "pos")).drop("active")


def _join_active(values: Column, tag: str, active: Column) -> Column:
    wrapped = F.transform(
        values,
        lambda v, i: F.when(mask_has(active, i), F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>"))),
    )
    return F.array_join(wrapped, "")


def row_html(cells: Column, active: Column, raw: bool = False) -> Column:
    def text(cell: Column) -> Column:
        return or_dash(cell if raw else escape_html(cell))

    return F.concat(F.lit("<tr>"), _join_active(F.transform(cells, text), "td", active), F.lit("</tr>"))


def head_html(zone: Column, active: Column, columns: Columns = REPORT_COLUMNS) -> Column:
    headers = F.array(*[F.lit(h) for h, _ in columns])
    return F.concat(
        F.lit("<h3>"), zone, F.lit("</h3><table><thead><tr>"), _join_active(headers, "th", active),
        F.lit("</tr></thead><tbody>"),
    )


def numbered_cells(records: DataFrame, columns: Columns = REPORT_COLUMNS) -> DataFrame:
    """Records with zone, cells, number within the zone and stripe.

    A ``zone`` column that is already there is used as it is: classify places before joining
    them to their records where that is possible.
    """
    zoned = (records if "zone" in records.columns else with_zone(records)).select(
        "email_id", "zone", "attachment_id", "record_pos", "record_id", source_key().alias("_source"), "dynamic_data"
    )
    order = [F.col("_source"), F.col("attachment_id"), F.col("record_pos"), F.col("record_id")]
    numbered = number_rows(
        zoned, ["email_id", "zone"], order, then=lambda df: with_cells(df, columns).drop("dynamic_data", "_source")
    )
    return numbered.withColumn("stripe", stripe("row_index"))


def report_fragments(
    records: DataFrame, raw: bool = False, rows_per_fragment: int = ROWS_PER_FRAGMENT, columns: Columns = REPORT_COLUMNS
) -> DataFrame:
    """HTML of each zone table, cut into fragments of at most ``rows_per_fragment`` rows.

    Concatenating an e-mail's fragments by (zone_pos, fragment) gives its tables whole, so a
    zone of any size is written without ever being one value.
    """
    by = ["email_id", "zone"]
    numbered = numbered_cells(records, columns).withColumn("fragment", F.floor((F.col("row_index") - 1) / F.lit(rows_per_fragment)))
    parts = pin(zone_summary(numbered, [*by, "fragment"]))
    whole = parts.groupBy(*by).agg(F.sum("n_records").alias("n_records"), F.bit_or("active").alias("active"))
    heads = attach(parts.select(*by, "fragment"), whole, by, nulls=True)
    # Rows meet their zone's totals by fragment, so a zone with most of the rows is spread out. The key is one
    # value, in which nulls are equal: the rows cross the network once, for the join and the pieces alike.
    key = F.struct(*by, "fragment").alias("_key")
    totals = heads.select(key, "active", "n_records")
    rows = numbered.select(key, "row_index", "cells").join(totals, "_key").select(
        "_key", "active", "n_records", "row_index", row_html(F.col("cells"), F.col("active"), raw).alias("html"))
    pieces = rows.groupBy("_key", "active", "n_records").agg(
        F.array_sort(F.collect_list(F.struct("row_index", "html"))).alias("_rows")
    ).select("_key.*", "active", "n_records", "_rows")
    body = F.array_join(F.transform("_rows", lambda r: r["html"]), "")
    last = F.floor((F.col("n_records") - 1) / F.lit(rows_per_fragment))
    return pieces.select(
        *by, zone_position("zone").alias("zone_pos"), "fragment", "n_records",
        F.concat(
            F.when(F.col("fragment") == 0, head_html(F.col("zone"), F.col("active"), columns)).otherwise(F.lit("")),
            body,
            F.when(F.col("fragment") == last, F.lit("</tbody></table>")).otherwise(F.lit("")),
        ).alias("html"),
    )


def report_documents(fragments: DataFrame, intro: str = DEFAULT_INTRO) -> DataFrame:
    """(email_id, zone_pos, fragment, html): an e-mail's document in pieces, one shape at every size.

    The pieces in order of (zone_pos, fragment) are the document: the first opens it, the last closes it.
    """
    at = F.struct("zone_pos", "fragment")
    ends = fragments.groupBy("email_id").agg(F.min(at).alias("_first"), F.max(at).alias("_end"))
    opening = F.lit(f"<!DOCTYPE html><html><body><p>{intro}</p>")
    return attach(fragments, ends, ["email_id"], nulls=True).select(
        "email_id", "zone_pos", "fragment",
        F.concat(
            F.when(at == F.col("_first"), opening).otherwise(F.lit("\n")), "html",
            F.when(at == F.col("_end"), F.lit("</body></html>")).otherwise(F.lit("")),
        ).alias("html"),
    )


def zone_markers(records: DataFrame) -> DataFrame:
    """Map markers per e-mail: zone, position and count."""
    zoned = records if "zone" in records.columns else with_zone(records)
    return in_zone_order(zone_counts(zoned, ["email_id"]), ["email_id"])
