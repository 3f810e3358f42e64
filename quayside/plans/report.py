"""Approved records to a zone report per e-mail."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from quayside.config_tables import DEFAULT_INTRO
from quayside.operators.joins import selected_or_all
from quayside.operators.merge import advance_status
from quayside.operators.report import report_documents, report_fragments, zone_markers


class Report(NamedTuple):
    documents: DataFrame
    markers: DataFrame
    emails: DataFrame


def report(
    records: DataFrame, emails: DataFrame, selection: DataFrame | None = None, intro: str = DEFAULT_INTRO, raw: bool = False
) -> Report:
    """``records`` carry email_id and filename (see ``records_full``)."""
    chosen = records if selection is None else selected_or_all(records, selection)
    return Report(
        report_documents(report_fragments(chosen, raw), intro),
        zone_markers(chosen),
        advance_status(emails, chosen.select("email_id"), "drafted"),
    )
