"""Reports on failed attachments, and their retry."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from quayside.operators.counts import counts_report, error_details, error_previews, status_summary, total_records
from quayside.operators.merge import replace_children
from quayside.operators.replies import records_from_replies, retry_results
from quayside.operators.select import only_errors
from quayside.session import pin


class Diagnostics(NamedTuple):
    status: DataFrame
    errors: DataFrame
    previews: DataFrame
    counts: DataFrame
    total: DataFrame


def diagnostics(attachments: DataFrame, records: DataFrame) -> Diagnostics:
    return Diagnostics(
        status_summary(attachments), error_details(attachments), error_previews(attachments),
        counts_report(attachments, records), total_records(records),
    )


class Retried(NamedTuple):
    attachments: DataFrame
    records: DataFrame
    new_records: DataFrame


def retry_failed(attachments: DataFrame, records: DataFrame, replies: DataFrame) -> Retried:
    """Replace the records of failed attachments whose retry gave any."""
    failed = only_errors(attachments).select("attachment_id")
    again = pin(retry_results(replies.join(failed, "attachment_id", "left_semi")))
    new_records = records_from_replies(again)
    marked, snapshot = replace_children(attachments, records, new_records)
    return Retried(marked, snapshot, new_records)
