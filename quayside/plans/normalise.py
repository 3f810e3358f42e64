"""Uniform keys per e-mail."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.config_tables import PRIORITY_KEYS
from quayside.operators.superset import backfill_records, key_superset


class Normalised(NamedTuple):
    records: DataFrame
    supersets: DataFrame
    emails: DataFrame


def normalise(
    records: DataFrame, attachments: DataFrame, emails: DataFrame, priority: list[str] = PRIORITY_KEYS
) -> Normalised:
    """Back-filled records, one superset per e-mail, and e-mails marked ready (with records or not)."""
    placed = records.join(attachments.select("attachment_id", "email_id"), "attachment_id")
    supersets = key_superset(placed, ["email_id"], priority=priority)
    filled = backfill_records(placed, supersets, ["email_id"])
    return Normalised(
        filled.select(*records.columns), supersets, emails.withColumn("status", F.lit("ready_for_validation"))
    )
