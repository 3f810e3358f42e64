"""Replies to records and attachment status."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.merge import apply_extraction
from quayside.operators.replies import (
    build_requests, parsed_attempts, records_from_replies, rejected_elements, resolve_attempts,
)
from quayside.session import pin

REQUEST_HEAD = "List the records of this text as one JSON array of objects.\n<text>\n"
REQUEST_TAIL = "\n</text>\nArray:"


class Extracted(NamedTuple):
    records: DataFrame
    attachments: DataFrame
    rejects: DataFrame


def requests(attachments: DataFrame, chars: int, head: str = REQUEST_HEAD, tail: str = REQUEST_TAIL) -> DataFrame:
    """Request table (attachment_id, chunk, prompt) for whatever service produces replies, ``chars`` of text each."""
    return build_requests(attachments, head, tail, chars)


def answered(attachments: DataFrame, answer, chars: int, head: str = REQUEST_HEAD, tail: str = REQUEST_TAIL) -> DataFrame:
    """Replies made by ``answer``, a function from a request DataFrame to a replies DataFrame."""
    return answer(requests(attachments, chars, head, tail))


def extract(attachments: DataFrame, replies: DataFrame, compat: bool = True, on_bad: str = "reject") -> Extracted:
    """Records, attachments with their new status, and elements that were no objects.

    All three come from the parsed replies, so these are pinned: parsing leaves the JVM and is
    not to run three times. Replies with a ``chunk`` are resolved chunk by chunk: records carry it, and an
    attachment is done when all its chunks are.
    """
    chunked = "chunk" in replies.columns
    if chunked:
        replies = replies.withColumn("attachment_id", F.struct("attachment_id", "chunk"))
    parsed = pin(parsed_attempts(resolve_attempts(replies, compat=compat), on_bad))
    failed = F.col("status") == "error"
    records, rejects = records_from_replies(parsed.where(~failed)), rejected_elements(parsed)
    if chunked:
        records, rejects = (
            df.withColumn("chunk", F.col("attachment_id.chunk")).withColumn("attachment_id", F.col("attachment_id.attachment_id"))
            for df in (records, rejects)
        )
        worst = F.min(F.struct(F.when(failed, 0).when(F.col("status") == "extracting", 1).otherwise(2).alias("_at"),
                               F.col("attachment_id.chunk").alias("_chunk"), "status", "error_message"))
        parsed = parsed.groupBy(F.col("attachment_id.attachment_id").alias("attachment_id")).agg(
            worst.alias("_w"), F.sum("record_count").cast("int").alias("record_count")
        ).select("attachment_id", "_w.status", "_w.error_message", "record_count")
    return Extracted(records, apply_extraction(attachments, parsed), rejects)
