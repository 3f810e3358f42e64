"""Message files to e-mails and attachments."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.blooms import MOST_BUCKETS, with_maybe
from quayside.operators.joins import without_removed
from quayside.operators.merge import merge_emails
from quayside.operators.select import from_sender, subject_contains
from quayside.session import pin
from quayside.sources.messages import message_attachments, message_emails, parse_messages, with_headers


Hold = Callable[[DataFrame], DataFrame]


class Ingested(NamedTuple):
    emails: DataFrame
    attachments: DataFrame


def _chosen(messages: DataFrame, sender: str | None, subject: str | None) -> DataFrame:
    headed = with_headers(messages)
    if sender is not None:
        headed = from_sender(headed, sender)
    if subject is not None:
        headed = subject_contains(headed, subject)
    return headed


def superseded_paths(heads: DataFrame) -> DataFrame:
    """Paths whose message id comes again under a later path."""
    ids = heads.select("path", "message_id")
    repeated = ids.groupBy("message_id").agg(F.max("path").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return ids.join(repeated, "message_id").where(F.col("path") < F.col("_last")).select("path")


def without_paths(messages: DataFrame, paths: DataFrame, hold: Hold = pin, buckets: int = MOST_BUCKETS) -> DataFrame:
    """Leave out messages by path; bodies stay where they are, whatever the number of paths.

    A Bloom filter of the paths, of a bounded size, goes to the messages. What it lets through is certainly kept. Of
    the rest, the few that only look like a path are found from the paths alone; they get a filter of their own,
    and what passes that is compared exactly. So the bodies that are shuffled are a hundredth, not the repeats.
    """
    paths = hold(paths.select("path"))
    if paths.isEmpty():
        return messages
    marked = with_maybe(messages, paths, "path", "_maybe", hold, buckets)
    kept = marked.where(~F.col("_maybe")).drop("_maybe")
    looked = with_maybe(messages.select("path"), paths, "path", "_maybe", hold, buckets).where("_maybe").select("path")
    spared = hold(looked.join(paths, "path", "left_anti").select("path"))
    if spared.isEmpty():
        return kept.select(*messages.columns)
    suspects = marked.where("_maybe").drop("_maybe")
    passed = with_maybe(suspects, spared, "path", "_spared", hold, buckets).where("_spared").drop("_spared")
    return kept.select(*messages.columns).unionByName(passed.join(spared.distinct(), "path", "left_semi").select(*messages.columns))


def ingest(
    messages: DataFrame, sender: str | None = None, subject: str | None = None, first_n: int = 0,
    hold: Hold = pin,
) -> Ingested:
    """E-mails and their attachments, or each one's ``first_n``, from (path, content) rows.

    The headers are read first and held (pinned, unless told otherwise), as they are small and
    used three times: for the e-mail rows, for the choice of messages and for repeats of a
    message id, where the first message gives the e-mail and the last its attachments.
    """
    heads = hold(_chosen(messages, sender, subject).drop("content"))
    bodies = messages if sender is None and subject is None else _chosen(messages, sender, subject).select("path", "content")
    parsed = parse_messages(without_paths(bodies, superseded_paths(heads), hold=hold))
    return Ingested(message_emails(heads), message_attachments(parsed, first_n))


class Snapshot(NamedTuple):
    emails: DataFrame
    attachments: DataFrame
    records: DataFrame


def merge_ingested(current: Snapshot, new: Ingested, order: str = "message_id") -> Snapshot:
    """Upsert a batch: a message seen before loses its old attachments and their records."""
    merged = merge_emails(current.emails, new.emails, order)
    again = merged.where("is_incoming").select("email_id")
    dropped = current.attachments.join(again, "email_id", "left_semi").select("attachment_id")
    keys = merged.where("is_incoming").select("message_id", F.col("email_id").alias("_id"))
    fresh = (
        new.attachments.join(
            new.emails.select("email_id", "message_id").join(keys, "message_id").select("email_id", "_id"), "email_id"
        ).withColumn("email_id", F.col("_id")).drop("_id")
    )
    return Snapshot(
        merged.drop("is_incoming"),
        without_removed(current.attachments, again, "email_id").unionByName(
            fresh.select(*current.attachments.columns)
        ),
        without_removed(current.records, dropped, "attachment_id"),
    )
