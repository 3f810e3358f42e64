"""Status events. Each function takes a batch or a streaming DataFrame alike, unless it says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.config_tables import EVENT_STATUS, TERMINAL_EVENTS
from quayside.functions.text import ColumnLike, col
from quayside.operators.joins import attach


def status_of(event_type: ColumnLike, mapping: dict[str, str] = EVENT_STATUS) -> Column:
    """Attachment status an event leads to; null for events that change none."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*pairs)[col(event_type)]


def latest_status(events: DataFrame, mapping: dict[str, str] = EVENT_STATUS, by: Sequence[str] = ()) -> DataFrame:
    """Status after the last status event of each attachment, or of each and the columns ``by``.

    The aggregate keeps one number per status, the last time it was seen, rather than a text:
    fixed-size buffers are hashed, text buffers would have every task sort its events first.
    """
    statuses = sorted(set(mapping.values()))
    seen = (
        events.select("attachment_id", *by, "seq", status_of("type", mapping).alias("_s"))
        .where(F.col("_s").isNotNull() & F.col("attachment_id").isNotNull())
        .groupBy("attachment_id", *by)
        .agg(*[F.max(F.when(F.col("_s") == s, F.col("seq"))).alias(f"_{i}") for i, s in enumerate(statuses)])
    )
    last = F.array_max(F.array(*[
        F.struct(F.col(f"_{i}").alias("seq"), F.lit(s).alias("status")) for i, s in enumerate(statuses)
    ]))
    return seen.select("attachment_id", *by, last.alias("_l")).select("attachment_id", *by, "_l.status", "_l.seq")


def merged_status(parts: DataFrame) -> DataFrame:
    """Latest status over the parts of an attachment, as ``latest_status`` with ``by`` makes them."""
    return parts.groupBy("attachment_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def job_events(events: DataFrame, job_id) -> DataFrame:
    return events.where(F.col("job_id") == F.lit(job_id))


def up_to_terminal(events: DataFrame, terminal: list[str] = TERMINAL_EVENTS) -> DataFrame:
    """A job's events up to and including its first terminal one. For a batch: the end is looked up among all events,
    which a stream has not seen yet."""
    ends = events.where(F.col("type").isin(terminal)).groupBy("job_id").agg(F.min("seq").alias("_end"))
    return attach(events, ends, ["job_id"]).where(
        F.col("_end").isNull() | (F.col("seq") <= F.col("_end"))
    ).drop("_end")


def job_states(events: DataFrame, terminal: list[str] = TERMINAL_EVENTS, by: Sequence[str] = ()) -> DataFrame:
    """Whether each job has ended, and its last event; for each job, or each and the columns ``by``.

    A batch first keeps the last event of each type, so that little is left to compare; a stream
    compares as events come, since it takes one aggregate only.
    """
    if not events.isStreaming:
        events = events.groupBy("job_id", *by, "type").agg(F.max("seq").alias("seq"))
    return events.groupBy("job_id", *by).agg(
        F.bool_or(F.col("type").isin(terminal)).alias("finished"),
        F.max_by("type", "seq").alias("last_type"),
        F.max("seq").alias("last_seq"),
    )


def merged_states(parts: DataFrame) -> DataFrame:
    """State of each job over its parts, as ``job_states`` with ``by`` makes them."""
    return parts.groupBy("job_id").agg(
        F.bool_or("finished").alias("finished"), F.max_by("last_type", "last_seq").alias("last_type"), F.max("last_seq").alias("last_seq"))


def running_totals(events: DataFrame, done_type: str = "extraction_done", by: Sequence[str] = ()) -> DataFrame:
    """Records extracted so far per job, or per job and the columns ``by``."""
    done = F.when(F.col("type") == done_type, F.coalesce("record_count", F.lit(0))).otherwise(F.lit(0))
    return events.groupBy("job_id", *by).agg(F.sum(done.cast("long")).alias("total_records"))


def merged_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("job_id").agg(F.sum("total_records").alias("total_records"))


def event_payload(events: DataFrame) -> DataFrame:
    """Each event as one JSON text ``{"type": ..., fields...}`` without null fields."""
    fields = [c for c in events.columns if c not in ("type", "job_id")]
    return events.select("job_id", F.to_json(F.struct("type", *fields)).alias("payload"))


def wrapped_payload(events: DataFrame, data: str) -> DataFrame:
    """Payload of an event that carries one plain value instead of named fields."""
    return events.select("job_id", F.to_json(F.struct("type", F.col(data).alias("data"))).alias("payload"))
