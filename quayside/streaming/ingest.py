"""Incremental ingest of message files.

Every micro-batch appends its own folder, so the cost of a batch depends on the batch alone; now and then the
folders are merged into one state. The current state is that and the log after it: a message keeps
the e-mail row of its first batch and the attachments of its last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quayside.plans.ingest import Ingested, ingest
from quayside.session import remove
from quayside.sources.messages import stream_message_files
from quayside.streaming.folders import numbers

COMPACT_EVERY = 16


def ingest_writer(
    spark: SparkSession, source: str, target: str, checkpoint: str, first_n: int = 0,
    pattern: str = "*.eml", files_per_batch: int = 10_000,
) -> DataStreamWriter:
    """Incremental ingest of a folder of message files."""
    return message_writer(stream_message_files(spark, source, pattern, files_per_batch), target, checkpoint, first_n)


def message_writer(
    messages: DataFrame, target: str, checkpoint: str, first_n: int = 0, compact_every: int = COMPACT_EVERY,
) -> DataStreamWriter:
    """Incremental ingest of a stream of (path, content) rows, from message files or archives.

    Every ``compact_every`` batches their folders are merged into one state, in which a message has one e-mail row
    and the attachments of its last batch; the folders it replaces go, but for those of the state before.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        new = ingest(batch, first_n=first_n, hold=hold)
        new.attachments.write.mode("overwrite").parquet(f"{target}/attachments/batch_id={batch_id}")
        new.emails.withColumn("status", F.lit("extracting")).write.mode("overwrite").parquet(
            f"{target}/emails/batch_id={batch_id}"
        )
        for df in held:
            df.unpersist()
        if (batch_id + 1) % compact_every == 0 and batch_id not in numbers(spark, f"{target}/_state", "emails="):
            _compact(spark, target, batch_id)

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def _compact(spark: SparkSession, target: str, batch_id: int) -> None:
    """One state of all batches up to ``batch_id``. The e-mails are written last: a state without them is not there yet."""
    before = numbers(spark, f"{target}/_state", "emails=")
    emails, attachments = _latest(spark, target, batch_id)
    attachments.write.mode("overwrite").parquet(f"{target}/_state/attachments={batch_id}")
    emails.write.mode("overwrite").parquet(f"{target}/_state/emails={batch_id}")
    for kind in ("emails", "attachments"):
        for n in numbers(spark, f"{target}/{kind}", "batch_id="):
            if before and n <= before[-1]:
                remove(spark, f"{target}/{kind}/batch_id={n}")
        for n in before[:-1]:
            remove(spark, f"{target}/_state/{kind}={n}")


def _latest(spark: SparkSession, target: str, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(e-mails with ``_last``, attachments with ``batch_id``): the last state and the batches after it."""
    states = [n for n in numbers(spark, f"{target}/_state", "emails=") if upto is None or n < upto]
    after = [n for n in numbers(spark, f"{target}/emails", "batch_id=") if (not states or n > states[-1]) and (upto is None or n <= upto)]

    def read(kind: str, order: str) -> DataFrame:
        parts = []
        if states:
            parts.append(spark.read.parquet(f"{target}/_state/{kind}={states[-1]}"))
        if after:
            rows = spark.read.option("basePath", f"{target}/{kind}").parquet(*[f"{target}/{kind}/batch_id={n}" for n in after])
            parts.append(rows.withColumn("batch_id", F.col("batch_id").cast("long")).withColumnRenamed("batch_id", order))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    if after:
        emails = read("emails", "_last")
        known = F.lit(states[-1] if states else -1)
        # A state's row is older than any batch after it, whenever its message came last.
        first = F.when(F.col("_last") <= known, F.lit(-1)).otherwise(F.col("_last"))
        rest = [c for c in emails.columns if c not in ("email_id", "_last")]
        emails = emails.groupBy("email_id").agg(F.min_by(F.struct(*rest), F.struct(first, "created_at")).alias("_e"), F.max("_last").alias("_last")).select(
            "email_id", "_e.*", "_last")
    else:
        emails = spark.read.parquet(f"{target}/_state/emails={states[-1]}")
    latest = emails.select("email_id", F.col("_last").alias("batch_id"))
    return emails, read("attachments", "batch_id").join(latest, ["email_id", "batch_id"], "left_semi")


def ingested_state(spark: SparkSession, target: str) -> Ingested:
    """A message keeps the e-mail row of its first batch and the attachments of its last."""
    emails, attachments = _latest(spark, target)
    return Ingested(emails.drop("_last"), attachments.drop("batch_id"))
