"""Streaming forms of the status operators.

The aggregates themselves are in ``operators.status`` and serve both modes. Their state is
one small row per attachment or job; the session keeps it in RocksDB. Grouped by ``event_window`` as well
it is bounded: a window's rows leave the state once the watermark has passed it, and the result
keeps one row per key and window, which the ``merged_`` functions put together. Results live in folders
of Parquet that every micro-batch adds to, bounded by compaction: a replayed batch overwrites
only its own folder, and old folders go when a later one holds their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quayside.config_tables import RECENT_EVENTS
from quayside.operators.ranking import recent_per_job
from quayside.session import folders, remove
from quayside.streaming.dedup import dedup_writer, deduplicated_rows
from quayside.streaming.folders import numbers as _numbers, part_of as _part

PARTS = 64
__all__ = [
    "current_rows", "dedup_writer", "deduplicated_rows", "event_time", "event_window", "recent_log_writer", "recent_rows", "upsert_writer",
]
COMPACT_EVERY = 16


def event_time(events: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Watermarked events; timestamps without zone are not accepted as event time, hence the cast."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def event_window(events: DataFrame, width: str = "1 day", column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Watermarked events with ``window``, the start of their stretch of event time.

    An aggregate by key and ``window`` keeps state for the stretches that may still get events, those later than
    the last event less ``delay``: finished jobs and old attachments are not in it. Events that come later than that are left out.
    """
    return event_time(events, column, delay).withColumn("window", F.window(column, width))


def upsert_writer(aggregated: DataFrame, path: str, checkpoint: str, key: str | list[str] | None = None, compact_every: int = COMPACT_EVERY) -> DataStreamWriter:
    """Changed rows of an aggregate, one folder per micro-batch. A replayed batch overwrites its own.

    With a ``key`` every ``compact_every`` batches are merged into one table of current rows, and the
    folders it replaces are removed, but for the one before it, so a reader or a replay finds
    what it began with.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if key is None or (batch_id + 1) % compact_every or batch_id in _numbers(spark, path, "base="):
            return
        _log(spark, path, key).write.mode("overwrite").parquet(f"{path}/base={batch_id}")
        for n in _numbers(spark, path, "batch_id="):
            if n <= batch_id - compact_every:
                remove(spark, f"{path}/batch_id={n}")
        for n in _numbers(spark, path, "base=")[:-2]:
            remove(spark, f"{path}/base={n}")

    return (
        aggregated.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    )


def _log(spark: SparkSession, path: str, key: str | list[str]) -> DataFrame:
    """Latest row per key with its ``_batch``: the last table of current rows and the batches after it."""
    base = _numbers(spark, path, "base=")
    after = [n for n in _numbers(spark, path, "batch_id=") if not base or n > base[-1]]
    rows = [spark.read.parquet(f"{path}/base={base[-1]}")] if base else []
    if after:
        log = spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={n}" for n in after])
        rows.append(log.withColumn("_batch", F.col("batch_id").cast("long")).drop("batch_id"))
    log = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def current_rows(spark: SparkSession, path: str, key: str | list[str]) -> DataFrame:
    """Latest row per key of what ``upsert_writer`` wrote."""
    return _log(spark, path, key).drop("_batch")


def _versions(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Version numbers of every part of a recent log, ascending. A version's folder appears whole, when its batch commits."""
    return {p: sorted(int(v.removeprefix("version=")) for v in folders(spark, f"{path}/{p}")) for p in folders(spark, path) if p.startswith("part=")}


def recent_log_writer(events: DataFrame, path: str, checkpoint: str, n: int = RECENT_EVENTS, parts: int = PARTS) -> DataStreamWriter:
    """Keep the last ``n`` events of each job; a batch rewrites only the parts (hashes of job) it has events of.

    A batch is one write, whatever the number of parts: it makes a new version of each part it touches and
    leaves the others alone. A part's versions hold its result so far; the last two are kept.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("part", _part("job_id", parts)).persist()
        # At most ``parts`` numbers.
        touched = {f"part={r.part}" for r in rows.select("part").distinct().collect()}
        before = {p: [v for v in known if v < batch_id] for p, known in _versions(spark, path).items() if p in touched}
        old = [f"{path}/{p}/version={known[-1]}" for p, known in before.items() if known]
        merged = rows.unionByName(spark.read.option("basePath", path).parquet(*old).drop("version")) if old else rows
        kept = recent_per_job(merged, n).withColumn("version", F.lit(batch_id)).repartition("part")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("part", "version").parquet(path)
        rows.unpersist()
        for p, known in before.items():
            for v in known[:-1]:
                remove(spark, f"{path}/{p}/version={v}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)


def recent_rows(spark: SparkSession, path: str) -> DataFrame:
    """Last versions of what ``recent_log_writer`` wrote; only their folders are read."""
    last = [f"{path}/{p}/version={known[-1]}" for p, known in _versions(spark, path).items() if known]
    return spark.read.option("basePath", path).parquet(*last).drop("part", "version")
