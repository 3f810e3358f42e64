"""Deduplication of a stream against everything it has written, however long ago.

What was written is a sequence of runs: the folders of the last batches, and merged runs of older
ones that hold keys alone. Every run has a digest, Bloom filters by part and bucket. A batch first meets the digests, and
opens those parts of those runs only whose digest says that a key of the batch may be there. FAN
runs of a level are merged into one of the next, so their number grows with the logarithm of the
number of batches, and a key is written again once a level.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quayside.operators.blooms import BITS_PER_KEY, BUCKET_BITS, bitmaps, bucket, may_hold
from quayside.session import folders, remove
from quayside.streaming.folders import numbers, part_of

PARTS = 64
FAN = 8
# With 16 bits a key and two bits set, 1.4 % of unknown keys look known.
_BITS = "part int, bucket int, bits binary"


class Run(NamedTuple):
    level: int
    number: int
    buckets: int


def runs(spark: SparkSession, path: str) -> list[Run]:
    """Runs with a complete digest. The number of buckets is part of the digest's name."""
    found = []
    for level in folders(spark, f"{path}/_digests"):
        for name in folders(spark, f"{path}/_digests/{level}"):
            for buckets in folders(spark, f"{path}/_digests/{level}/{name}"):
                if "_SUCCESS" in folders(spark, f"{path}/_digests/{level}/{name}/{buckets}"):
                    found.append(Run(*(int(x.partition("=")[2]) for x in (level, name, buckets))))
    return sorted(found)


def _keys_path(path: str, run: Run) -> str:
    """Level 0 are the rows of a batch themselves; of these only the key is read."""
    return f"{path}/batch_id={run.number}" if run.level == 0 else f"{path}/_keys/level={run.level}/run={run.number}"


def _keys(spark: SparkSession, path: str, run: Run, schema: str, key: str) -> DataFrame:
    return spark.read.schema(f"{schema}, part int").parquet(_keys_path(path, run)).where(F.col(key).isNotNull())


def write_digest(keys: DataFrame, path: str, level: int, number: int, key: str) -> None:
    """Digest of a run's (key, part) rows; map-side bitmaps are merged, keys do not move."""
    largest = keys.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, math.ceil(largest * BITS_PER_KEY / BUCKET_BITS))
    bitmaps(keys, key, buckets, ["part"]).write.mode("overwrite").parquet(f"{path}/_digests/level={level}/run={number}/buckets={buckets}")


def suspects(new: DataFrame, path: str, known: list[Run], key: str) -> DataFrame:
    """(key, part, level, run): keys that a run's digest does not rule out."""
    spark = new.sparkSession
    asked = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in run._asdict().items()]) for run in known])).alias("r")
    tried = new.select(key, "part", asked).select(key, "part", F.col("r.level").alias("level"), F.col("r.number").alias("run"), bucket(key, F.col("r.buckets")).alias("bucket"))
    paths = [f"{path}/_digests/level={r.level}/run={r.number}/buckets={r.buckets}" for r in known]
    digests = spark.read.schema(f"{_BITS}, level int, run int").option("basePath", f"{path}/_digests").parquet(*paths).select("part", "bucket", "bits", "level", "run")
    return tried.join(digests, ["level", "run", "part", "bucket"]).where(may_hold(key)).select(key, "part", "level", "run")


def parts_to_open(found: DataFrame, path: str) -> list[str]:
    """Folders of the parts that hold a suspected key: at most ``parts`` a run."""
    rows = found.select("level", "run", "part").distinct().collect()
    return sorted(f"{_keys_path(path, Run(r.level, r.run, 0))}/part={r.part}" for r in rows)


def merge_runs(spark: SparkSession, path: str, schema: str, key: str, fan: int = FAN) -> None:
    """Merge ``fan`` runs of a level into one of the next. Rows stay; merged key folders and digests go."""
    level = 0
    while True:
        now = [r for r in runs(spark, path) if r.level == level]
        if len(now) < fan:
            return
        merged = _keys(spark, path, now[0], schema, key)
        for run in now[1:]:
            merged = merged.unionByName(_keys(spark, path, run, schema, key))
        to = Run(level + 1, now[-1].number, 0)
        merged.repartition("part").sortWithinPartitions("part", key).write.mode("overwrite").partitionBy("part").parquet(_keys_path(path, to))
        write_digest(_keys(spark, path, to, schema, key), path, to.level, to.number, key)
        for run in now:
            remove(spark, f"{path}/_digests/level={run.level}/run={run.number}")
            if run.level:
                remove(spark, _keys_path(path, run))
        level += 1


def dedup_writer(
    messages: DataFrame, path: str, checkpoint: str, key: str = "message_id", parts: int = PARTS, fan: int = FAN,
) -> DataStreamWriter:
    """First rows of every key, however late the repeats. Rows without a key are all kept.

    A batch's rows are written first, then their digest, then runs are merged. A batch that is replayed
    after its rows were complete writes only what is missing of the rest, so it never meets its own keys.
    """
    field = messages.schema[key]
    schema = f"`{key}` {field.dataType.simpleString()}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = runs(spark, path)
        if batch_id not in numbers(spark, path, "batch_id="):
            new = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("part", part_of(key, parts)).persist()
            fresh = new
            if known:
                found = suspects(new, path, known, key).persist()
                opened = parts_to_open(found, path)
                if opened:
                    seen = spark.read.schema(schema).parquet(*opened)
                    again = found.select(key).distinct().join(seen, key, "left_semi")
                    fresh = new.join(again, key, "left_anti").select(*new.columns)
            fresh.unionByName(batch.where(F.col(key).isNull()).withColumn("part", F.lit(0))).write.mode("overwrite").partitionBy("part").parquet(
                f"{path}/batch_id={batch_id}")
            new.unpersist()
            if known:
                found.unpersist()
        if not any(r.number >= batch_id for r in known):
            write_digest(_keys(spark, path, Run(0, batch_id, 0), schema, key), path, 0, batch_id, key)
        merge_runs(spark, path, schema, key, fan)

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def deduplicated_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("part", "batch_id")
