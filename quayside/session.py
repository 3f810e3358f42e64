"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter once tables no longer fit one machine. They are defaults:
# anything the cluster or the caller sets wins.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key even where the split costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stream state (one small row per attachment or job) may outgrow the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "quayside", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SCALE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for sessions created elsewhere: the time zone results depend on, and the
    splitting of hot join keys."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Python workers get batches bounded in rows and in bytes: one batch never holds many long texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder; a cluster
    without it is an error, because a machine-local folder is lost with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="quayside-checkpoint-")
    context.setCheckpointDir(shared)


_recorded: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    for paths in _recorded:
        paths.append(path)
    return path


@contextmanager
def recorded_paths() -> Iterator[list[str]]:
    """The shared paths given out meanwhile, for a caller that removes them once all that reads them is written."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        yield paths
    finally:
        _recorded.remove(paths)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Used where row placement must stay fixed between two passes over the same rows, or where
    an expensive step feeds several results. A table rather than an RDD checkpoint: later
    passes read only the columns they need, and the planner knows its size.
    """
    path = shared_path(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names below a path of any file system that Spark reads; none where the path is not there."""
    place, store = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote and no longer needs."""
    place, store = _hadoop(spark, path)
    store.delete(place, True)
