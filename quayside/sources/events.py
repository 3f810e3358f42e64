"""Status event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.schemas import STATUS_EVENTS


def read_status_events(spark: SparkSession, path: str, schema: str = STATUS_EVENTS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_status_events(
    spark: SparkSession, path: str, schema: str = STATUS_EVENTS, files_per_batch: int = 1_000
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_status_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
