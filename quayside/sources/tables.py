"""Table scans, appends and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.ids import stable_id
from quayside.operators.joins import records_full
from quayside.operators.select import project
from quayside.schemas import TABLES


def read_table(spark: SparkSession, source: str, columns: str = "*") -> DataFrame:
    """Scan a catalog table or, when the name holds a slash, a Parquet folder."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    return project(df, columns)


def stored_form(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Nested columns as JSON text, except those in ``keep``."""
    nested = [
        f.name for f in df.schema
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and f.name not in (keep or [])
    ]
    return df.withColumns({name: F.to_json(name) for name in nested}) if nested else df


def with_ids(df: DataFrame, id_column: str, natural_key: list[str]) -> DataFrame:
    """Fill missing ids from the natural key, so a repeated task writes the same id."""
    made = stable_id(*natural_key)
    if id_column in df.columns:
        made = F.coalesce(F.nullif(F.col(id_column), F.lit("")), made)
    return df.withColumn(id_column, made)


def append_rows(df: DataFrame, path: str, id_column: str, natural_key: list[str], json_nested: bool = False) -> DataFrame:
    """Append to a Parquet table; returns the rows as written."""
    rows = with_ids(stored_form(df) if json_nested else df, id_column, natural_key)
    rows.write.mode("append").parquet(path)
    return rows


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def create_views(spark: SparkSession, **tables: DataFrame) -> None:
    """Register the tables (empty where not given) and the ``records_full`` view; safe to repeat."""
    frames = {name: tables.get(name, None) for name in TABLES}
    for name, df in frames.items():
        frames[name] = df if df is not None else empty_table(spark, name)
        frames[name].createOrReplaceTempView(name)
    records_full(frames["records"], frames["attachments"], frames["emails"]).createOrReplaceTempView("records_full")


def write_report(documents: DataFrame, path: str) -> None:
    """Write report documents as Parquet, parts of one e-mail next to each other and in order."""
    documents.repartitionByRange("email_id", "zone_pos", "fragment").sortWithinPartitions(
        "email_id", "zone_pos", "fragment"
    ).write.mode("overwrite").parquet(path)
