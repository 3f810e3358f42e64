"""Per-group key supersets and back-filling of ragged maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.config_tables import PRIORITY_KEYS
from quayside.functions.maps import backfill
from quayside.functions.text import ColumnLike, col
from quayside.operators.joins import attach
from quayside.operators.numbering import number_rows

KEYS_PER_CHUNK = 1_000


def distinct_keys(records: DataFrame, by: list[str], data: str = "dynamic_data") -> DataFrame:
    """(group, key), each once. Map tasks already drop repeats, so a hot group ships only its keys.
    A row without keys counts as one null key, which keeps its group."""
    return records.select(*by, F.explode_outer(F.map_keys(data)).alias("key")).distinct()


def order_keys(keys: ColumnLike, priority: list[str] = PRIORITY_KEYS) -> Column:
    """Priority keys in their fixed order, then the rest ascending by code point."""
    known = F.array(*[F.lit(k) for k in priority]).cast("array<string>")
    all_keys = col(keys)
    return F.concat(F.array_intersect(known, all_keys), F.array_sort(F.array_except(all_keys, known)))


def key_superset(
    records: DataFrame, by: list[str], data: str = "dynamic_data", priority: list[str] = PRIORITY_KEYS
) -> DataFrame:
    """One ordered array of all keys per group. Its size is the number of different keys, not of
    rows; a group whose maps are all empty has an empty one."""
    return (
        distinct_keys(records, by, data)
        .groupBy(*by)
        .agg(order_keys(F.collect_list("key"), priority).alias("superset"))
    )


def superset_rows(
    records: DataFrame, by: list[str], data: str = "dynamic_data", priority: list[str] = PRIORITY_KEYS
) -> DataFrame:
    """The same as rows (group, key, 1-based position), for groups with more keys than fit a value."""
    known = F.array(*[F.lit(k) for k in priority]).cast("array<string>")
    place = F.array_position(known, F.col("key"))
    keys = distinct_keys(records, by, data).where(F.col("key").isNotNull()).withColumn(
        "_place", F.when(place > 0, place).otherwise(F.lit(len(priority) + 1))
    )
    return number_rows(keys, by, [F.col("_place"), F.col("key")], "key_pos").drop("_place")


def preview_keys(records: DataFrame, by: list[str], order: ColumnLike, data: str = "dynamic_data") -> DataFrame:
    """Keys of a group in first-seen order: by row, then by place in the row's map."""
    seen = records.select(*by, col(order).alias("_row"), F.posexplode(F.map_keys(data)).alias("_pos", "key"))
    first = seen.groupBy(*by, "key").agg(F.min(F.struct("_row", "_pos")).alias("_first"))
    in_order = F.array_sort(F.collect_list(F.struct("_first", "key")))
    return first.groupBy(*by).agg(F.transform(in_order, lambda s: s["key"]).alias("columns"))


def superset_chunks(
    records: DataFrame, by: list[str], data: str = "dynamic_data", priority: list[str] = PRIORITY_KEYS, per_chunk: int = KEYS_PER_CHUNK,
) -> DataFrame:
    """(group, chunk, keys): a group's ordered keys, at most ``per_chunk`` a row, chunks counted from 0.

    For groups with more keys than one value should hold. A group whose maps are all empty has no row.
    """
    rows = superset_rows(records, by, data, priority).withColumn("chunk", _chunk("key_pos", per_chunk))
    in_order = F.array_sort(F.collect_list(F.struct("key_pos", "key")))
    return rows.groupBy(*by, "chunk").agg(F.transform(in_order, lambda s: s["key"]).alias("keys"))


def _chunk(position: str, per_chunk: int) -> Column:
    return F.floor((F.col(position) - 1) / F.lit(per_chunk))


def record_cells(
    records: DataFrame, chunks: DataFrame, by: list[str], record: str = "record_id", data: str = "dynamic_data",
) -> DataFrame:
    """(group, record, chunk, cells): a record's own values as (0-based place in the chunk, value), in order.

    Only chunks that a record has a key of give a row, so the result is as large as the maps are,
    whatever the number of keys of their group.
    """
    places = chunks.select(*by, "chunk", F.posexplode("keys").alias("place", "key"))
    entries = records.select(*by, record, F.explode(data).alias("key", "value"))
    met = attach(entries, places, [*by, "key"], how="inner", nulls=True)
    return met.groupBy(*by, record, "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells"))


def backfill_chunks(
    records: DataFrame, chunks: DataFrame, by: list[str], record: str = "record_id", data: str = "dynamic_data",
) -> DataFrame:
    """(group, record, chunk, keys, values): every record with all keys of its group, a chunk of them a row.

    A missing key's value is "", a stored null stays null, as in ``backfill_records``; but no row holds more than a
    chunk, so neither the group's keys nor a record's need fit one value. Records of groups without keys give no row.
    """
    cells = record_cells(records, chunks, by, record, data)
    every = attach(records.select(*by, record), chunks, by, how="inner", nulls=True)
    own = cells.select(F.struct(*by, record, "chunk").alias("_key"), "cells")
    met = every.withColumn("_key", F.struct(*by, record, "chunk")).join(own, "_key", "left").drop("_key")
    known = F.map_from_entries(F.coalesce("cells", F.array().cast(cells.schema["cells"].dataType)))
    values = F.transform("keys", lambda _, i: F.when(F.map_contains_key(known, i), known[i]).otherwise(F.lit("")))
    return met.select(*by, record, "chunk", "keys", values.alias("values"))


def backfill_records(records: DataFrame, supersets: DataFrame, by: list[str], data: str = "dynamic_data") -> DataFrame:
    """Give every record of a group the same keys. The superset side has one row per group."""
    return (
        attach(records, supersets.select(*by, "superset"), by, nulls=True)
        .withColumn(data, F.when(F.col("superset").isNull(), F.col(data)).otherwise(backfill(data, "superset")))
        .drop("superset")
    )
