"""Expressions over schemaless ``map<string,string>`` rows.

None of them depends on spark.sql.mapKeyDedupPolicy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.config_tables import NULL_TOKENS, REPORT_COLUMNS
from quayside.functions.text import ColumnLike, col, key_form, let, strip


def normalise_keys(m: ColumnLike) -> Column:
    """Lower-case keys with blanks as underscores; on collision the later entry wins."""
    data = col(m)
    parts = F.struct(
        F.transform(F.map_keys(data), key_form).alias("k"),
        F.map_values(data).alias("v"),
    )

    def build(p: Column) -> Column:
        unique = F.array_distinct(p["k"])
        last = F.transform(
            unique,
            lambda k: F.element_at(
                F.reverse(p["v"]), F.array_position(F.reverse(p["k"]), k).cast("int")
            ),
        )
        return F.when(F.size(unique) == F.size(p["k"]), F.map_from_arrays(p["k"], p["v"])).otherwise(
            F.map_from_arrays(unique, last)
        )

    return let(parts, build)


def split_region(m: ColumnLike) -> tuple[Column, Column]:
    """(region, map without it). Only the exact key ``region`` counts."""
    data = col(m)
    return data["region"], F.map_filter(data, lambda k, _: k != "region")


def value_or(m: ColumnLike, key: str, default: str = "") -> Column:
    return F.coalesce(col(m)[key], F.lit(default))


def set_cell(m: ColumnLike, field: ColumnLike, value: ColumnLike) -> Column:
    name, data = col(field), col(m)
    return F.map_concat(F.map_filter(data, lambda k, _: k != name), F.create_map(name, col(value)))


def backfill(m: ColumnLike, superset: ColumnLike) -> Column:
    """Exactly the superset's keys; a missing key becomes "". A stored null stays null.

    The superset contains every key of the row, so equal sizes mean nothing to do.
    """
    data, keys = col(m), col(superset)
    filled = F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.when(F.map_contains_key(data, k), data[k]).otherwise(F.lit("")))
    )
    return F.when(F.size(data) == F.size(keys), data).otherwise(filled)


def clean_cells(m: ColumnLike) -> Column:
    """Trimmed values without the texts that mean "no value"; each value is cleaned once."""
    trimmed = F.transform_values(col(m), lambda _, v: strip(v))
    return F.map_filter(trimmed, lambda _, v: v.isNotNull() & ~F.lower(v).isin(NULL_TOKENS))


def first_alias(clean: ColumnLike, keys: list[str]) -> Column:
    """First key present in a cleaned map, else ""."""
    return F.coalesce(*[col(clean)[k] for k in keys], F.lit(""))


def alias_cell(m: ColumnLike, keys: list[str]) -> Column:
    return let(clean_cells(m), lambda clean: first_alias(clean, keys))


def report_cells(m: ColumnLike, columns: list[tuple[str, list[str]]] = REPORT_COLUMNS) -> Column:
    """One cell text per report column, as an array in column order."""
    return let(clean_cells(m), lambda clean: F.array(*[first_alias(clean, keys) for _, keys in columns]))


def filled_mask(cells: ColumnLike, n_columns: int) -> Column:
    """Bit i is set when cell i is not empty; ``bit_or`` over a group gives its active columns."""
    bits = [F.when(F.get(col(cells), F.lit(i)) != "", F.lit(1 << i)).otherwise(F.lit(0)) for i in range(n_columns)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("long")


def mask_has(mask: ColumnLike, position: ColumnLike) -> Column:
    return F.getbit(col(mask), col(position)) == 1
