"""Identifiers derived from content, so that a recomputed task yields the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.text import ColumnLike, col


def stable_id(*parts: ColumnLike) -> Column:
    tagged = [F.coalesce(F.concat(F.lit("="), col(p).cast("string")), F.lit("!")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *tagged), 256)
