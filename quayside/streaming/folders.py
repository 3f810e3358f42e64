"""Numbered folders that streaming writers keep their tables in."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quayside.session import folders


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders ``prefix``N below a path, ascending."""
    return sorted(int(n.removeprefix(prefix)) for n in folders(spark, path) if n.startswith(prefix) and "_SUCCESS" in folders(spark, f"{path}/{n}"))


def part_of(key: str, parts: int) -> Column:
    """The part, by hash, that a key belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
