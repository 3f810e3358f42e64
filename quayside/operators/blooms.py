"""Bloom filters as rows of bitmaps: built with map-side merging, tested in a join on the bitmap's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spark's bitmap functions hold so many bits in a value of 4 KB.
BUCKET_BITS = 32_768
BITS_PER_KEY = 16
# A filter of this many bitmaps is 8 MB, however many keys it was made of; beyond 4 million keys it lets more pass.
MOST_BUCKETS = 2_048


def bucket(key: str, buckets: int | Column) -> Column:
    """Number of the bitmap that a key belongs to."""
    return F.pmod(F.xxhash64(F.lit("bucket"), F.col(key)), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def places(key: str) -> list[Column]:
    """The two bits of a key in its bitmap."""
    return [F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BUCKET_BITS)) for seed in ("first", "second")]


def bitmaps(keys: DataFrame, key: str, buckets: int, by: list[str] | None = None) -> DataFrame:
    """(by, bucket, bits) of the keys; tasks merge their bitmaps, keys do not move."""
    set_bits = keys.select(*(by or []), bucket(key, buckets).alias("bucket"), F.explode(F.array(*places(key))).alias("place"))
    return set_bits.groupBy(*(by or []), "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def is_set(bits: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def may_hold(key: str, bits: str = "bits") -> Column:
    """Whether a key may be among those of its bitmap; one that is always is."""
    first, second = places(key)
    return is_set(bits, first) & is_set(bits, second)


def with_maybe(df: DataFrame, keys: DataFrame, key: str, name: str, hold, buckets: int = MOST_BUCKETS) -> DataFrame:
    """``df`` with a column that is false where its key is certainly not among ``keys``.

    The filter is broadcast, its size is bounded by ``buckets`` times 4 KB; the rows stay where they are.
    """
    made = hold(bitmaps(keys, key, buckets)).select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    met = df.withColumn("_bucket", bucket(key, buckets)).join(F.broadcast(made), "_bucket", "left")
    return met.withColumn(name, F.coalesce(may_hold(key, "_bits"), F.lit(False))).drop("_bucket", "_bits")
