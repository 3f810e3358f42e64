"""What several corpus operators share: word patterns, batches, links to components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quayside.session import bounded_batches as bounded_batches, pin

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(column: str) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def append_columns(docs: DataFrame, column: str, added: str, start: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """``docs`` with columns computed from the values of one column, batch by batch and map-only.

    ``added`` is the new columns' schema as DDL; ``start`` makes, once per task, the function from a
    batch's values to one list per new column. Columns of the input pass through as they
    are; those named like a new one are replaced.
    """
    new = StructType.fromDDL(added)
    kept = [f for f in docs.schema if f.name not in new.names]
    arrow = to_arrow_schema(new)
    names = [f.name for f in kept] + new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            made = compute(batch.column(len(kept)).to_pylist())
            arrays = [pa.array(values, f.type) for values, f in zip(made, arrow)]
            yield pa.RecordBatch.from_arrays(batch.columns[:len(kept)] + arrays, names)

    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").alias("__value"))
    return source.mapInArrow(run, StructType(kept + new.fields))


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every linked node: the smallest node that its links reach.

    ``links`` has two columns of numbers, a and b; direction, repeats and self links do not
    matter; rows with a null end are ignored. Rounds of large-star and small-star steps: a
    node's neighbours are joined to its smallest neighbour, never gathered in one row, so a
    hub costs as many rows as it has links and its join can be split. Each step is a table in
    the shared folder.
    """
    now = pin(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _signature(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = pin(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = pin(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = pin(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = pin(moved.union(low.select("a", F.col("m").alias("b"))).distinct())
        before, seen = seen, _signature(now)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
