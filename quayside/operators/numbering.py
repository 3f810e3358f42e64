"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quayside.session import pin


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal, and so are NaNs."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(now, before), False)
    if pa.types.is_floating(column.type):
        both = pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(before), False))
        differs = pc.and_not(differs, both)
    return pc.or_(differs, pc.xor(now.is_null(), before.is_null())).to_numpy(zero_copy_only=False)


def place_in_run(df: DataFrame, by: list[str], name: str, edge: str) -> DataFrame:
    """``df`` with each row's 1-based place in its run of equal ``by`` within its partition; partitions are left as they are.

    ``edge`` is true for a partition's first and last row. Map-only and batch by batch: what is
    carried from one batch to the next is its last key and place.
    """
    at = [df.columns.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, held = None, 0, None
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                yield finished(*held)
            starts = np.zeros(len(batch), bool)
            starts[0] = last is None
            for i in at:
                column = batch.column(i)
                starts[1:] |= _changes(column)
                if last is not None:
                    starts[0] |= _changes(pa.concat_arrays([last.column(i), column.slice(0, 1)]))[0]
            index = np.arange(len(batch))
            begun = np.maximum.accumulate(np.where(starts, index, -1))
            places = np.where(begun >= 0, index - begun + 1, place + index + 1)
            edges = np.zeros(len(batch), bool)
            edges[0] = last is None
            last, place = batch.slice(len(batch) - 1), int(places[-1])
            held = batch, places, edges
        if held is not None:
            held[2][-1] = True
            yield finished(*held)

    def finished(batch: pa.RecordBatch, places: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(edges)], [*batch.schema.names, name, edge])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType()), StructField(edge, BooleanType())]))


def number_rows(
    df: DataFrame, by: list[str], order: list[Column], name: str = "row_index",
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Exact 1-based row number within each group, whatever the group sizes.

    Rows are range-partitioned by group and order, so a group holding a third of the table
    covers a third of the partitions. Where they are sorted, each row gets its place in its
    partition's run of the group. Only the run a partition begins with can continue an earlier
    one: what it has to add is one number a partition, carried over from the partitions before.
    So the rows cross the network once, for the sort, and meet no table that grows with the groups.
    The sorted rows are pinned, because both passes must see the same placement.
    ``order`` should end in a unique column. ``then`` adds row-wise columns after the sort:
    sorting samples its input first, so costly columns made before it are computed twice.
    """
    ordered = df.orderBy(*by, *order)
    placed = (then(ordered) if then else ordered).withColumn("_run_at", F.monotonically_increasing_id())
    placed = pin(place_in_run(placed, by, "_run_place", "_run_edge")).withColumn("_run_slice", F.shiftright("_run_at", 33))
    index = F.col("_run_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    carried = F.broadcast(_carry(placed, by))
    own = F.when(F.col("_run_place") == index, F.coalesce("_run_carried", F.lit(0))).otherwise(F.lit(0))
    return placed.join(carried.withColumnRenamed("_run_of", "_run_slice"), "_run_slice", "left").select(
        *[c for c in placed.columns if c not in ("_run_at", "_run_slice", "_run_place", "_run_edge")], (F.col("_run_place") + own).alias(name)
    )


def _carry(placed: DataFrame, by: list[str]) -> DataFrame:
    """(_of, _carried): rows of a slice's first group in the slices before it; at most a row per slice.

    A slice's summary is its first and last key and the length of its last run. Slices that one run
    fills pass on what they were given, so the carry is a sum over the unbroken stretch of them.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0))
    ends = placed.where("_run_edge").groupBy("_run_slice").agg(
        F.min_by(key, "_run_at").alias("_head"), F.max_by(F.struct(key.alias("key"), "_run_place"), "_run_at").alias("_tail"),
        F.max(F.col("_run_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_rows"),
    )
    # One row a slice from here on: a window over all of them is as small as the number of partitions.
    every = W.orderBy("_run_slice")
    joins = F.coalesce(F.lag(F.col("_tail")["key"]).over(every) == F.col("_head"), F.lit(False))
    filled = F.col("_tail")["_run_place"] == F.col("_rows")
    # A slice passes on more than its own last run only if that run fills it and continues the one before.
    linked = ends.select("_run_slice", F.col("_tail")["_run_place"].alias("_last"), joins.alias("_joins"), filled.alias("_filled"))
    fresh = F.when(~(F.col("_joins") & F.col("_filled")), 1).otherwise(0)
    stretch = linked.withColumn("_stretch", F.sum(fresh).over(every.rowsBetween(W.unboundedPreceding, 0)))
    upto = W.partitionBy("_stretch").orderBy("_run_slice").rowsBetween(W.unboundedPreceding, 0)
    passed = stretch.withColumn("_passed", F.sum("_last").over(upto))
    return passed.select(F.col("_run_slice").alias("_run_of"), F.when(F.col("_joins"), F.lag("_passed").over(every)).alias("_run_carried"))
