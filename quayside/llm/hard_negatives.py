"""Hard negatives by exact integer scores: residue matrices multiplied in float32, put together by Chinese remainders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quayside.llm.common import bounded_batches
from quayside.operators.numbering import number_rows
from quayside.session import pin, shared_path

# Symmetric residues of primes below 256 are at most 125, so 1 024 products stay below 2^24, exact in float32.
PRIMES = [p for p in range(255, 2, -2) if all(p % d for d in range(3, p, 2))]
DEPTH = 1024
# Rows scored at a time against so many anchors: a matrix of 2^20 scores.
ROWS, ANCHORS = 4096, 256
NONE = np.iinfo(np.int64).min
# In place of a missing id, so that it loses every tie.
NO_ID = np.iinfo(np.int64).max


def moduli(bound: float) -> list[int]:
    """So many primes that residues tell all scores of absolute value up to ``bound`` apart."""
    if bound >= 2.0 ** 63:
        raise ValueError("scores of these vectors do not fit a 64-bit integer")
    chosen, product = [], 1
    while product <= 2 * (int(bound) + 1):
        chosen.append(PRIMES[len(chosen)])
        product *= chosen[-1]
    return chosen


def _symmetric(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2."""
    return (x + p // 2) % p - p // 2


def residues(whole: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """One float32 matrix a prime, of a float64 matrix of whole numbers."""
    return [_symmetric(whole, p).astype(np.float32) for p in primes]


def exact_products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """All inner products of the rows of two matrices given as residues, as int64.

    Each prime's product is summed in float32 over at most DEPTH components, which is exact. The balanced digits of
    the mixed radix give the signed value without a comparison, and need no number above 64 bits.
    """
    digits: list[np.ndarray] = []
    for p, a, b in zip(primes, left, right):
        rest = np.zeros((len(a), len(b)), np.int32)
        for at in range(0, a.shape[1], DEPTH):
            rest += _symmetric((a[:, at:at + DEPTH] @ b[:, at:at + DEPTH].T).astype(np.int32), p)
        for q, digit in zip(primes, digits):
            rest = _symmetric((rest - digit) * np.int32(pow(q, -1, p)), p)
        digits.append(_symmetric(rest, p))
    total = np.zeros_like(digits[0], np.int64)
    for p, digit in zip(reversed(primes), reversed(digits)):
        total = total * p + digit
    return total


def _sound(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of whole components) of a batch's usable rows, one pair a vector length."""
    lists = batch.column(2)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = np.floor(scale * pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
    stops = np.cumsum(lengths)
    wrong = np.r_[0, np.cumsum(~np.isfinite(values))]
    usable = (wrong[stops] == wrong[stops - lengths]) & lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[usable]):
        at = np.flatnonzero(usable & (lengths == size))
        yield at, values[(stops[at] - size)[:, None] + np.arange(size)]


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class _Best:
    """The first ``keep`` (score, id) of each of some lists, scores falling, ids rising."""

    def __init__(self, lists: int, keep: int):
        self.score, self.id = np.full((lists, keep), NONE), np.full((lists, keep), NO_ID)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take from ``scores``, a row for each list of ``at``, NONE where a candidate does not count; ``ids`` rise."""
        keep, rows = self.score.shape[1], np.arange(len(at))
        for _ in range(min(keep, scores.shape[1])):
            best = scores.argmax(axis=1)
            top = scores[rows, best]
            better = top > self.score[at, -1]
            better |= (top == self.score[at, -1]) & (ids[best] < self.id[at, -1]) & (top > NONE)
            if not better.any():
                return
            lists = at[better]
            both = np.c_[self.score[lists], top[better]], np.c_[self.id[lists], ids[best[better]]]
            order = np.lexsort((both[1], ~both[0]))[:, :keep]
            self.score[lists], self.id[lists] = (np.take_along_axis(x, order, 1) for x in both)
            scores[rows, best] = NONE

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, place = np.nonzero(self.score > NONE)
        return lists, self.score[lists, place], self.id[lists, place]


def _search(rows: DataFrame, anchors: dict, primes: list[int], scale: int, keep: int, windows: np.ndarray | None) -> DataFrame:
    """(list, score, id): the best rows of every list, one set a task.

    Without ``windows`` a list is an anchor and takes rows of its label with another id. With them (first and last
    score by anchor and positive) a list is an anchor's positive and takes rows of other labels within its window.
    """
    size, labels, number = anchors["size"], anchors["labels"], len(anchors["id"])
    ways = 1 if windows is None else windows.shape[1]
    kinds = pa.array(sorted(set(labels)))
    codes = pc.index_in(pa.array(labels, kinds.type), kinds).to_numpy()
    split = residues(anchors["whole"], primes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(number * ways, keep)
        for batch in _batches(batches):
            for at, whole in _sound(batch, scale):
                if whole.shape[1] != size:
                    continue
                ids = _ids(batch.column(0))[at]
                kind = pc.fill_null(pc.index_in(batch.column(1).take(pa.array(at)).cast(kinds.type), kinds), -1).to_numpy()
                order = np.lexsort((kind, ids))
                ids, kind, parts = ids[order], kind[order], residues(whole[order], primes)
                if windows is None:
                    for label in np.intersect1d(kind, codes):
                        mine, theirs = np.flatnonzero(codes == label), kind == label
                        for lo in range(0, len(mine), ANCHORS):
                            some = mine[lo:lo + ANCHORS]
                            scores = exact_products([s[some] for s in split], [q[theirs] for q in parts], primes)
                            scores[anchors["id"][some][:, None] == ids[theirs]] = NONE
                            best.add(some, scores, ids[theirs])
                    continue
                for lo in range(0, number, ANCHORS):
                    some = np.arange(lo, min(lo + ANCHORS, number))
                    scores = exact_products([s[some] for s in split], parts, primes)
                    scores[codes[some][:, None] == kind] = NONE
                    for way in range(ways):
                        first, last = windows[some, way, 0][:, None], windows[some, way, 1][:, None]
                        best.add(some * ways + way, np.where((scores >= first) & (scores <= last), scores, NONE), ids)
        found = best.rows()
        for lo in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + (1 << 16)], pa.int64()) for x in found], ["list", "score", "id"])

    return rows.mapInArrow(run, "list long, score long, id long")


def _first(found: DataFrame, keep: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("list").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= keep)


def mine(
    rows: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256, anchor_bytes: int = 4 << 20,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, embedding, label).

    ``anchor`` says which rows are anchors, ``label`` may replace the label. Components become floor(``scale`` * x); a score
    is the exact inner product with the anchor. Higher scores come first, ties by smaller vec_id, rows
    without an id last. An anchor's positives are its first ``positives`` rows of the same label and another vec_id; for each, the
    first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's are returned.

    Rows with a null label, a null vector, or a null or non-finite component take no part; vectors meet only those of their
    length; an empty vector scores 0. Repeated rows are rows: a repeated anchor has its own lists, which repeat. Extra columns are ignored,
    an empty table gives an empty one. Vectors whose scores may pass 64 bits raise an error.

    Anchors are worked off in rounds of at most ``anchor_bytes``, each a broadcast of that size; the rows never move. A task keeps
    only the best of its rows for every list, and windows choose among the tasks' lists.
    """
    spark = bounded_batches(rows.sparkSession)
    named = rows.withColumn("__anchor", F.coalesce(anchor, F.lit(False))).withColumn("__label", label if label is not None else F.col("label"))
    plain = named.select("vec_id", F.col("__label").alias("label"), "embedding", "__anchor")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            chosen = np.zeros(len(batch), bool)
            for at, whole in _sound(batch, scale):
                with np.errstate(over="ignore"):
                    most = max(most, float((whole * whole).sum(axis=1).max(initial=0.0)))
                chosen[at] = True
            chosen &= batch.column(3).to_numpy(zero_copy_only=False)
            kept = batch.filter(pa.array(chosen))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.nulls(len(kept), pa.float64())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in types] + [pa.array([most])], names)

    names = ["vec_id", "label", "embedding", "bound"]
    fields = plain.schema
    types = [to_arrow_type(fields[n].dataType) for n in names[:3]]
    kind = ", ".join(f"{n} {fields[n].dataType.simpleString()}" for n in names[:3])
    measured = pin(plain.mapInArrow(measure, f"{kind}, bound double"))
    bound = measured.agg(F.max("bound")).first()[0] or 0.0
    primes = moduli(bound * (1 + 1e-9))
    asked = measured.where("bound is null").select("vec_id", "label", "embedding", F.size("embedding").alias("size"))
    asked = number_rows(asked, ["size"], [F.col("vec_id"), F.xxhash64("label", "embedding")], name="number")
    sizes = {r["size"]: r["n"] for r in asked.groupBy("size").agg(F.max("number").alias("n")).collect()}

    vectors = plain.select("vec_id", "label", "embedding")
    out = shared_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for size, number in sorted(sizes.items()):
        step = max(1, anchor_bytes // (8 * max(1, size)))
        for start in range(0, number, step):
            part = asked.where((F.col("size") == size) & (F.col("number") > start) & (F.col("number") <= start + step))
            got = part.select("vec_id", "label", "embedding").toArrow().combine_chunks().to_batches()[0]
            ((_, whole),) = _sound(got, scale)
            anchors = {"size": size, "whole": whole, "id": _ids(got.column(0)), "labels": got.column(1).to_pylist()}
            near = pin(_first(_search(vectors, anchors, primes, scale, positives, None), positives))
            windows = np.zeros((len(whole), positives, 2), np.int64)
            windows[:, :, 0] = 1
            for r in near.select("list", "rank", "score").toLocalIterator():
                windows[r["list"], r["rank"] - 1] = -(-low * r["score"] // 100), high * r["score"] // 100
            far = _first(_search(vectors, anchors, primes, scale, negatives, windows), negatives)
            held = near.select(
                (F.col("list") * positives + F.col("rank") - 1).alias("list"), F.col("list").alias("number"),
                F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            names_of = spark.createDataFrame(list(enumerate(anchors["id"].tolist())), "number long, anchor_id long")
            rows_of = far.select("list", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            told = held.join(rows_of, "list").join(names_of, "number")
            ids = [F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("anchor_id", "positive_id")]
            told.select(*ids, "rank", F.nullif(F.col("negative_id"), F.lit(NO_ID)).alias("negative_id"), "positive_score", "negative_score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
