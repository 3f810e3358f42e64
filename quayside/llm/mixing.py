"""Mixing sources to target weights: Efraimidis-Spirakis order within sources, cut at token budgets.

Only DataFrame functions. Per-row work is on (source, key, size); texts are read for their
word count and never moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.common import WORD
from quayside.session import pin, prepare

WEIGHTS = (5, 2, 1)
MOST = 3
_STEPS = 1 << 52


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def prose_quality(text: str = "text", size: str = "size") -> Column:
    """A document's quality weight: 1 where words have 3 to 9 characters on average, white space included, else 0.5."""
    return F.when(F.length(text).between(3 * F.col(size), 9 * F.col(size)), 1.0).otherwise(0.5)


def exponential_key(doc_id: str, quality: Column, seed: str = "mix") -> Column:
    """-ln(u) / quality with u uniform by doc_id: the smaller, the earlier a document is taken.

    Reruns agree. A null quality counts as 1; one of zero or less sorts last.
    """
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(_STEPS))
    quality = F.coalesce(quality, F.lit(1.0))
    return F.when(quality > 0, -F.ln(u) / quality).otherwise(F.lit(float("inf")))


def running_total(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and including each row, in ``order`` within ``group``.

    Rows are range-sorted into slices, which bound every window even if one group holds most
    rows; the sums of earlier slices of a group are added from one row per group and slice.
    ``group`` and ``order`` together should be unique, and free of nulls.
    """
    placed = pin(rows.repartitionByRange(*group, *order).withColumn("__slice", F.spark_partition_id()))
    keys = [*group, "__slice"]
    earlier = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    sums = pin(placed.groupBy(*keys).agg(F.sum(value).alias("__sum")).select(
        *keys, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before")))
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return placed.join(sums, keys).withColumn(out, F.col("__before") + F.sum(value).over(within)).drop("__slice", "__before")


def measured(docs: DataFrame, quality: Column | None = None, keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """``keep`` of ``docs`` with size (words) and __key (place in the source's order). One pass over the texts."""
    sized = docs.withColumn("size", word_count())
    key = exponential_key("doc_id", prose_quality() if quality is None else quality)
    return sized.select(*[F.col(f"`{c}`") for c in keep if c != "size"], "size", key.alias("__key"))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(rank, source, source_size, target), pinned: words wanted of every source.

    Sources by code point, null last, weigh ``weights``, repeating, and share the total of all
    sizes. A target stops at ``most`` times its source's size; the excess is shared again by
    weight until none is above. Each round is one aggregate over a row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", F.col("source").isNull().cast("int").alias("last"), F.coalesce("source", F.lit("")).alias("name"), F.lit(1).alias("one"))
    ranked = running_total(sources.withColumn("all", F.lit(0)), ["all"], ["last", "name"], "one", "rank")
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = pin(ranked.select(F.col("rank").cast("int").alias("rank"), "source", "source_size", weigh.alias("weight")))
    limit, level = F.col("source_size") * most, 0.0
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    while total:
        above = F.col("weight") * F.lit(level) > limit
        used, left = ranked.agg(F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if not left or (total - used) / left == level:
            break
        level = (total - used) / left
    wanted = F.least(F.col("weight") * F.lit(level), limit.cast("double"))
    return pin(ranked.select("rank", "source", "source_size", wanted.alias("target")))


def mix_plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source what to take: (source, source_size, target, epochs, cut_key, cut_size, cut_part), pinned.

    The budget is the target rounded to words. Complete epochs come first: every document
    ``epochs`` times. The rest, less than one epoch, goes to the documents in key order until the
    budget is used: those before the cut whole, the one at the cut by ``cut_part`` words.
    Repeated rows share a key; at the cut they share its part.
    """
    targets = source_targets(sized, weights, most)
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    shares = targets.withColumn("epochs", F.coalesce(F.floor(budget / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long"))
    shares = pin(shares.withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    rows = sized.where("size > 0").join(shares.select("rank", F.col("source").alias("__source")), F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.groupBy("rank", F.col("__key").alias("key"), "size").agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
    summed = running_total(rows, ["rank"], ["key", "size"], "words", "sum")
    cut = summed.join(shares.select("rank", "rest"), "rank").where("sum - words <= rest and rest < sum").select(
        "rank", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.expr("(rest - sum + words) div copies").alias("cut_part"))
    return pin(shares.join(cut, "rank", "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_size", "cut_part"))


RESULTS = ("size", "source_size", "target", "taken")


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, __key, ...) with source_size, target and taken (words, repeats counted), without __key."""
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    order, cut = F.struct(F.col("__key").alias("key"), "size"), F.struct(F.col("__cut_key").alias("key"), F.col("__cut_size").alias("size"))
    part = F.when(F.col("__cut_key").isNull(), 0).when(order < cut, F.col("size")).when(order == cut, F.least("__cut_part", "size")).otherwise(0)
    taken = F.col("__epochs") * F.col("size") + F.when(F.col("size") > 0, part).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("__source"))).select(
        *[F.col(f"`{c}`") for c in rows.columns if c != "__key"], F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, quality: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    ``quality`` is an expression over the columns of ``docs`` and ``size``, prose_quality by default. Null
    texts have size 0 and are never taken; null sources are a source of their own; null
    doc_ids share one place in the order. Empty tables give empty results; extra columns are
    ignored.
    """
    prepare(docs.sparkSession)
    sized = pin(measured(docs, quality))
    return take(sized, mix_plan(sized, weights, most))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, quality: Column | None = None) -> DataFrame:
    """The documents of which words are taken, all their columns, with size, source_size, target and taken (replaced if there).

    Texts are read twice, once to plan and once to emit, and never shuffled.
    """
    prepare(docs.sparkSession)
    plan = mix_plan(pin(measured(docs, quality)), weights, most)
    return take(measured(docs, quality, [c for c in docs.columns if c not in RESULTS]), plan).where("taken > 0")
