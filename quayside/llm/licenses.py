"""License scans by diagonal voting: rolling word k-gram hashes meet template positions, and diagonals collect the votes.

Only DataFrame functions. Texts are read once and never moved: what is shuffled are the few
positions whose k-gram is one of a template's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.session import pin, prepare

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3

# Phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Own short notices of well-known licenses.
MORE = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("copyright", "no part of this publication may be reproduced without permission"),
)


def words_of(text: str | Column) -> Column:
    """Words of a text, A-Z lower-cased; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    plain = F.translate(F.coalesce(column, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(plain, _NOT_WORDS), lambda w: w != "")


def _rolling(hashes: Column, sizes: Sequence[int]) -> list[Column]:
    """For each k of ``sizes`` the hashes of all k-grams, one array each.

    Every array has one element per word; the last k - 1 are hashes of fewer words and match
    no k-gram.
    """
    out, now = {}, hashes
    for k in range(1, max(sizes) + 1):
        if k > 1:
            now = F.zip_with(now, F.slice(hashes, k, F.size(hashes)), lambda a, b: F.xxhash64(a, b))
        out[k] = now
    return [out[k] for k in sizes]


def templates(spark: SparkSession, base: Sequence = BASE, more: Sequence = MORE, gram: int = GRAM) -> DataFrame:
    """(template, label, base, words, k, grams, position, hash): every k-gram of every template.

    A template shorter than ``gram`` words is one k-gram of its own length. The library is a
    constant of the caller, so its size does not depend on the documents.
    """
    rows = [(i, label, i < len(base), text) for i, (label, text) in enumerate([*base, *more])]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, text string").withColumn("w", words_of("text"))
    t = t.withColumn("words", F.size("w")).withColumn("k", F.least("words", F.lit(gram)))
    grams = F.col("words") - F.col("k") + 1
    hashes = F.transform("w", lambda w: F.xxhash64(w))
    one = F.lit(None)
    for k, array in zip(range(1, gram + 1), _rolling(hashes, range(1, gram + 1))):
        one = F.when(F.col("k") == k, array).otherwise(one)
    return t.withColumn("grams", grams).select(
        "template", "label", "base", "words", "k", "grams", F.posexplode(F.slice(one, 1, grams)).alias("position", "hash"))


def matches(docs: DataFrame, library: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(doc_id, text_hash, n_words, template, position, at), pinned: where k-grams of templates stand.

    Every rolling k-gram hash of every text is joined to the templates' (a broadcast of the
    library's size). One more row per document, with template -1, keeps documents without a match and
    counts repeated rows.
    """
    mark = -1
    known = library.select("hash", "template", "position", "k").union(
        docs.sparkSession.createDataFrame([(mark, mark, 0, 0)], "hash long, template int, position int, k int"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of("text").alias("w"))
    rows = rows.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    grams = rows.select("doc_id", "text_hash", "n_words", F.posexplode(
        F.concat(F.array(F.lit(mark).cast("long")), *_rolling(F.col("h"), sizes))).alias("place", "hash"))
    found = grams.join(F.broadcast(known), "hash")
    # place 0 is the mark; then come n_words places for every k.
    size_of = F.element_at(F.array(*[F.lit(k) for k in sizes]), ((F.col("place") - 1) / F.greatest("n_words", F.lit(1))).cast("int") + 1)
    right = (F.col("template") == mark) | (F.col("k") == F.when(F.col("place") > 0, size_of))
    at = F.when(F.col("place") > 0, (F.col("place") - 1) % F.greatest("n_words", F.lit(1)))
    return pin(found.where(right).select("doc_id", "text_hash", "n_words", "template", "position", at.cast("int").alias("at")))


def _spans(found: DataFrame, library: DataFrame, gap: int, least: float) -> DataFrame:
    key = ["doc_id", "text_hash", "template"]
    about = F.broadcast(library.select("template", "label", "base", "words", "k", "grams").distinct())
    votes = found.where("template >= 0").select(*key, "position", "at").distinct()
    diagonals = votes.groupBy(*key, (F.col("at") - F.col("position")).alias("diagonal")).agg(
        F.collect_list("position").alias("positions"), F.min("at").alias("first"), F.max("at").alias("last")).join(about, "template")
    by = W.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce((F.col("grams") == 1) | (F.col("diagonal") - F.lag("diagonal").over(by) > gap), F.lit(True))
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by))
    merged = merged.groupBy(*key, "label", "base", "words", "k", "grams", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("covered"), F.min("first").alias("start"), F.max("last").alias("last"))
    spans = merged.withColumn("stop", F.col("last") + F.col("k")).withColumn("coverage", F.col("covered") / F.col("grams"))
    return spans.where((F.col("coverage") >= least) & (F.col("stop") - F.col("start") <= 2 * F.col("words")))


def license_spans(docs: DataFrame, base: Sequence = BASE, more: Sequence = MORE, gap: int = 2, least: float = 0.6) -> DataFrame:
    """(doc_id, text_hash, label, base, start, stop, coverage): spans of words that hold a template.

    The votes of a template's k-grams are counted by diagonal (place in the text less place in
    the template); diagonals at most ``gap`` apart, as insertions and deletions make them,
    merge; a span counts if at least ``least`` of the template's k-grams stand in it and it is
    not twice as long. A k-gram is a match if its 64-bit hash is. Repeated rows give one set of spans.
    """
    prepare(docs.sparkSession)
    library = templates(docs.sparkSession, base, more)
    return _spans(matches(docs, library, _sizes(base, more)), library, gap, least).select(
        "doc_id", "text_hash", "label", "base", "start", "stop", "coverage")


def _sizes(base: Sequence, more: Sequence) -> list[int]:
    return sorted({min(GRAM, len(text.split())) for _, text in [*base, *more]})


def license_summary(docs: DataFrame, base: Sequence = BASE, more: Sequence = MORE, gap: int = 2, least: float = 0.6) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, places of base phrases, labels and score.

    n_base counts the places of base templates, first_word and last_word are their smallest and
    largest start; labels are those of all spans found; score is the best coverage, 0 without any.
    Null and empty texts have no words. Repeated rows and null ids keep their rows; extra columns are ignored.
    """
    prepare(docs.sparkSession)
    library = templates(docs.sparkSession, base, more)
    found = matches(docs, library, _sizes(base, more))
    rows = found.where("template = -1").groupBy("doc_id", "text_hash", "n_words").agg(F.count("*").cast("int").alias("copies"))
    spans = _spans(found, library, gap, least).withColumn("base_start", F.when(F.col("base"), F.col("start")))

    def listed(label: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(label)), ",")

    told = spans.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(
        F.count("base_start").alias("n_base"), F.min("base_start").cast("long").alias("first_word"), F.max("base_start").cast("long").alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"), F.max("coverage").alias("score"))
    joined = rows.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return joined.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")
