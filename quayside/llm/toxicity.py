"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import append_columns, bounded_batches
from quayside.session import pin

BUCKETS = 1 << 20
PREFIXES = (5, 7)
_SENTENCE = re.compile(r"[^.!?\n\r]+")
_WORD = re.compile(r"\w+")
_CACHE = 50_000


def features(word: str) -> list[int]:
    """Hash buckets of a lower-case word: itself and, for longer words, its first 5 and 7 characters."""
    found = [word] + [word[:n] + "^" for n in PREFIXES if len(word) > n]
    return [zlib.crc32(f.encode()) % BUCKETS for f in found]


def sample(docs: DataFrame, labels: DataFrame, per_class: int = 4000, characters: int = 10_000_000) -> DataFrame:
    """A bounded training sample (pick, text, toxic, weight), pinned.

    At most ``per_class`` labelled rows of each class, those of smallest hash of doc_id, and of
    these at most ``characters`` of text per class: a text that no longer fits is left out, the next
    are still tried. A text over a tenth of that bound takes part with sentences drawn from all of it
    (``excerpt``), so no text ends its class. ``weight`` restores the class's share in all labels.
    Labels that are neither 0 nor 1, and labels without a document, are left out.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic", F.xxhash64("doc_id").alias("pick"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy("pick", "doc_id").limit(per_class)
        part = part.withColumn("weight", F.lit(max(1.0, sizes.get(c, 0) / per_class)))
        chosen = part if chosen is None else chosen.union(part)
    share = max(1, characters // 10)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [excerpt(t, share) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], ["pick", "text", "toxic", "weight"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select(
        "pick", "text", F.col("toxic").cast("int").alias("toxic"), "weight")
    found = rows.mapInArrow(shorten, "pick long, text string, toxic int, weight double")
    found = pin(found.withColumn("n", F.length("text")).withColumn("hash", F.xxhash64("text")))
    keep = {0: 0, 1: 0}
    left_out = []
    # Bounded: at most two times per_class rows of four numbers, where ids do not repeat.
    for r in sorted(found.select("toxic", "pick", "n", "hash").collect(), key=lambda r: (r.pick, r.n, r.hash)):
        if keep[r.toxic] + r.n > characters:
            left_out.append((r.toxic, r.pick, r.hash))
        else:
            keep[r.toxic] += r.n
    if left_out:
        gone = docs.sparkSession.createDataFrame(left_out, "toxic int, pick long, hash long")
        found = found.join(F.broadcast(gone), ["toxic", "pick", "hash"], "left_anti")
    return found.select("pick", "text", "toxic", "weight", "n")


def excerpt(text: str, share: int) -> str:
    """A text of at most ``share`` characters as it is; of a longer one, sentences of smallest hash that fit.

    A sentence that is longer by itself is first reduced to its distinct words, which is all the model reads of it.
    """
    if len(text) <= share:
        return text
    kept, room = [], share
    for sentence in sorted((m.group() for m in _SENTENCE.finditer(text)), key=lambda s: (zlib.crc32(s.encode()), s)):
        if len(sentence) >= room:
            words = sorted(set(_WORD.findall(sentence.lower())), key=lambda w: (zlib.crc32(w.encode()), w))
            sentence = " ".join(words)
            if len(sentence) >= share and not kept:
                fit = []
                for w in words:
                    if len(w) + 1 < room:
                        fit.append(w)
                        room -= len(w) + 1
                return " ".join(fit)
        if len(sentence) < room:
            kept.append(sentence)
            room -= len(sentence) + 1
    return ".".join(kept)


def _featurised(rows: DataFrame) -> DataFrame:
    """(pick, toxic, weight, lengths, buckets): per sentence how many different buckets, and these, as 32-bit numbers in bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            lengths, buckets = [], []
            for text in batch.column(3).to_pylist():
                n, b = [], []
                for sentence in _SENTENCE.findall(text.lower()):
                    own: set[int] = set()
                    for w in set(_WORD.findall(sentence)):
                        if w not in known:
                            if len(known) > _CACHE:
                                known.clear()
                            known[w] = features(w)
                        own.update(known[w])
                    b += sorted(own)
                    n.append(len(own))
                lengths.append(np.array(n, np.int32).tobytes())
                buckets.append(np.array(b, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                batch.columns[:3] + [pa.array(lengths, pa.binary()), pa.array(buckets, pa.binary())], ["pick", "toxic", "weight", "lengths", "buckets"])

    return rows.select("pick", F.col("toxic").cast("int").alias("toxic"), "weight", "text").mapInArrow(
        run, "pick long, toxic int, weight double, lengths binary, buckets binary")


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(rows: DataFrame, rounds: int = 300, least: int = 3, deviation: float = 3.0, l2: float = 0.3, start: float = -6.0) -> dict:
    """Weights of a sentence model from labelled documents (pick, text, toxic, weight), a bounded sample.

    Texts become numbers in Spark tasks; the fit over these numbers is one small numpy job.
    Buckets count that stand in at least ``least`` toxic documents and in more of them, by
    ``deviation`` standard deviations, than their overall share lets expect. Documents are
    toxic with P = 1 - prod(1 - p_s) over their sentences; Adam climbs the labels' log
    likelihood. A sentence without a chosen bucket has p_s = 0, so length alone makes no text
    toxic, and a word counts once a sentence. Without both classes the model has no weights
    and scores all as clean.
    """
    data = sorted(_featurised(rows).collect(), key=lambda r: (r.pick, r.toxic, bytes(r.buckets)))
    y = np.array([r.toxic for r in data], float)
    if not 0 < y.sum() < len(y):
        return {"bias": -20.0, "weights": {}}
    weight = np.array([r.weight for r in data])
    lengths = [np.frombuffer(r.lengths, np.int32) for r in data]
    buckets = [np.frombuffer(r.buckets, np.int32) for r in data]

    toxic_in, all_in = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for own, w, c in zip(map(np.unique, buckets), weight, y):
        all_in[own] += w
        toxic_in[own] += c * w
    share = (y * weight).sum() / weight.sum()
    expected = all_in * share
    rise = float(weight[y == 1].min())
    chosen = np.flatnonzero((toxic_in >= least * rise) & (toxic_in - expected > deviation * np.sqrt(np.maximum(expected, 1e-9))))
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    # Only chosen buckets are kept, a small part of all, and only the sentences that have any.
    column, sentence, doc_of_sentence, at = [], [], [], 0
    for i, (own, n) in enumerate(zip(buckets, lengths)):
        use = np.flatnonzero(place[own] >= 0)
        marked, number = np.unique(np.searchsorted(np.cumsum(n), use, side="right"), return_inverse=True)
        column.append(place[own[use]])
        sentence.append(at + number)
        doc_of_sentence.append(np.full(len(marked), i))
        at += len(marked)
    column, sentence, doc_of_sentence = np.concatenate(column), np.concatenate(sentence), np.concatenate(doc_of_sentence)
    del data, buckets

    theta = np.zeros(len(chosen) + 1)
    theta[-1] = start
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(sentence, theta[column], len(doc_of_sentence))
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        clean = np.bincount(doc_of_sentence, _softplus(z), len(y))
        whole = np.maximum(-np.expm1(-clean), 1e-12)
        slope = (weight * (y / whole - 1))[doc_of_sentence] * p
        grad = np.append(np.bincount(column, slope[sentence], len(chosen)) - l2 * theta[:-1], slope.sum()) / weight.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta += 0.1 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-10)
    return {"bias": float(theta[-1]), "weights": {int(b): float(w) for b, w in zip(chosen, theta)}}


class _WordBuckets(dict):
    """Word to its buckets that have a weight; forgets all when full."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _CACHE:
            self.clear()
        found = self[word] = tuple(b for b in features(word) if b in self.weights)
        return found


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1), ``toxic`` and ``offending`` sentences; map-only.

    ``offending``: (start, end, score) of the sentences whose own score reaches the threshold,
    in code points, end exclusive. A text that is null, empty or without words has no
    sentence and scores 0. Whole texts are read, sentence by sentence. Columns of the input
    stay; those named like a result are replaced.
    """
    bounded_batches(docs.sparkSession)
    bias, weights = model["bias"], model["weights"]

    def start():
        look = _WordBuckets(weights).__getitem__

        def run(texts: list) -> list[list]:
            scores, spans = [], []
            for text in texts:
                clean, found = 0.0, []
                for m in _SENTENCE.finditer(text or ""):
                    own = {b for w in set(_WORD.findall(m.group().lower())) for b in look(w)}
                    if not own:
                        continue
                    z = bias + sum(weights[b] for b in own)
                    clean += math.log1p(math.exp(z)) if z < 30 else z
                    p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
                    if p >= threshold:
                        found.append({"start": m.start(), "end": m.end(), "score": p})
                scores.append(-math.expm1(-clean))
                spans.append(found)
            return [scores, [s >= threshold for s in scores], spans]

        return run

    return append_columns(docs, "text", "toxicity double, toxic boolean, offending array<struct<start:int, end:int, score:double>>", start)


def train(docs: DataFrame, labels: DataFrame, **bounds: int) -> dict:
    """Fit on a bounded sample of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks."""
    bounded_batches(docs.sparkSession)
    return fit(sample(docs, labels, **bounds))
