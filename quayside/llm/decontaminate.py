"""Benchmark decontamination: seeds and bounds that no counting alignment escapes, Smith-Waterman scores what they leave."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, DoubleType, LongType, StructField, StructType

from quayside.llm.common import bounded_batches
from quayside.session import pin

SCORE = 0.45
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.6
# Words of a text that are searched at a time.
SEGMENT = 20_000
_LETTERS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})


def words_of(text: str | None) -> list[str]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().translate(_LETTERS).split()


def seeding(length: int, score: float = SCORE) -> tuple[int, int, int]:
    """(gram, least, span) of an item of ``length`` words: what every alignment of ``score`` or more holds.

    Such an alignment has m matches, s mismatches and g gaps with m - s/2 - 0.6 g >= score * length and
    m + s <= length. Its matches form at most s + g + 1 runs, so at least m - s - g - 1 pairs of
    neighbouring words match; that is smallest where m is the length and only gaps cost. It spans at most ``span``
    words of text and has at least ``least`` n-grams of ``gram`` words in common with the item: pairs, or
    single words where an item is so short that no pair need be left.
    """
    gaps = (MATCH - score) * length / -GAP
    pairs = math.ceil(length - gaps - 1 - 1e-9)
    span = length + math.ceil(gaps)
    return (2, pairs, span) if pairs > 0 else (1, max(1, math.ceil(score * length - 1e-9)), span)


def common_words(places: dict[str, int], length: int, words: list[str]) -> int:
    """Length of the longest common subsequence, a bound of the matches; ``places``: word to the bits of its positions in the item."""
    whole = state = (1 << length) - 1
    for word in words:
        here = places.get(word)
        if here is not None:
            both = state & here
            state = (state + both | state - both) & whole
    return length - state.bit_count()


def local_score(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over word numbers: best score and the span of ``b`` it lies in, end exclusive.

    One row of the matrix at a time: a run of gaps along the row is a running maximum. The
    start of each cell's alignment travels with its score.
    """
    n = len(b)
    steps = np.arange(n + 1) * GAP
    above, above_from = np.zeros(n + 1), np.arange(n + 1)
    best, span = 0.0, (0, 0)
    column = np.arange(n + 1)
    for word in a:
        now, came = np.zeros(n + 1), column.copy()
        diagonal = above[:-1] + np.where(b == word, MATCH, MISMATCH)
        take = diagonal > now[1:]
        now[1:][take], came[1:][take] = diagonal[take], above_from[:-1][take]
        gap = above + GAP
        take = gap > now
        now[take], came[take] = gap[take], above_from[take]
        lifted = now - steps
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, column, 0))
        along = peak + steps
        take = along > now + 1e-12
        came[take] = came[source[take]]
        above, above_from = np.maximum(now, along), came
        at = int(np.argmax(above))
        if above[at] > best + 1e-12:
            best, span = float(above[at]), (int(above_from[at]), at)
    return best, *span


def windows(hits: list[int], least: int, span: int, length: int) -> Iterator[tuple[int, int]]:
    """Overlapping pieces of a text of ``length`` words, of at most three spans: every alignment that counts lies in one whole.

    ``hits`` are the places of an item's n-grams, ascending. Where ``least`` of them lie within a span, the text is widened by a span
    on both sides; what overlaps is one stretch, however long, and cut again.
    """
    stretches: list[list[int]] = []
    for first, last in zip(hits, hits[least - 1:]):
        if last - first < span:
            lo, hi = max(0, first - span), min(length, last + span + 1)
            if stretches and lo <= stretches[-1][1]:
                stretches[-1][1] = hi
            else:
                stretches.append([lo, hi])
    for lo, hi in stretches:
        for at in range(lo, max(lo + 1, hi - span), 2 * span):
            yield at, min(at + 3 * span, hi)


class _Aligner:
    """Some test items, ready to be found in texts."""

    def __init__(self, items: list[tuple], score: float):
        self.items, self.score = items, score
        self.lengths = [len(w) for _, w in items]
        self.seeds = [seeding(n, score) for n in self.lengths]
        self.reach = max(span for _, _, span in self.seeds)
        self.numbers = [{w: n for n, w in enumerate(dict.fromkeys(words))} for _, words in items]
        self.codes = [np.array([own[w] for w in words]) for own, (_, words) in zip(self.numbers, items)]
        self.places: list[dict[str, int]] = []
        self.wanted: dict[int, dict] = {}
        for i, (_, words) in enumerate(items):
            self.places.append({})
            for p, word in enumerate(words):
                self.places[i][word] = self.places[i].get(word, 0) | 1 << p
            owners = self.wanted.setdefault(self.seeds[i][0], {})
            for g in dict.fromkeys(zip(words, words[1:]) if self.seeds[i][0] == 2 else words):
                owners.setdefault(g, []).append(i)

    def find(self, words: list[str]) -> dict[int, tuple[float, int, int]]:
        """Best (score, start, end) of every item that the text holds.

        Long texts are read in segments that overlap by what an alignment can reach, so what is
        held at a time does not grow with the text.
        """
        best: dict[int, tuple[float, int, int]] = {}
        overlap = 3 * self.reach
        for start in range(0, max(1, len(words) - overlap), SEGMENT):
            for item, (value, lo, hi) in self._in_segment(words[start:start + SEGMENT + overlap]):
                if item not in best or value > best[item][0] + 1e-12:
                    best[item] = value, start + lo, start + hi
        return best

    def _in_segment(self, words: list[str]) -> Iterator[tuple[int, tuple[float, int, int]]]:
        found: dict[int, list[int]] = {}
        for size, owners in self.wanted.items():
            for at, g in enumerate(zip(words, words[1:]) if size == 2 else words):
                if g in owners:
                    for item in owners[g]:
                        found.setdefault(item, []).append(at)
        for item, hits in found.items():
            _, least, span = self.seeds[item]
            for lo, hi in windows(hits, least, span, len(words)):
                part = words[lo:hi]
                if MATCH * common_words(self.places[item], self.lengths[item], part) < self.score * self.lengths[item] - 1e-9:
                    continue
                own = self.numbers[item]
                value, first, last = local_score(self.codes[item], np.array([own.get(w, -1) for w in part]))
                value = min(1.0, value / (MATCH * self.lengths[item]))
                if value >= self.score:
                    yield item, (value, lo + first, lo + last)


def _aligned(docs: DataFrame, items: list[tuple], item_type: DataType, score: float) -> DataFrame:
    """Rows of ``contaminated`` for some items, map-only: texts and stretches of them stay in their task."""
    bounded_batches(docs.sparkSession)
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("item_id", item_type), StructField("score", DoubleType()),
        StructField("start_word", LongType()), StructField("end_word", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(items, score)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                for item, found in aligner.find(words_of(text)).items():
                    rows.append(dict(zip(arrow.names, (doc_id, items[item][0], *found))))
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, item_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): passages of ``docs`` that hold a test item, whole or edited.

    ``benchmark`` (item_id, text) is the set of test items. It goes to the tasks in rounds of ``item_bytes`` of text, so a
    benchmark of any size is never whole in one place. Every stretch that could reach ``score`` is aligned with its item word by
    word, in the task that read the text, however many texts hold the same; the score is the best local alignment's, over the item's length,
    and counts from ``score`` up. One row per document and item, the best passage. Ids are of any type. Null or empty items
    and texts, and null ids, match nothing; equal items all match; repeated rows give one row; extra columns are ignored.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType
    rounds: list[DataFrame] = []
    held: list[tuple] = []
    size = 0
    listed = benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    for r in listed.toLocalIterator():
        words = words_of(r.text)
        if words:
            if held and size + len(r.text) > item_bytes:
                rounds.append(pin(_aligned(docs, held, item_type, score)))
                held, size = [], 0
            held.append((r.item_id, words))
            size += len(r.text)
    if held:
        rounds.append(_aligned(docs, held, item_type, score))
    if not rounds:
        return spark.createDataFrame([], StructType([docs.schema["doc_id"], benchmark.schema["item_id"]])).selectExpr(
            "doc_id", "item_id", "0.0D AS score", "0L AS start_word", "0L AS end_word")
    scored = rounds[0]
    for more in rounds[1:]:
        scored = scored.unionByName(more)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("back"), "end_word"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.back")).alias("start_word"), F.col("b.end_word").alias("end_word"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without those that hold a test item. Rows without an id stay."""
    leaks = pin(contaminated(docs, benchmark, **settings).select("doc_id").distinct())
    return docs.join(leaks, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
