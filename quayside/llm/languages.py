"""Language identification: scripts narrow the candidates of a word, Viterbi with a switching penalty labels spans."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches
from quayside.session import pin

BITS = 17
ORDERS = (1, 2, 3, 4)
# A run of letters; a longer one is taken in pieces, which bounds what a word costs and what the cache holds.
_WORD = re.compile(r"[^\W\d_]{1,24}")
_CACHE = 200_000
# What one word may say at most against a language, and against one that does not use its script.
WORST, OTHER_SCRIPT = 6.0, 12.0
PENALTY = 14.0
MOST_LANGUAGES = 200
UNKNOWN = "und"

# Unicode ranges of scripts (first code point, last, script). Letters outside them are one more script.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x3FFFF, "Han"),
]
NAMES = sorted({name for *_, name in SCRIPTS})
_FIRST = np.array([a for a, *_ in SCRIPTS])
_LAST = np.array([b for _, b, _ in SCRIPTS])
_BIT = np.array([1 << NAMES.index(name) for *_, name in SCRIPTS] + [1 << len(NAMES)], np.int64)


def script_bits(codes: np.ndarray) -> np.ndarray:
    """The script of every code point, as one bit."""
    at = np.searchsorted(_FIRST, codes, "right") - 1
    inside = (at >= 0) & (codes <= _LAST[at])
    return _BIT[np.where(inside, at, len(SCRIPTS))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every letter sequence of ORDERS lengths, with marks at both ends, and of whole words; per word scripts and letters."""
    marked = [f"\x02{w.lower()}\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(codes)) - starts[owner]).astype(np.uint64)
    inner = codes > 3
    buckets, owners = [], []
    for n in ORDERS:
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + len(h)])
        kept = (owner[:len(h)] == owner[n - 1:]) & (inner[:len(h)] if n == 1 else True)
        buckets.append(h[kept])
        owners.append(owner[:len(h)][kept])
    if words:
        buckets.append(_mixed(np.add.reduceat(_mixed(codes + (place << np.uint64(32))), starts)))
        owners.append(np.arange(len(words)))
    alone = np.array([w.isalpha() or any(c.isalpha() for c in w) for w in words], bool)
    scripts = np.bitwise_or.reduceat(np.where(inner, script_bits(codes.astype(np.int64)), 0), starts) if words else np.zeros(0, np.int64)
    letters = np.where(alone, [len(w) for w in words], 0) if words else np.zeros(0, np.int64)
    return (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners), scripts, letters


def training_rows(docs: DataFrame, per_language: int = 3000) -> DataFrame:
    """(lang, text) of a sample of ``docs`` (doc_id, lang, text), of about ``per_language`` rows a language at most, pinned.

    A row is drawn by the hash of its doc_id and text against its language's number of rows, so all rows have
    the same chance and no language is sorted. More than MOST_LANGUAGES languages are refused, as the model grows with them. Rows with a null or empty lang, or without text, teach nothing.
    """
    known = docs.where("lang is not null and lang <> '' and text is not null").select("doc_id", "lang", "text")
    sizes = pin(known.groupBy("lang").agg(F.count("*").alias("__n")))
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(per_language) / F.col("__n")
    return pin(known.join(F.broadcast(sizes), "lang").where(drawn).select("lang", "text"))


def train(docs: DataFrame, per_language: int = 3000, words: int = 1500, least_share: float = 0.02, smoothing: float = 0.5) -> dict:
    """The model of the languages of ``docs``: log probabilities of letter sequences, and the scripts in use.

    Fitted to the bounded sample of ``training_rows``; of a text with more than ``words`` words evenly spaced ones
    are read. Counts are made in the tasks and summed by Spark; the model has 2^BITS numbers a language. A
    script counts as used from ``least_share`` of a language's letters. Without any labelled text there is no language.
    """
    rows = training_rows(docs, per_language)
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, own = _WORD.findall(text), held.setdefault(lang, {})
                for w in found[::max(1, math.ceil(len(found) / words))]:
                    own[w] = own.get(w, 0) + 1
        for lang, own in held.items():
            names, numbers = list(own), np.array(list(own.values()), float)
            total, letters = np.zeros(1 << BITS), np.zeros(len(_BIT) + 1)
            for at in range(0, len(names), 1 << 14):
                buckets, owner, scripts, length = features(names[at:at + (1 << 14)])
                n = numbers[at:at + (1 << 14)]
                total += np.bincount(buckets, n[owner], 1 << BITS)
                for k in range(len(NAMES) + 1):
                    letters[k] += (n * length)[scripts >> k & 1 == 1].sum()
            both = np.r_[total, letters]
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(both[at], pa.float64())], ["lang", "at", "n"])

    counts = rows.mapInArrow(count, "lang string, at long, n double").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    table = np.zeros((len(names), (1 << BITS) + len(_BIT) + 1))
    code = {name: i for i, name in enumerate(names)}
    table[[code[x] for x in counts["lang"].to_pylist()], counts["at"].to_numpy()] = counts["n"].to_numpy()
    grams, letters = table[:, :1 << BITS], table[:, 1 << BITS:]
    seen = max(1, (grams.sum(axis=0) > 0).sum())
    logs = np.log((grams + smoothing) / (grams.sum(axis=1, keepdims=True) + smoothing * seen))
    shares = letters / np.maximum(1, letters.sum(axis=1, keepdims=True))
    used = [sum(1 << k for k in range(len(NAMES) + 1) if row[k] >= least_share) for row in shares]
    order = np.argsort(-letters.sum(axis=1), kind="stable")
    return {"names": names, "logs": np.ascontiguousarray(logs.T.astype(np.float32)), "scripts": np.array(used, np.int64), "usual": int(order[0]) if names else -1}


def word_scores(words: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(scores, letters): per word and language 0 for the best candidate, less for others; 0 for all where nothing is known."""
    buckets, owner, scripts, letters = features(words)
    parts = model["logs"][buckets]
    scores = np.stack([np.bincount(owner, parts[:, k], len(words)) for k in range(parts.shape[1])], axis=1) / len(ORDERS)
    candidate = (scripts[:, None] & ~model["scripts"]) == 0
    some = candidate.any(axis=1) & (letters > 0)
    best = np.where(some, np.where(candidate, scores, -np.inf).max(axis=1), 0.0)
    scores = np.where(candidate, np.maximum(scores - best[:, None], -WORST), -OTHER_SCRIPT)
    scores[~some] = 0
    return scores, letters


def best_path(scores: np.ndarray, penalty: float = PENALTY, usual: int = 0) -> list[tuple[int, int, int]]:
    """(language, first word, end) of the spans of the best labelling: word scores less ``penalty`` a change; ties stay.

    Where no run of words speaks for another language by more than half the penalty, the labelling is one span, as every
    change costs more than it gains; that is tested on whole columns, and only other texts take the steps one by one.
    """
    totals = scores.sum(axis=0)
    base = int(totals.argmax())
    if totals[usual] == totals[base]:
        base = usual
    gains = np.cumsum(scores - scores[:, base:base + 1], axis=0)
    lowest = np.minimum(np.minimum.accumulate(gains, axis=0), 0.0)
    most = (gains - np.vstack([np.zeros((1, gains.shape[1])), lowest[:-1]])).max(initial=0.0)
    if most <= penalty / 2:
        return [(base, 0, len(scores))]
    number = scores.shape[1]
    value, came = [0.0] * number, np.empty(scores.shape, np.int32)
    stay = list(range(number))
    for lo in range(0, len(scores), 4096):
        chosen = []
        for row in scores[lo:lo + 4096].tolist():
            top = max(value)
            back, low = stay, top - penalty
            if min(value) < low:
                at = value.index(top)
                back = [k if v >= low else at for k, v in enumerate(value)]
                value = [v if v >= low else low for v in value]
            chosen.append(back)
            value = [v - top + s for v, s in zip(value, row)]
        came[lo:lo + len(chosen)] = chosen
    now, end, spans = max(range(number), key=lambda k: (value[k], k == base, -k)), len(scores), []
    for i in range(len(scores) - 1, 0, -1):
        before = int(came[i, now])
        if before != now:
            spans.append((now, i, end))
            now, end = before, i
    spans.append((now, 0, end))
    return spans[::-1]


class Labeller:
    """Labels texts by one model; the scores of words are kept from batch to batch, a bounded number of them."""

    def __init__(self, model: dict, penalty: float):
        self.model, self.penalty = model, penalty
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, len(self.model["names"]))), np.zeros(0, np.int64)

    def _learn(self, words: set[str]) -> None:
        """Scores of all of a batch's words are at hand after this."""
        fresh = words - self.known.keys()
        if len(self.known) + len(fresh) > _CACHE:
            self._forget()
            fresh = words
        order, found = sorted(fresh), [(self.scores, self.letters)]
        for at in range(0, len(order), 1 << 13):
            found.append(word_scores(order[at:at + (1 << 13)], self.model))
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))
        self.scores, self.letters = np.vstack([f for f, _ in found]), np.concatenate([n for _, n in found])

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, score, spans as language, start and end in code points) of every text."""
        words = [_WORD.findall(t) if t else [] for t in texts]
        if self.model["names"]:
            self._learn(set().union(*words))
        for text, own in zip(texts, words):
            yield self._label(text, own) if own and self.model["names"] else (UNKNOWN, 0.0, [])

    def _label(self, text: str, words: list[str]) -> tuple[str, float, list[tuple[str, int, int]]]:
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        scores, letters = self.scores[at], self.letters[at]
        if not letters.any():
            return UNKNOWN, 0.0, []
        spans = best_path(scores, self.penalty, self.model["usual"])
        weight, own = np.zeros(scores.shape[1]), np.zeros((scores.shape[1],) * 2)
        for k, lo, hi in spans:
            weight[k] += letters[lo:hi].sum()
            own[k] += scores[lo:hi].sum(axis=0)
        best = int(weight.argmax())
        sure = 1 / np.exp(np.minimum(own[best] - own[best, best], 50.0)).sum()
        name = self.model["names"][best]
        if len(spans) == 1:  # nothing but letters makes a word: the text's first and last letters
            places = [(name, text.find(words[0]), text.rfind(words[-1]) + len(words[-1]))]
        else:
            places = self._places(text, spans)
        return name, float(weight[best] / weight.sum() * sure), places

    def _places(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
        firsts, lasts = {lo for _, lo, _ in spans}, {hi - 1 for *_, hi in spans}
        starts, ends = [], []
        for i, m in enumerate(_WORD.finditer(text)):
            if i in firsts:
                starts.append(m.start())
            if i in lasts:
                ends.append(m.end())
        return [(self.model["names"][k], a, b) for (k, _, _), a, b in zip(spans, starts, ends)]


def identify(docs: DataFrame, model: dict, penalty: float = PENALTY, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, spans) for every row of ``docs`` (doc_id, text); map-only, whole texts.

    Words are runs of letters. A word's scripts leave as candidates the languages that use all of them; a word in scripts
    that none uses says nothing. ``spans`` are the stretches of the best labelling, in code points of the text;
    ``lang_pred`` is the language with most letters in its spans, ties by name; ``score`` is their share of the letters, times
    how sure those spans are against the other languages. Null texts and texts without a letter are ``und`` with
    score 0 and no span, as is everything where no language was learnt. Texts that say nothing get the language with most
    letters in training. Repeated rows stay; other columns are ignored; an empty table gives an empty one.
    """
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    span = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    names = [id_column, "lang_pred", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        for batch in batches:
            out = list(labeller.label(batch.column(1).to_pylist()))
            spans = [[dict(zip(("lang", "start", "end"), s)) for s in o[2]] for o in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array(spans, pa.list_(span))], names)

    return docs.select(id_column, "text").mapInArrow(
        run, f"`{id_column}` {kind}, lang_pred string, score double, spans array<struct<lang: string, start: bigint, end: bigint>>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
