"""Texts of any number searched for a bounded set of pieces: byte runs looked up in tables over Arrow buffers, map-only.

A text is valid for search as its UTF-8 bytes: a piece is inside it where its bytes are. No row is made per character.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quayside.session import bounded_batches

# Positions looked up at a time, so that their codes stay in the processor's cache.
SLICE = 1 << 17
# Bytes of four characters at most.
RUN_BYTES = 16


class RunFinder:
    """Finds distinct byte runs of 1 to RUN_BYTES bytes at every place of a buffer.

    A run's first bytes are its code. A table over hashed codes leaves out almost all places; what is left is looked up exactly.
    """

    def __init__(self, runs: list[bytes]):
        self.sizes = []
        for size in sorted({len(r) for r in runs}):
            ids = np.array([i for i, r in enumerate(runs) if len(r) == size])
            own = [runs[i] for i in ids]
            word, bits, factor = (np.uint32, 32, 0x9E3779B1) if size <= 4 else (np.uint64, 64, 0x9E3779B97F4A7C15)
            heads = np.array([int.from_bytes(r[:8], "little") for r in own], word)
            tails = np.array([int.from_bytes(r[-8:] if size > 8 else b"", "little") for r in own], np.uint64)
            lows, highs = np.unique(heads), np.unique(tails)
            both = np.searchsorted(lows, heads) * len(highs) + np.searchsorted(highs, tails)
            order = np.argsort(both)
            shift = word(bits - min(22, max(12, (16 * len(own)).bit_length())))
            table = np.zeros(1 << (bits - int(shift)), bool)
            table[(lows * word(factor)) >> shift] = True
            mask = word((1 << 8 * min(size, bits // 8)) - 1)
            self.sizes.append((size, word, mask, word(factor), shift, table, lows, highs, both[order], ids[order]))

    def find(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place, run), slice by slice, of the runs inside texts that lie in ``data`` one after the other, text i from offsets[i] on."""
        for begin in range(0, len(data), SLICE):
            n = min(SLICE, len(data) - begin)
            part = np.zeros(n + RUN_BYTES, np.uint8)
            part[:len(data) - begin] = data[begin:begin + n + RUN_BYTES]
            for size, word, mask, factor, shift, table, lows, highs, both, ids in self.sizes:
                codes = np.ndarray(n, word, part, strides=(1,)) & mask
                at = np.flatnonzero(table.take((codes * factor) >> shift, mode="wrap"))
                at, number = _known(lows, codes[at], at)
                if size > 8:
                    ends = np.ndarray(n, np.uint64, part, offset=size - 8, strides=(1,))[at]
                    high = np.searchsorted(highs, ends).clip(max=len(highs) - 1)
                    same = highs[high] == ends
                    at, number = _known(both, (number * len(highs) + high)[same], at[same])
                else:
                    number = np.searchsorted(both, number * len(highs))
                place = at + begin
                text = np.searchsorted(offsets, place, "right") - 1
                whole = place + size <= offsets[text + 1]
                yield text[whole], place[whole], ids[number[whole]]


def _known(known: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``at``, those whose value is among the sorted ``known`` ones, and which one it is."""
    number = np.searchsorted(known, values).clip(max=len(known) - 1)
    same = known[number] == values
    return at[same], number[same]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts of a binary column begin, and their bytes in one array, not copied."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def _spans(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with its first and last place."""
    if not len(keys):
        return keys, first, last
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begins], np.minimum.reduceat(first[order], begins), np.maximum.reduceat(last[order], begins)


def run_counts(wholes: DataFrame, runs: list[bytes]) -> list[int]:
    """How often each run occurs in the texts ``s`` of ``wholes``. Tasks return a row per run that they met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, n = RunFinder(runs), np.zeros(len(runs), np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, _, found in finder.find(*_texts(batch.column(0))):
                    n += np.bincount(found, minlength=len(runs))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(n[met], pa.int64())], ["run", "n"])

    bounded_batches(wholes.sparkSession)
    texts = wholes.where("s is not null").select(F.col("s").cast("binary").alias("s"))
    found = texts.mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).collect()
    counts = [0] * len(runs)
    for row in found:
        counts[row["run"]] = row["n"]
    return counts


def holding(wholes: DataFrame, pieces: list[tuple[int, bytes, bytes]]) -> DataFrame:
    """(a, number): the wholes (a, s) that hold a piece (number, its bytes, a run inside it); an empty run is in every text.

    A text is searched for a piece only from the first to the last place of the piece's run, so in time linear in the text.
    """
    empty = [number for number, _, seed in pieces if not seed]
    runs = sorted({seed for _, _, seed in pieces if seed})
    places = {seed: i for i, seed in enumerate(runs)}
    of_run: dict[int, list[tuple[int, bytes, int]]] = defaultdict(list)
    for number, piece, seed in pieces:
        if seed:
            of_run[places[seed]].append((number, piece, piece.index(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = RunFinder(runs)
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, data = _texts(batch.column(1))
            met = [_spans(text * len(runs) + i, place, place) for text, place, i in finder.find(offsets, data)]
            texts, found = [t for t in range(batch.num_rows) for _ in empty], empty * batch.num_rows
            if met:
                view, bounds = memoryview(data), offsets.tolist()
                for key, first, last in zip(*(x.tolist() for x in _spans(*map(np.concatenate, zip(*met))))):
                    text, i = divmod(key, len(runs))
                    for number, piece, offset in of_run[i]:
                        if len(piece) > len(runs[i]):
                            begin, end = max(first - offset, bounds[text]), min(last - offset + len(piece), bounds[text + 1])
                            if view[begin:end].tobytes().find(piece) < 0:
                                continue
                        texts.append(text)
                        found.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts, pa.int64())), pa.array(found, pa.int64())], ["a", "number"])

    bounded_batches(wholes.sparkSession)
    texts = wholes.where("s is not null").select("a", F.col("s").cast("binary").alias("s"))
    return texts.mapInArrow(run, StructType([StructField("a", wholes.schema["a"].dataType), StructField("number", LongType())]))
