"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building pieces."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame

from quayside.llm.common import append_columns, bounded_batches

_CACHE = 200_000


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file (JSON with model.vocab), as bytes; a word starts with a space.

    Such files write each byte as a printable character: printable Latin-1 bytes stand for
    themselves, the others, in order, for the characters from 256 on. Pieces with other
    characters (special tokens) are left out.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [bytes(byte_of[c] for c in piece) for piece in vocabulary if piece and all(c in byte_of for c in piece)]


class Automaton:
    """Trie of the pieces with failure links: reading a byte costs amortised constant time.

    ``step[state << 8 | byte]`` is the trie. Where it has no entry, the longest piece that starts
    the state's text is popped, with any more that follow from it: ``pops[state]`` pieces, and
    reading goes on in ``fail[state]``, the state of what the pieces leave over. A state whose
    text no pieces can start has fail -1.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.step: dict[int, int] = {}
        self.fail, self.pops = [0], [0]
        whole = [False]
        children: list[list[tuple[int, int]]] = [[]]
        for piece in pieces:
            at = 0
            for b in piece:
                key = at << 8 | b
                if key not in self.step:
                    self.step[key] = len(whole)
                    children[at].append((b, len(whole)))
                    whole.append(False)
                    children.append([])
                at = self.step[key]
            whole[at] = at > 0
        self.fail += [-1] * (len(whole) - 1)
        self.pops += [0] * (len(whole) - 1)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, node in children[parent]:
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                at, popped = (self.fail[parent], self.pops[parent]) if parent else (-1, 0)
                while at >= 0 and (at << 8 | b) not in self.step:
                    # The root cannot fail: nothing of the word is left to pop there.
                    at, popped = (self.fail[at], popped + self.pops[at]) if at else (-1, popped)
                if at >= 0:
                    self.fail[node], self.pops[node] = self.step[at << 8 | b], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word, or 1 (unknown) if greedy matching cannot cover it."""
        step, fail, pops = self.step, self.fail, self.pops
        at = total = 0
        for b in word:
            while (key := at << 8 | b) not in step:
                total += pops[at]
                at = fail[at] if at else -1
                if at < 0:
                    return 1
            at = step[key]
        while at:
            total += pops[at]
            at = fail[at]
            if at < 0:
                return 1
        return total


def greedy_count(word: bytes, pieces: set[bytes]) -> int:
    """What the automaton must return, by trying prefixes from the longest down. For tests."""
    at = total = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), 0)
        if not end:
            return 1
        at, total = end, total + 1
    return total


def count_tokens(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """``docs`` with n_words and n_tokens (long) of ``text``; map-only.

    Words are runs of characters other than ASCII white space; each is read with a space before it. A
    piece list without that space or without a word's bytes makes the word one unknown token.
    Null and empty texts have 0. Whole texts are counted, whatever their length; counts of words seen
    before come from a table that is emptied when full. The piece list travels to the tasks
    once, as a broadcast of the vocabulary's size, and each task builds its automaton.
    """
    spark = bounded_batches(docs.sparkSession)
    sent = spark.sparkContext.broadcast(list(pieces))

    def start():
        automaton = Automaton(sent.value)
        known: dict[bytes, int] = {}

        def run(texts: list) -> list[list]:
            words_of, tokens_of = [], []
            for text in texts:
                words = text.encode().split() if text else []
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        if len(known) > _CACHE:
                            known.clear()
                        n = known[w] = automaton.count(b" " + w)
                    total += n
                words_of.append(len(words))
                tokens_of.append(total)
            return [words_of, tokens_of]

        return run

    return append_columns(docs, "text", "n_words long, n_tokens long", start)
