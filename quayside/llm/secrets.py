"""Secret scans: a trigram inverted index narrows each rule to candidate texts, which are then verified."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import append_columns, bounded_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the smallest length of ``group``; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same as runs of which only those of 24 and more count
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

# --- Boolean trigram queries -------------------------------------------------------------------
# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries). Case is
# folded in index and query alike, so a query never misses a match; verification decides.
_EXACT = 24


def _all(parts) -> object:
    parts = frozenset(p for p in parts if p is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(parts) -> object:
    parts = frozenset(parts)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _trigrams(strings: set[str]) -> object:
    """What a text that holds one of the strings must hold."""
    return _any(_all(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(item) -> set[str] | None:
    """The finite set of strings an item can be, or None."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL and value < 128:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] < 128 and value[1] - value[0] < _EXACT:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= _EXACT // 4 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is sre.BRANCH:
        found = [_sequence(b)[0] for b in arg[1]]
        return None if None in found else set().union(*found)
    if op is sre.MAX_REPEAT and arg[1] <= 2 and (one := _sequence(arg[2])[0]) is not None:
        out, power = set(), {""}
        for n in range(arg[1] + 1):
            out |= power if n >= arg[0] else set()
            power = {p + q for p in power for q in one}
        return out
    return None


def _sequence(items) -> tuple[set[str] | None, object]:
    """(all strings the sequence can be or None, what its match demands)."""
    demands, run, exact = [], {""}, True
    for item in items:
        found = _strings(item)
        if found is not None and len(found) * len(run) <= _EXACT:
            run = {r + f for r in run for f in found}
            continue
        demands.append(_trigrams(run))
        run, exact = {""}, False
        op, arg = item
        if found is not None:
            demands.append(_trigrams(found))
            if len(found) <= _EXACT:
                run = found
        elif op is sre.SUBPATTERN:
            demands.append(_sequence(arg[3])[1])
        elif op is sre.BRANCH:
            demands.append(_any(_sequence(b)[1] for b in arg[1]))
        elif op is sre.MAX_REPEAT and arg[0] > 0:
            demands.append(_sequence(arg[2])[1])
    demands.append(_trigrams(run))
    return (run if exact else None), _all(demands)


def trigram_query(pattern: str, flags: int = 0) -> object:
    """The trigrams that every match of a pattern must contain; True if there are none."""
    return _sequence(parser.parse(pattern, flags))[1]


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


# --- index -----------------------------------------------------------------------------------

_PIECE = 1 << 19
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class Segment:
    """Inverted index of one batch of texts over the given trigrams: trigram to sorted row numbers."""

    def __init__(self, texts: list[bytes], wanted: list[str]):
        self.rows = len(texts)
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        data = np.frombuffer(b"\n\n".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        listed = np.zeros(1 << 24, bool)
        listed[[_code(t) for t in wanted]] = True
        # Pieces overlap by two bytes, so that every trigram is in one: memory does not follow the texts' length.
        pairs = [np.zeros(0, np.int64)]
        for begin in range(0, len(data) - 2, _PIECE):
            piece = _FOLD[data[begin:begin + _PIECE + 2]]
            codes = piece[:-2] << 16 | piece[1:-1] << 8 | piece[2:]
            at = np.flatnonzero(listed[codes])
            pairs.append(np.unique(codes[at].astype(np.int64) * self.rows + np.searchsorted(ends, begin + at, side="right")))
        pairs = np.unique(np.concatenate(pairs))
        codes, row = (pairs // self.rows, pairs % self.rows) if self.rows else (pairs, pairs)
        for t in wanted:
            lo, hi = np.searchsorted(codes, [_code(t), _code(t) + 1])
            self.postings[t] = row[lo:hi]

    def match(self, query: object) -> np.ndarray:
        """Rows that satisfy a query: postings intersected and united, the shortest first."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings[query]
        found = sorted((self.match(q) for q in query[1]), key=len)
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


def spans_of(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough, in code points."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def finder(rules: tuple[Rule, ...]):
    """A function from a batch of texts to each text's spans (start, rule number, end), ordered."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted(set().union(*map(trigrams_of, queries)))

    def start():
        compiled = [re.compile(r.pattern, r.flags) for r in rules]

        def find(texts: list[str]) -> list[list[tuple[int, int, int]]]:
            segment = Segment([t.encode() for t in texts], wanted)
            found: list[list] = [[] for _ in texts]
            for k, query in enumerate(queries):
                for i in segment.match(query):
                    found[i] += [(s, k, e) for s, e in spans_of(rules[k], compiled[k], texts[i])]
            return [sorted(f) for f in found]

        return find

    return start


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``, array of (start, end, kind) ordered by start, then by rule.

    Each batch of documents is a segment with an inverted index of the trigrams that the
    rules' queries name, as in sharded text search: postings are intersected for every rule and
    its candidates verified with the regex over the whole text in the same task, so no text
    moves and a hot document or source does not matter. Rules whose queries demand nothing
    scan every text. Null and empty texts have no secrets. Columns of the input stay; one named
    ``secrets`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    make = finder(rules)

    def start():
        find = make()

        def run(texts: list) -> list[list]:
            return [[[{"start": s, "end": e, "kind": rules[k].kind} for s, k, e in f] for f in find([t or "" for t in texts])]]

        return run

    return append_columns(docs, "text", "secrets array<struct<start:int, end:int, kind:string>>", start)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """Text with its spans replaced, overlapping ones by one mask."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask`` and ``n_chars``, if there, counted anew.

    Overlapping spans are replaced by one mask. Documents without secrets, null texts included,
    stay as they are.
    """
    bounded_batches(docs.sparkSession)
    make = finder(rules)

    def start():
        find = make()

        def run(texts: list) -> list[list]:
            found = find([t or "" for t in texts])
            return [[masked(t, f, mask) if f else t for t, f in zip(texts, found)], [bool(f) for f in found]]

        return run

    out = append_columns(docs, "text", "text string, __changed boolean", start)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
