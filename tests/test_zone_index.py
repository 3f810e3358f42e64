"""The positional index of rule matching: against plain substring search, on awkward and long texts."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.operators import runs, zones
from tests.conftest import plan_of


def held(spark, wholes, pieces):
    frames = [spark.createDataFrame(list(enumerate(x)), "a long, s string") for x in (wholes, pieces)]
    return sorted((r.a, r.b) for r in zones._holding(*frames).collect())


def plain(wholes, pieces):
    return sorted((i, j) for i, w in enumerate(wholes) for j, p in enumerate(pieces) if p in w)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("abé𝒳 ", max_size=14), max_size=6), st.lists(st.text("abé𝒳 ", max_size=7), max_size=6))
def test_any_texts(spark, wholes, pieces):
    assert held(spark, wholes, pieces) == plain(wholes, pieces)


def test_repeats_empty_texts_and_one_letter(spark):
    wholes, pieces = ["aaaa", "aaaaaaaaaaaa", "", "b", "aaaa", "line\nbreak"], ["aaaa", "aa", "", "a", "b", "aaaaa", "aa", "e\nb", "zzzz"]
    assert held(spark, wholes, pieces) == plain(wholes, pieces)
    assert held(spark, [], ["a"]) == held(spark, ["a"], []) == []


@pytest.mark.parametrize("chars", [zones.BLOCK_CHARS - 2, zones.BLOCK_CHARS, 5 * zones.BLOCK_CHARS + 3])
def test_pieces_across_blocks_of_long_texts(spark, chars):
    r = random.Random(chars)
    wholes = ["".join(r.choice("abcd") for _ in range(chars + k)) for k in range(3)]
    pieces = [w[at:at + n] for w in wholes for at, n in ((0, 5), (max(0, chars - 300), 290), (zones.BLOCK_CHARS - 3, 6), (chars - 4, 9))] + ["abcdabcdabcda", "dddddddd"]
    assert held(spark, wholes, pieces) == plain(wholes, pieces)


def test_postings_carry_no_text(spark):
    rows = spark.createDataFrame([(1, "west of Singapore")], "a long, s string")
    grams = zones._grams(rows, [2, 4])
    assert grams.columns == ["a", "gram", "at"] and grams.agg(F.max(F.length("gram"))).first()[0] == 4
    last = sorted((r.gram, r["at"]) for r in grams.where("at >= 14").collect())
    assert last == [("or", 15), ("po", 14), ("pore", 14), ("re", 16)]
    assert "NestedLoop" not in plan_of(grams)


def test_rarest_run_is_the_key(spark):
    """A common beginning meets a thousand texts, the rare end one: candidates follow the rare one."""
    wholes = [f"port of {i:04d}" for i in range(1000)]
    pieces = ["port of 0007", "port of 9999", "port of 00"]
    assert held(spark, wholes, pieces) == plain(wholes, pieces)


def test_pieces_longer_than_blocks_and_than_key_runs(spark):
    r = random.Random(4)
    wholes = ["".join(r.choice("abcd") for _ in range(n)) for n in (3000, 900, 700)]
    pieces = [w[at:at + n] for w in wholes for at, n in ((0, 700), (37, 513), (150, 512), (255, 257))]
    pieces += [p[:400] + ("b" if p[400] == "a" else "a") + p[401:] for p in pieces if len(p) > 400] + ["x" * 3001]
    assert held(spark, wholes, pieces) == plain(wholes, pieces)


def test_long_texts_are_not_cut_into_runs(spark, monkeypatch):
    """Texts longer than all keywords are in none; of a long text that may be in one, a bounded number of runs is tried."""
    seen, runs = [], zones._runs
    monkeypatch.setattr(zones, "_runs", lambda pieces: seen.append(runs(pieces)) or seen[-1])
    rows = spark.createDataFrame([(i, f"{i} " + "cargo for Singapore and Lagos " * 40) for i in range(50)], "id long, region string")
    rules = spark.createDataFrame([(1, "singapore", "A"), (2, "lagos", "B")], "priority int, keyword string, zone string")
    assert {x.zone for x in zones.match_rules(rows, "region", rules).collect()} == {"A"}
    assert [s.count() for s in seen] == [8, 0]
    assert runs(spark.createDataFrame([(1, "ab" * 5000)], "a long, s string")).count() <= zones.KEY_RUNS


def test_joined_pieces_equal_carried_ones(spark, monkeypatch):
    """Pieces too many to be carried meet the wholes by joins, with the same pairs."""
    r = random.Random(7)
    wholes = ["".join(r.choice("abé𝒳") for _ in range(n)) for n in (0, 3, 40, 300, 900)] + ["aaaaaaaa", "line\nbreak", "port of 0007"]
    pieces = [w[at:at + n] for w in wholes for at, n in ((0, 2), (1, 4), (2, 9), (250, 300))] + ["", "aaaaa", "port of 9999", "b" * 1000]
    carried = held(spark, wholes, pieces)
    monkeypatch.setattr(zones, "CARRIED_RUNS", 3)
    monkeypatch.setattr(zones, "_holding_carried", None)
    assert carried == held(spark, wholes, pieces) == plain(wholes, pieces)


def test_carried_pieces_make_no_row_per_character(spark, monkeypatch):
    """A few rules are looked for where the texts are read: the texts are neither cut into runs nor into blocks."""
    cut = []
    for name in ("_grams", "_blocks"):
        monkeypatch.setattr(zones, name, lambda rows, *a, f=getattr(zones, name): cut.append(rows) or f(rows, *a))
    texts = ["cargo " * 2000 + place for place in ("Singapore", "Lagos", "Xagos", "Zingapore")] + ["lag", "sing", " ", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, region string")
    rules = spark.createDataFrame([(2, "singapore", "A"), (1, "lagos", "B"), (3, "lagos", "C"), (0, None, "D")], "priority int, keyword string, zone string")
    found = {x.id: x.zone for x in zones.match_rules(rows, "region", rules).collect()}
    none = "UNSPECIFIED"
    assert found == {0: "A", 1: "B", 2: none, 3: none, 4: "B", 5: "A", 6: "B", 7: none, 8: none}
    assert not cut


@pytest.mark.parametrize("letters", ["ab", "abé𝒳\0", "日本é語"])
def test_runs_of_bytes_at_every_place(letters, monkeypatch):
    """Runs of 1 to 16 bytes, also where slices of a buffer and texts end."""
    monkeypatch.setattr(runs, "SLICE", 7)
    r = random.Random(len(letters))
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(30))).encode() for _ in range(30)]
    wanted = sorted({"".join(r.choice(letters) for _ in range(n)).encode() for n in (1, 1, 2, 2, 3, 3, 4, 4, 4)})
    offsets, data = runs._texts(pa.array([b"before", *texts, b"after"], pa.binary()).slice(1, 30))
    found = {(t, p - offsets[t], wanted[k]) for part in runs.RunFinder(wanted).find(offsets, data) for t, p, k in zip(*part)}
    assert found == {(t, p, k) for t, text in enumerate(texts) for p in range(len(text)) for k in wanted if text.startswith(k, p)}


def test_equal_carried_pieces_keep_their_ids(spark):
    """Ids of any type, of pieces that are equal: each comes back."""
    wholes = spark.createDataFrame([(1, "west of singapore"), (2, "lagos")], "a int, s string")
    pieces = spark.createDataFrame([("x", "singapore"), ("y", "singapore"), ("z", "lagos"), ("w", "zzzzz")], "a string, s string")
    found = zones._holding(wholes, pieces)
    assert dict(found.dtypes) == {"a": "int", "b": "string"}
    assert sorted(tuple(r) for r in found.collect()) == [(1, "x"), (1, "y"), (2, "z")]
