import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quayside.llm import simhash
from quayside.llm.common import components
from tests.llm import fixtures as x


def plain_fingerprint(text):
    words = x.split_words(x.ascii_lower(text))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_awkward_rows(spark):
    rows = simhash.fingerprints(x.clashing(x.awkward(spark))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint % 2**64) for r in rows) == sorted(
        (i is None, i or 0, plain_fingerprint(t)) for i, t, *_ in x.AWKWARD)


def test_components_of_awkward_rows(spark):
    rows = simhash.near_duplicates(x.awkward(spark)).collect()
    assert len(rows) == len(x.AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == {1} and by[3] == by[4] == by[5] == {3}
    assert by[None] == {3, None}
    assert simhash.near_duplicates(x.none_of(spark)).count() == 0


@pytest.mark.parametrize("limit", [2, 64])
def test_links_against_all_pairs(spark, monkeypatch, limit):
    """Clusters in one block, so that small limits go through midpoints."""
    monkeypatch.setattr(simhash, "LARGE_BLOCK", limit)
    r = random.Random(5)
    prints = {0, -1, (1 << 63) - 1}
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(40):
            value = centre
            for _ in range(r.randrange(5)):
                value ^= 1 << r.randrange(64)
            prints.add(value - (1 << 64) if value >> 63 else value)
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    got = {(r.a, r.b) for r in simhash.close_pairs(frame).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert got == want and want


def test_block_masks_hold_for_every_pair_of_bits():
    for distance, blocks in ((1, 3), (2, 4), (2, 5), (3, 6)):
        masks = simhash.block_masks(distance, blocks)
        rng = np.random.default_rng(1)
        for _ in range(300):
            flipped = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
            assert any(not m & flipped for m in masks)


def test_components_against_union_find(spark):
    r = random.Random(3)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    frame = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    want = x.smallest_reachable(sorted({i for l in links for i in l}), links)
    linked = {i for l in links if l[0] != l[1] for i in l}
    assert {(r.node, r.component) for r in components(frame).collect()} == {(i, want[i]) for i in linked}
    assert components(frame.where("a < 0")).count() == 0


def test_one_document_of_each_group_stays(spark):
    kept = simhash.distinct_documents(x.clashing(x.awkward(spark)))
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 6, 7, 8, 9, 10]
    assert sum(r.doc_id is None for r in rows) == 2 and set(x.CLASHING) <= set(kept.columns)


def test_query_against_all_pairs_of_documents(spark):
    from quayside.llm.catalogue import QUERIES

    rows = QUERIES["op4_simhash"](spark, "/root/testdata/sf0.001").collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert prints == {r.doc_id: plain_fingerprint(r.text) for r in texts}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in rows} == x.smallest_reachable(list(prints), links)


def test_block_join_is_no_nested_loop(spark):
    frame = spark.range(1000).select(F.xxhash64("id").alias("fingerprint"))
    plan = simhash.close_pairs(frame)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("limit", [2, 64])
def test_near_copies_by_shingles_against_all_pairs(spark, monkeypatch, limit):
    """Edited copies far over 2 bits apart; small limits send blocks through their smallest node."""
    monkeypatch.setattr(simhash, "LARGE_BLOCK", limit)
    r, texts = random.Random(8), []
    for g in range(6):
        base = x.prose(40 + g, 200).split()
        for _ in range(12):
            edited = list(base)
            for at in r.sample(range(200), r.randrange(9)):
                edited[at] = f"e{r.randrange(10_000)}"
            texts.append(" ".join(edited))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(196)} for t in texts]
    links = [(a, b) for a in range(72) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = x.smallest_reachable(list(range(72)), links)
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {q.doc_id: q.component_id for q in got} == want and len(set(want.values())) > 6
    tight = {q.doc_id: q.component_id for q in simhash.close_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert any(tight[a] != tight[b] for a, b in links)
    kept = simhash.distinct_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {q.doc_id for q in kept.collect()} == set(want.values())


def test_near_copies_are_linked_by_fingerprints_first(spark, monkeypatch):
    """Long texts with one edited word differ in few bits: SimHash links them, whatever the bands find, and only pairs of similar sets."""
    base = {g: x.prose(70 + g, 900).split() for g in range(4)}
    texts = {}
    for g, words in base.items():
        for k in range(6):
            edited = list(words)
            edited[100 * k + 50] = f"e{k}"
            texts[10 * g + k] = " ".join(edited)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {i: simhash._majority([h], len(h)) for i, h in ((i, simhash.shingle_hashes(t.encode())) for i, t in texts.items())}
    close = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) % 2**64).bit_count() <= 2]
    assert len(close) > 10 and all(a // 10 == b // 10 for a, b in close)
    want = x.smallest_reachable(list(texts), close)
    monkeypatch.setattr(simhash, "_band_keys", lambda *_: [])
    alone = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert alone == want
    monkeypatch.undo()
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()} == {i: i - i % 10 for i in texts}
