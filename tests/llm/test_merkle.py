"""The Merkle manifest against a tree built plainly, and versions against trees rebuilt whole."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quayside.llm import merkle
from tests.llm import fixtures as x


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    text = x.ascii_lower(text) if lower and text is not None else text
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels_of(nodes):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings_of(levels, at):
    out = ""
    for level in levels[:-1]:
        out += "".join(level[j] for j in range(at - at % 16, min(at - at % 16 + 16, len(level))) if j != at)
        at //= 16
    return out


def plain(rows, is_changed):
    """Per row the manifest's values, every version's root by building its whole tree anew."""
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    leaves = {s: [leaf(r) for r in by[s]] for s in sources}
    trees = {s: levels_of(leaves[s]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    root = top[-1][0]
    out = []
    for k, s in enumerate(sources):
        for at, row in enumerate(by[s]):
            folded = root
            if is_changed(row):
                other = levels_of(leaves[s][:at] + [leaf(row, True)] + leaves[s][at + 1:])[-1][0]
                folded = levels_of(top[0][:k] + [other] + top[0][k + 1:])[-1][0]
            out.append((row[0], leaf(row), trees[s][-1][0], root, h(siblings_of(trees[s], at) + siblings_of(top, k)), folded, folded == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def same(got, rows, is_changed):
    assert sorted(map(str, map(tuple, got.select(*COLUMNS).collect()))) == sorted(map(str, plain(rows, is_changed)))


def test_awkward_rows(spark):
    frame = x.clashing(x.awkward(spark)).repartition(4)
    same(merkle.manifest(frame, F.col("doc_id") % 2 == 0), x.AWKWARD, lambda r: r[0] is not None and r[0] % 2 == 0)
    none = merkle.manifest(x.none_of(spark), F.lit(True))
    assert none.collect() == [] and set(COLUMNS) <= set(none.columns)
    one = [(2**60 + 1, "Ab", None, None, 2)]
    same(merkle.manifest(spark.createDataFrame(one, x.SCHEMA), F.lit(True)), one, lambda r: True)


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 16, "c": 17, None: 256, "é": 257}, {"hot": 4400, "Z": 300} | {f"s{i:03}": 2 for i in range(270)}])
def test_trees_over_several_tiers(spark, sizes):
    r = random.Random(3)
    rows = [(i, r.choice(["Some Text", "no capitals", "", None]), "en", s, 9) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    r.shuffle(rows)
    chosen = {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 97 == 0 or i < 3}
    got = merkle.manifest(spark.createDataFrame(rows, x.SCHEMA).repartition(5), F.col("doc_id").isin(*chosen), proofs=True)
    same(got, rows, lambda row: row[0] in chosen)


def test_a_version_copies_its_way_up_and_nothing_else(spark):
    rows = [(i, "Text", "en", "a", 4) for i in range(600)]
    got = {r.doc_id: r for r in merkle.manifest(spark.createDataFrame(rows, x.SCHEMA), F.col("doc_id") == 300, proofs=True).collect()}
    base = levels_of([leaf(r) for r in rows])
    new = levels_of([leaf(r, r[0] == 300) for r in rows])
    assert [r.doc_id for r in got.values() if r.copied] == [300]
    assert got[300].copied == [new[k][300 // 16**k] for k in range(len(new))] and not got[300].verified
    assert sum(a != b for old, now in zip(base, new) for a, b in zip(old, now)) == len(got[300].copied)
    assert all(r.verified and h(r.proof) == r.proof_sha256 for i, r in got.items() if i != 300)


def test_unchanged_leaves_are_folded_too(spark, monkeypatch):
    """A root is recomputed from every leaf: with a fold that is wrong, no row is verified."""
    rows = [(i, "Text", "en", "a" if i < 40 else "b", 4) for i in range(60)]
    frame = spark.createDataFrame(rows, x.SCHEMA)
    assert all(r.verified and r.folded_root == r.root for r in merkle.manifest(frame, F.lit(False)).collect())

    def wrong(node, places, runs):
        return [node, "0" * 64]

    monkeypatch.setattr(merkle, "copied_path", wrong)
    got = merkle.manifest(frame, F.col("doc_id") == 3).collect()
    assert {(r.folded_root, r.verified) for r in got} == {("0" * 64, False)}
    assert [r.doc_id for r in got if r.copied] == [3]
