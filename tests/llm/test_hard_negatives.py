"""Hard negatives against plain integer arithmetic."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import hard_negatives as h
from tests.llm import fixtures as x

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, is_anchor, positives=5, negatives=3, scale=256):
    sound = [(i, [math.floor(scale * c) for c in v], k) for i, v, k in rows if k is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    last = float("inf")
    out = []
    for i, v, k in sound:
        if i is None or not is_anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), last if j is None else j, j, m) for j, w, m in sound if len(w) == len(v)), key=lambda r: r[:2])
        for p, _, pid, _ in [s for s in scored if s[3] == k and s[2] != i][:positives]:
            near = [s for s in scored if s[3] != k and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, pid, r + 1, n[2], -p, -n[0]) for r, n in enumerate(near)]
    return out


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_products_are_exact_for_any_depth_and_size():
    rng = np.random.default_rng(1)
    for dims, most in ((1, 3), (64, 256), (2500, 40), (5, 10**9)):
        a, b = rng.integers(-most, most + 1, (7, dims)), rng.integers(-most, most + 1, (9, dims))
        primes = h.moduli(float(dims) * most * most)
        got = h.exact_products(h.residues(a.astype(float), primes), h.residues(b.astype(float), primes), primes)
        assert got.tolist() == (a.astype(object) @ b.astype(object).T).tolist()
    with pytest.raises(ValueError):
        h.moduli(1e19)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(2, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, [1.0, 0.4], 1), (4, [0.9, 0.5], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
            (10, [1.0, 0.5], None), (11, [0.8, 0.3], 2), (12, [0.8, 0.3], 2), (None, [0.8, 0.3], 2), (13, [0.8, 0.3], 3), (14, [0.0, 0.0], 1), (15, [], 1), (16, [], 2),
            (18, [], 1), (20, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.5], 1), (-4, [-1.0, -0.5], 1), (21, [0.6, 0.2], 2), (2, [0.7, 0.2], 2)]
    frame = x.clashing(spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit("list"))).repartition(4)
    got = rows_of(h.mine(frame, F.col("vec_id") % 2 == 0))
    assert got == sorted(map(str, plain(rows, lambda i: i % 2 == 0))) and got
    assert h.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).collect() == []
    assert h.mine(spark.createDataFrame([(1, None, None)], SCHEMA), F.col("vec_id") % 2 == 0).collect() == []


def test_against_plain_search_in_rounds_with_ties_and_a_hot_label(spark):
    r = random.Random(5)
    rows = [(i, [round(r.gauss(0, 1), 1) for _ in range(4)], 0 if r.random() < 0.4 else r.randrange(5)) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.5, -0.5, 0.1], 1) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = sorted(map(str, plain(rows, lambda i: i % 10 == 0)))
    anchor = F.col("vec_id") % 10 == 0
    assert rows_of(h.mine(frame, anchor)) == want
    assert rows_of(h.mine(frame, anchor, anchor_bytes=32 * 25)) == want
