"""Pair counts and their null model."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import pairs as P
from cellweave.llm.pairs import co_occurrence, fit_configuration, log_tail, surprising


def baskets(n=400, items=25, seed=1):
    r = random.Random(seed)
    out = {f"b{i}": {f"i{int(items * r.random() ** 2)}" for _ in range(r.randrange(1, 8))} for i in range(n)}
    out["all"] = {f"i{k}" for k in range(items)}
    return out


@pytest.mark.parametrize("dense", [1024, 4])
def test_counts(spark, dense, monkeypatch):
    monkeypatch.setattr(P, "DENSE", dense)
    monkeypatch.setattr(P, "BASKETS", 37)
    b = baskets()
    rows = [(u, i, 1) for u, own in b.items() for i in own] * 2 + [(None, "i1", 1), ("x", None, 1)]
    random.Random(2).shuffle(rows)
    got = co_occurrence(spark.createDataFrame(rows, "u string, i string, n int"), F.col("u"), F.col("i")).collect()
    single = Counter(i for own in b.values() for i in own)
    both = Counter(p for own in b.values() for p in itertools.combinations(sorted(own), 2))
    assert {(r.cols_a, r.cols_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == {p: (c, single[p[0]], single[p[1]], len(b)) for p, c in both.items()}
    assert all(r.ratio == pytest.approx(r.n_ab * r.n / (r.n_a * r.n_b)) and r.log10_p <= 0 and r.expected > 0 for r in got)


def test_no_pairs(spark):
    for rows in ([], [("u", "i")], [(None, "i"), ("u", None)], [("u", "i"), ("v", "j")]):
        assert co_occurrence(spark.createDataFrame(rows, "u string, i string"), F.col("u"), F.col("i")).count() == 0


def test_null_honours_margins():
    b = baskets()
    freq = Counter(Counter(i for own in b.values() for i in own).values())
    size = Counter(len(own) for own in b.values())
    x, y = fit_configuration(freq, size)
    for k, xi in x.items():
        assert sum(h * xi * y[d] / (1 + xi * y[d]) for d, h in size.items()) == pytest.approx(k, rel=1e-5)
    for d, yd in y.items():
        assert sum(g * x[k] * yd / (1 + x[k] * yd) for k, g in freq.items()) == pytest.approx(d, rel=1e-3)


def exact_tail(n, q, h):
    p = np.array([1.0])
    for qd, hd in zip(q, h.astype(int)):
        for _ in range(hd):
            p = np.convolve(p, [1 - qd, qd])
    return p[n:].sum()


def test_tails_match_convolution():
    r = np.random.default_rng(5)
    h = np.array([30.0, 60.0, 110.0])
    for scale in (0.002, 0.03, 0.2, 0.6):
        q = r.random((12, 3)) * scale
        mean = q @ h
        n = np.minimum(200, np.concatenate([np.ceil(mean[:4] * 2) + 1, np.ceil(mean[4:8] * 1.2) + 1, np.maximum(1, np.floor(mean[8:] * 0.8))]))
        got = log_tail(n, q, h)
        for i in range(12):
            want = exact_tail(int(n[i]), q[i], h)
            if want > 1e-250:
                assert got[i] == pytest.approx(math.log(want), rel=0.02, abs=0.02)


def test_discoveries(spark):
    r = random.Random(3)
    rows = [(u, f"i{r.randrange(40)}") for u in range(1500) for _ in range(4)]
    rows += [(u, x) for u in range(0, 1500, 12) for x in ("left", "right")]
    found = surprising(co_occurrence(spark.createDataFrame(rows, "u int, i string"), F.col("u"), F.col("i")), 42 * 41 // 2)
    flagged = {(x.cols_a, x.cols_b) for x in found.filter("surprising").collect()}
    assert ("left", "right") in flagged and len(flagged) <= 5
    assert surprising(found.drop("surprising").limit(0), 10).count() == 0
