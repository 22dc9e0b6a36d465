"""Items that occur together, against a null model of baskets.

Pair counts are exact: each block of baskets is a 0/1 matrix X, and X'X holds the counts of all its pairs,
so no pair of a basket ever becomes a row; only a block's sums do. The null is the bipartite configuration
model: item i is in basket u with probability x_i y_u / (1 + x_i y_u), fitted so that every item's frequency
and every basket's size hold in expectation. A pair's count is then Poisson-binomial.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.plans import materialize, small_broadcast, with_position

#: Baskets and items of one dense block; pairs with a rarer item are counted sparsely.
BASKETS, DENSE = 4096, 1024


def _pair_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(items) -> (cols_a, cols_b, n) of the block, a <= b; a = b counts the item itself."""
    for b in batches:
        col = b.column("items")
        n = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
        words = col.flatten().dictionary_encode()
        names, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(code):
            continue
        rank = np.argsort(np.array(names.to_pylist(), dtype=object).astype(str), kind="stable")  # by name: a < b
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        names, code, k = names.take(pa.array(rank)), place[code], len(rank)
        basket = np.repeat(np.arange(len(n)), n)
        freq = np.bincount(code, minlength=k)
        dense = np.sort(np.argsort(-freq, kind="stable")[:DENSE])
        local = np.full(k, -1)
        local[dense] = np.arange(len(dense))
        counts = np.zeros((len(dense), len(dense)), np.int64)
        at = local[code]
        for start in range(0, len(n), BASKETS):
            here = (basket >= start) & (basket < start + BASKETS) & (at >= 0)
            x = np.zeros((min(BASKETS, len(n) - start), len(dense)), np.float32)
            x[basket[here] - start, at[here]] = 1
            counts += (x.T @ x).astype(np.int64)  # at most BASKETS: exact in float32
        i, j = np.nonzero(np.triu(counts))
        a, z, c = [dense[i]], [dense[j]], [counts[i, j]]
        if k > len(dense):
            order = np.lexsort((code, basket))
            u, v, rare = basket[order], code[order], at[order] < 0
            keys = []
            for d in range(int(n.max())):
                m = (u[d:] == u[: len(u) - d]) & (rare[d:] | rare[: len(u) - d])
                keys.append(v[: len(u) - d][m] * k + v[d:][m])
            pairs, times = np.unique(np.concatenate(keys), return_counts=True)
            a, z, c = [*a, pairs // k], [*z, pairs % k], [*c, times]
        a, z, c = map(np.concatenate, (a, z, c))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(z)), pa.array(c.astype(np.int64))], names=["cols_a", "cols_b", "n"])


def baskets_of(df: DataFrame, basket: Column, item: Column) -> DataFrame:
    """(items): the set of different items of each basket. Rows with a null basket or item are left out.
    Repetitions are removed before the shuffle; a basket has at most as many entries as there are items."""
    rows = df.select(basket.alias("b"), item.alias("i")).filter("b IS NOT NULL AND i IS NOT NULL")
    return rows.groupBy("b").agg(F.collect_set("i").alias("items")).select("items")


def fit_configuration(frequency: dict[int, int], size: dict[int, int], rounds: int = 500, tolerance: float = 1e-10) -> tuple[dict[int, float], dict[int, float]]:
    """x by item frequency and y by basket size, from how many items and baskets have each. Items of equal
    frequency share x, baskets of equal size share y, so the model is as small as the numbers of different
    values; sums of rows and columns agree with the data after the fixed point is reached."""
    k, g = (np.array(v, float) for v in zip(*sorted(frequency.items())))
    d, h = (np.array(v, float) for v in zip(*sorted(size.items())))
    total = max(float((k * g).sum()), 1.0)
    x, y = k / math.sqrt(total), d / math.sqrt(total)
    full_x, full_y = k >= h.sum(), d >= g.sum()  # in every basket; holding every item
    x[full_x], y[full_y] = 1e9, 1e9
    for _ in range(rounds):
        old = x
        x = np.where(full_x, 1e9, k / np.maximum((h * y / (1 + np.outer(x, y))).sum(axis=1), 1e-300))
        y = np.where(full_y, 1e9, d / np.maximum((g * x / (1 + np.outer(y, x))).sum(axis=1), 1e-300))
        if np.max(np.abs(x - old) / np.maximum(old, 1e-300)) < tolerance:
            break
    return dict(zip(k.astype(int).tolist(), x.tolist())), dict(zip(d.astype(int).tolist(), y.tolist()))


def log_tail(n: np.ndarray, q: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(X >= n) for X a sum of h[d] trials with probability q[:, d].

    Up to 24 with a mean of at most 12 the probabilities are convolved; beyond, the saddlepoint formula of
    Lugannani and Rice for lattice variables is used, whose relative error falls with the count.
    """
    n = n.astype(float)
    mean, var = q @ h, (q * (1 - q)) @ h
    out = np.zeros(len(n))
    small = (n <= 24) & (mean <= 12) & (n > 0)
    if small.any():
        top = 64
        p = np.zeros((int(small.sum()), top))
        p[:, 0] = 1
        for d in range(len(h)):
            qd = np.minimum(q[small, d], 1 - 1e-15)
            term = np.exp(h[d] * np.log1p(-qd))
            pmf = np.zeros_like(p)
            for j in range(min(top, int(h[d]) + 1)):
                pmf[:, j] = term
                term = term * (h[d] - j) / (j + 1) * qd / (1 - qd)
            p = np.stack([(p[:, : i + 1] * pmf[:, i::-1]).sum(axis=1) if i else p[:, 0] * pmf[:, 0] for i in range(top)], axis=1)
        m = n[small].astype(int)
        upper = np.cumsum(p[:, ::-1], axis=1)[:, ::-1]
        lower = np.cumsum(p, axis=1)
        at = np.arange(len(m))
        out[small] = np.where(n[small] > mean[small], np.log(np.maximum(upper[at, m], 1e-300)), np.log(np.maximum(1 - lower[at, m - 1], 1e-300)))
    big = ~small & (n > 0)
    if big.any():
        out[big] = _saddle(n[big], q[big], h, mean[big], var[big])
    return np.minimum(out, 0.0)


def _log_normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([math.log(0.5 * math.erfc(v / math.sqrt(2))) if v < 25 else -0.5 * v * v - math.log(v * math.sqrt(2 * math.pi)) for v in z])


def _saddle(n: np.ndarray, q: np.ndarray, h: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    top = float(h.sum())
    out = np.zeros(len(n))
    sure = (n >= top) & (n > mean)  # all trials
    out[sure] = (np.log(np.maximum(q[sure], 1e-300)) * h).sum(axis=1)
    i = np.flatnonzero(~sure)
    n, q, mean, var = n[i], q[i], mean[i], np.maximum(var[i], 1e-300)
    lo, hi = np.full(len(n), -50.0), np.full(len(n), 50.0)
    t = np.clip(np.log(np.maximum(n, 0.5) / np.maximum(mean, 1e-300)), -30, 30)
    for _ in range(80):
        e = q * np.exp(t)[:, None]
        p = e / (1 - q + e)
        gap = p @ h - n
        lo, hi = np.where(gap < 0, t, lo), np.where(gap > 0, t, hi)
        new = t - gap / np.maximum((p * (1 - p)) @ h, 1e-300)
        new = np.where((new <= lo) | (new >= hi), (lo + hi) / 2, new)
        if np.max(np.abs(new - t), initial=0) < 1e-12:
            break
        t = new
    e = q * np.exp(t)[:, None]
    p = e / (1 - q + e)
    k2 = (p * (1 - p)) @ h
    cgf = np.log1p(q * np.expm1(t)[:, None]) @ h
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * n - cgf), 0))
    u = -np.expm1(-t) * np.sqrt(k2)
    near = np.abs(t) < 1e-4
    ok = ~near
    z = np.zeros(len(n))
    z[near] = _log_normal_tail((n[near] - 0.5 - mean[near]) / np.sqrt(var[near]))
    if ok.any():
        tail = _log_normal_tail(w[ok])
        density = -0.5 * w[ok] ** 2 - 0.5 * math.log(2 * math.pi)
        extra = 1 / u[ok] - 1 / w[ok]
        z[ok] = tail + np.log(np.maximum(1 + np.exp(np.minimum(density - tail, 700)) * extra, 1e-12))
    out[i] = z
    return out


def _surprise(x: dict[int, float], y: dict[int, float], sizes: dict[int, int]):
    d = np.array(sorted(sizes))
    yd, h = np.array([y[v] for v in d]), np.array([sizes[v] for v in d], float)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                n_a, n_b, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b", "n_ab"))
                q = np.ones((part.num_rows, len(d)))
                for values in (n_a, n_b):
                    odds = np.array([x[int(v)] for v in values])[:, None] * yd
                    q *= odds / (1 + odds)
                expected, log10 = q @ h, log_tail(n, q, h) / math.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(expected), pa.array(log10)], names=[*part.schema.names, "expected", "log10_p"])

    return run


def co_occurrence(df: DataFrame, basket: Column, item: Column) -> DataFrame:
    """(cols_a, cols_b, n_ab, n_a, n_b, n, ratio, expected, log10_p) for each pair of different items that
    share a basket, a before b: the baskets with both, with each, and with any item; ``ratio`` is
    n_ab * n / (n_a * n_b); ``expected`` the mean of n_ab under the null, and log10_p the decimal logarithm
    of the probability of n_ab or more under it.

    Rows with a null basket or item are left out; repetitions count once. A single item, or an empty input,
    gives no pair. Held on the driver: how many items have each frequency and how many baskets each size.
    """
    spark = df.sparkSession
    baskets = materialize(baskets_of(df, basket, item), "baskets")
    name = baskets.schema["items"].dataType.elementType
    schema = T.StructType([T.StructField("cols_a", name), T.StructField("cols_b", name), T.StructField("n", T.LongType())])
    counted = materialize(baskets.mapInArrow(_pair_counts, schema).groupBy("cols_a", "cols_b").agg(F.sum("n").alias("n")), "pairs")
    single = counted.filter("cols_a = cols_b").select(F.col("cols_a").alias("item"), F.col("n").alias("freq"))
    frequency = {r[0]: r[1] for r in single.groupBy("freq").count().collect()}
    size = {r[0]: r[1] for r in baskets.groupBy(F.size("items").alias("size")).count().collect()}
    n = sum(size.values())
    x, y = fit_configuration(frequency, size) if frequency else ({}, {})
    both = (
        counted.filter("cols_a <> cols_b")
        .join(small_broadcast(single.select(F.col("item").alias("cols_a"), F.col("freq").alias("n_a"))), "cols_a")
        .join(small_broadcast(single.select(F.col("item").alias("cols_b"), F.col("freq").alias("n_b"))), "cols_b")
        .select("cols_a", "cols_b", F.col("n").alias("n_ab"), "n_a", "n_b")
    )
    fields = [*both.schema.fields, T.StructField("expected", T.DoubleType()), T.StructField("log10_p", T.DoubleType())]
    judged = both.mapInArrow(_surprise(x, y, size), T.StructType(fields)) if frequency else spark.createDataFrame([], T.StructType(fields))
    ratio = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return judged.select("cols_a", "cols_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), ratio.alias("ratio"), "expected", "log10_p")


def surprising(pairs: DataFrame, n_tests: int, rate: float = 0.01) -> DataFrame:
    """pairs with ``surprising``: whether the pair is a discovery at this false-discovery rate by the rule of
    Benjamini and Hochberg, among n_tests tests. Pairs that never occur together count as tests too."""
    ranked = with_position(pairs, ["log10_p", "cols_a", "cols_b"], "__rank")
    limit = F.log10((F.col("__rank") + 1) * F.lit(rate / max(1, n_tests)))
    best = ranked.filter(F.col("log10_p") <= limit).agg(F.max("log10_p")).first()[0]
    flag = F.lit(False) if best is None else F.col("log10_p") <= F.lit(best)
    return ranked.withColumn("surprising", flag).drop("__rank")
