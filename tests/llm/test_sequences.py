"""Frequent subsequences, runs and distinct counts against plain Python."""

import datetime as dt
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import fold
from cellweave.llm import subsequences as Q
from cellweave.llm.distinct import distinct_counts, distinct_state, error_bound, merge_states, regrouped
from cellweave.llm.runs import collapsed_runs, symbol_string
from cellweave.llm.subsequences import Bitmaps, frequent_subsequences, kernel

EVENTS = "r_idx bigint, uuids string, timestamps timestamp_ntz, c_idx int, arrived_at timestamp_ntz"
TYPES = [(0, "Shop/A", "x"), (1, "shop a", "x"), (2, "b", "x"), (3, None, None), (4, " ", None), (5, "c", "x"), (None, "d", "x")]
T0, UNSET = dt.datetime(2016, 1, 4), dt.datetime(1970, 1, 1)


def made(n, seed, heavy=0.3, trails=30, types=8, step=900):
    r, rows = random.Random(seed), []
    for i in range(n):
        u = "hot" if r.random() < heavy else f"u{r.randrange(trails)}"
        row = [i, u, T0 + dt.timedelta(seconds=r.randrange(n // 4) * step // 10), r.randrange(types), T0]
        k = r.random()
        if k < 0.06:
            row[int(k * 50) + 1] = None
        elif k < 0.08:
            row[2] = UNSET
        rows.append(tuple(row))
        if r.random() < 0.03:
            rows.append((*row[:4], T0 + dt.timedelta(1)))
    r.shuffle(rows)
    return rows


def ordered(rows):
    trails = defaultdict(set)
    for i, u, t, c, _ in rows:
        if None not in (i, u, t) and t != UNSET:
            trails[u].add((t, i, c))
    return {u: [(t, i, c) for t, i, c in sorted(v, key=lambda e: e[:2])] for u, v in trails.items()}


def holds(pattern, sequence):
    it = iter(sequence)
    return all(x in it for x in pattern)


def brute_patterns(sequences, items, shortest, longest, share):
    out, level = {}, [()]
    for n in range(1, longest + 1):
        level = [p + (x,) for p in level for x in items if x not in p]
        supports = {p: sum(holds(p, s) for s in sequences) for p in level}
        level = [p for p in level if supports[p] * share[1] >= len(sequences) * share[0]]
        out |= {p: supports[p] for p in level if n >= shortest}
    return out


@pytest.mark.parametrize("share", [(1, 4), (3, 5), (1, 1)])
def test_patterns_match_brute_force(spark, share, monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 97)
    monkeypatch.setattr(Q, "FAN_IN", 3)
    monkeypatch.setattr(Q, "CANDIDATES", 25)
    rows = made(900, 5)
    seqs = [[c for _, _, c in v if c is not None and c <= 5] for v in ordered(rows).values()]
    seqs = [s for s in seqs if s]
    want = brute_patterns(seqs, range(6), 2, 3, share)
    got = frequent_subsequences(spark.createDataFrame(rows, EVENTS).withColumn("key", F.lit(1)), spark.createDataFrame(TYPES, "c_idx int, cols string, section string"), share, 2, 3).collect()
    assert {tuple(map(int, r.pattern.split())): r.n_trails for r in got} == want
    assert all(r.n_all == len(seqs) and r.n_steps == len(r.pattern.split()) for r in got)


def test_patterns_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_WORDS", 200)
    rows = made(1500, 6, heavy=0.1, trails=120, types=6)
    seqs = [s for v in ordered(rows).values() if (s := [c for _, _, c in v if c is not None])]
    got = frequent_subsequences(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([(i,) for i in range(6)], "c_idx int"), (2, 5), 3, 4).collect()
    assert {tuple(map(int, r.pattern.split())): r.n_trails for r in got} == brute_patterns(seqs, range(6), 3, 4, (2, 5))


def test_patterns_of_nothing(spark):
    types = spark.createDataFrame(TYPES, "c_idx int, cols string, section string")
    for rows in ([], [(1, None, T0, 1, T0)], [(1, "a", T0, None, T0)]):
        assert frequent_subsequences(spark.createDataFrame(rows, EVENTS), types).count() == 0


def test_kernel_keeps_every_short_pattern():
    r = np.random.default_rng(3)
    for n, k in ((400, 5), (300, 12), (64, 3)):
        s = np.minimum(r.geometric(0.4, n) - 1, k - 1)
        small = kernel(s, 3)
        for p in itertools.permutations(range(k), 3):
            assert holds(p, s.tolist()) == holds(p, small.tolist())
        # Two stretches reduced each by itself.
        both = np.concatenate([kernel(s[: n // 3], 3), kernel(s[n // 3 :], 3)])
        assert all(holds(p, s.tolist()) == holds(p, both.tolist()) for p in itertools.permutations(range(k), 3))
    assert len(kernel(np.tile(np.arange(5), 1000), 3)) < 40


def test_bitmaps_of_long_sequences():
    r = random.Random(1)
    seqs = [[r.randrange(4) for _ in range(n)] for n in (0, 1, 63, 64, 65, 200, 3)]
    maps = Bitmaps(np.array([x for s in seqs for x in s]), np.array([len(s) for s in seqs]), np.arange(4))
    got = set(maps.frequent(3, 1, 3))
    assert got == {p for n in (1, 2, 3) for p in itertools.permutations(range(4), n) if sum(holds(p, s) for s in seqs) >= 3}


def brute_runs(rows, labels, gap):
    out = []
    for u, events in ordered(rows).items():
        run = []
        for t, i, c in events:
            label = labels.get(c)
            if run and label is not None and run[-1][2] == label and (t - run[-1][0]).total_seconds() <= gap:
                run.append((t, i, label))
            else:
                out += [(u, run)] if run else []
                run = [(t, i, label)]
        out.append((u, run))
    return sorted((u, r[0][1], r[-1][1], len(r), str(r[0][2]), (r[-1][0] - r[0][0]).total_seconds()) for u, r in out)


@pytest.mark.parametrize("least", [1, 2])
def test_runs_match_brute_force(spark, least):
    rows = made(2500, 7, types=7, step=30)
    labels = {c: "".join(ch for ch in (s or "").lower() if ch.isalnum()) for c, s, _ in TYPES if c is not None}
    want = [r for r in brute_runs(rows, labels, 600) if r[3] >= least]
    got = collapsed_runs(spark.createDataFrame(rows, EVENTS).withColumn("label", F.lit("x")), spark.createDataFrame(TYPES, "c_idx int, cols string, section string"), least=least).collect()
    assert sorted((r.uuids, r.first_r_idx, r.last_r_idx, r.n_events, str(r.label), r.seconds) for r in got) == want


def test_runs_empty(spark):
    types = spark.createDataFrame(TYPES, "c_idx int, cols string, section string")
    assert collapsed_runs(spark.createDataFrame([], EVENTS), types).count() == 0
    one = collapsed_runs(spark.createDataFrame([(1, "a", T0, 1, T0)] * 3, EVENTS), spark.createDataFrame([], "c_idx int, cols string")).first()
    assert (one.label, one.n_events) == (None, 1)


def test_symbols_leave_out_surrogates():
    text, place = symbol_string(np.arange(60_000, dtype=np.int64), np.ones(60_000, bool))
    assert len(set(text)) == len(text) == 60_000 and not any("\ud800" <= c <= "\udfff" for c in text) and place.tolist() == list(range(60_000))


def test_distinct_counts(spark):
    r = random.Random(8)
    rows = [(r.choice(["A-1", "a1", "b", "c", None, "hot", "HOT"]), r.choice([1, 2, 8, None]), r.choice(["x", "y", None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "u string, day int, page string")
    state = lambda d: distinct_state(d, fold("u"), {"day": F.col("day"), "page": F.col("page")})
    sets = [(), ("day",), ("day", "page")]

    def want(day=lambda d: d):
        out = defaultdict(set)
        for u, d, p in rows:
            if u is not None:
                u, d = "".join(c for c in u.lower() if c.isalnum()), day(d) if d is not None else None
                out["", None, None].add(u)
                if d is not None:
                    out["day", d, None].add(u)
                    if p is not None:
                        out["day+page", d, p].add(u)
        return {k: len(v) for k, v in out.items()}

    got = lambda s: {(x.grouping, x.day, x.page): x.n_distinct for x in distinct_counts(s, sets).collect()}
    assert got(state(df)) == want()
    halves = [state(df.filter("day IS NULL OR day < 3")), state(df.filter("day >= 2"))]
    assert got(merge_states(halves)) == want()
    assert got(regrouped(state(df), {"day": F.expr("day div 7").cast("int"), "page": F.col("page")})) == want(lambda d: d // 7)
    assert distinct_counts(state(df.limit(0)), sets).count() == 0
    with pytest.raises(ValueError):
        distinct_counts(state(df), [("week",)])
    with pytest.raises(ValueError):
        distinct_state(df, F.col("u"), {"h": F.col("day")})
    assert error_bound(1e9) < 0.03 and error_bound(0) == 0
    plan = distinct_counts(state(df), sets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # repetitions, buckets, sums of counts
