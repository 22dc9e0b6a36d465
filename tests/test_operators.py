"""Sessions, features and tree aggregation against plain Python."""

import datetime as dt
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions import fold, micros
from cellweave.operators import stretches as S
from cellweave.operators.features import entity_features
from cellweave.operators.sessions import _linked_within, sessions
from cellweave.operators.stretches import doubled_roots, stretches
from cellweave.operators.tree import tree_aggregate
from cellweave.plans import first_positions, input_splits, materialize, release, with_position

ROOT = Path(__file__).resolve().parent.parent
EVENTS = "r_idx bigint, uuids string, timestamps timestamp_ntz, c_idx int, arrived_at timestamp_ntz"
T0 = dt.datetime(2016, 1, 4)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def made(n=3000, seed=1, heavy=0.35, types=6):
    """Events with a heavy trail, ties, nulls, unset times, unknown types and repeated deliveries."""
    r, rows = random.Random(seed), []
    for i in range(n):
        trail = "hot" if r.random() < heavy else f"u{r.randrange(40)}"
        when = at(r.randrange(0, 400_000)) if r.random() > 0.1 else at(r.randrange(20) * 600)
        row = [i, trail, when, r.randrange(types), at(0)]
        k = r.random()
        if k < 0.02:
            row[1] = None
        elif k < 0.04:
            row[2] = None
        elif k < 0.06:
            row[2] = dt.datetime(1970, 1, 1)
        elif k < 0.08:
            row[3] = None
        elif k < 0.1:
            row[3] = 999
        rows.append(tuple(row))
        if r.random() < 0.03:
            rows.append((*row[:4], at(5)))
    r.shuffle(rows)
    return rows


def known(rows):
    trails = defaultdict(set)
    for i, u, t, c, _ in rows:
        if i is not None and u is not None and t is not None and t != dt.datetime(1970, 1, 1):
            trails[u].add((t, i, c))
    return {u: sorted(v, key=lambda e: e[:2]) for u, v in trails.items()}


def brute_sessions(rows, gap):
    out = set()
    for u, events in known(rows).items():
        run = [events[0]]
        for e in events[1:]:
            if (e[0] - run[-1][0]).total_seconds() > gap:
                out.add((u, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(e)
        out.add((u, run[0][1], run[-1][1], len(run)))
    return out


def test_doubled_roots():
    linked = np.array([False, True, True, False, True, False])
    assert doubled_roots(linked).tolist() == [0, 0, 0, 3, 3, 5]
    assert doubled_roots(np.array([], bool)).tolist() == []
    assert doubled_roots(np.ones(5000, bool)).max() == 0


def test_sessions_match_brute_force(spark):
    rows = made()
    got = {(r.uuids, r.first_r_idx, r.last_r_idx, r.n_events) for r in sessions(spark.createDataFrame(rows, EVENTS), 1800).collect()}
    assert got == brute_sessions(rows, 1800)


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_sessions_over_chunk_and_partition_edges(spark, chunk):
    """One trail whose sessions span many partitions and chunks."""
    rows = [(i, "hot", at(i * 60 + (5000 if i > 700 else 0)), 0, at(0)) for i in range(900)]
    rows += rows[::3]
    df = spark.createDataFrame(rows, EVENTS).select(F.col("uuids").alias("key"), F.col("timestamps").alias("t"), F.col("r_idx").alias("id"))
    follows = micros("first_t") - micros("prev_t") <= F.lit(1_800_000_000)
    got = stretches(df, _linked_within(1_800_000_000), follows, chunk=chunk).select("first_id", "last_id", "n").collect()
    assert sorted(map(tuple, got)) == [(0, 700, 701), (701, 899, 199)]


def test_session_edges(spark):
    rows = [(5, "a", at(0), 1, None), (4, "a", at(0), 1, None), (6, "a", at(1800), 1, None), (7, "a", at(3601), 1, None)]
    df = spark.createDataFrame(rows, EVENTS).withColumn("key", F.lit("x")).withColumn("n", F.lit(1)).withColumn("edge", F.lit(True))
    got = sorted((r.first_r_idx, r.last_r_idx, r.seconds, r.n_events) for r in sessions(df).collect())
    assert got == [(4, 6, 1800.0, 3), (7, 7, 0.0, 1)]  # exactly the gap stays; ties by event id


def test_sessions_empty_and_all_null(spark):
    assert sessions(spark.createDataFrame([], EVENTS)).count() == 0
    assert sessions(spark.createDataFrame([(None, None, None, None, None), (1, "a", None, 1, None), (None, "a", at(0), 1, None)], EVENTS)).count() == 0


def test_session_plan_has_one_shuffle_of_events(spark, capsys):
    df = spark.createDataFrame(made(50), EVENTS)
    rows = df.select(F.col("uuids").alias("key"), F.col("timestamps").alias("t"), F.col("r_idx").alias("id"))
    rows.repartitionByRange("key", "t", "id").sortWithinPartitions("key", "t", "id").explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_features_match_brute_force(spark):
    rows, types = made(seed=3), list(range(6))
    trails = [("hot",), ("none",), (None,), *((f"u{i}",) for i in range(40))]
    df = spark.createDataFrame(rows, EVENTS).withColumn("n", F.lit(0)).withColumn("salt", F.lit(0))
    got = {r.uuids: r for r in entity_features(df, spark.createDataFrame(trails, "uuids string"), types).collect()}
    trail = known(rows)
    end = max(e[0] for v in trail.values() for e in v)
    assert len(got) == len(trails)
    for (u,) in trails:
        events = [e for e in trail.get(u, []) if e[2] in types]
        r = got[u]
        assert r.n_events == len(events)
        assert [r[f"c_{k}"] for k in types] == [sum(e[2] == k for e in events) for k in types]
        assert r.last_at == (max(e[0] for e in events) if events else None)
        assert r.seconds_since_last == ((end - r.last_at).total_seconds() if events else None)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_features_of_many_types(spark, n):
    """Types whose bits fill a word, or several."""
    types = [3 * i for i in range(n)]
    rows = [(1000 * i + j, "a", at(i), t, None) for i, t in enumerate(types) for j in range(i % 5)]
    df = spark.createDataFrame(rows, EVENTS) if rows else spark.createDataFrame([], EVENTS)
    r = entity_features(df, spark.createDataFrame([("a",)], "uuids string"), types, recency_per_type=True, salts=3).first()
    assert [r[f"c_{t}"] for t in types] == [i % 5 for i in range(n)] and r.n_events == len(rows)
    assert [r[f"s_{t}"] is None for t in types] == [i % 5 == 0 for i in range(n)]


def test_features_layouts_and_empty(spark):
    df, trails = spark.createDataFrame(made(200), EVENTS), spark.createDataFrame([("hot",), ("hot",)], "uuids string")
    wide = entity_features(df, trails, [0, 1], recency_per_type=True)
    assert [c for c in wide.columns if c[:2] in ("c_", "s_")] == ["c_0", "c_1", "s_0", "s_1"]
    assert wide.count() == 2  # listed twice, two rows
    trail = known(made(200))
    end, last = max(e[0] for v in trail.values() for e in v), max(e[0] for e in trail["hot"] if e[2] == 1)
    assert wide.first().s_1 == (end - last).total_seconds()
    assert entity_features(df, trails, [0, 1], as_of=F.lit(at(0)).cast("timestamp_ntz"), recency_per_type=True).first().s_1 == (T0 - last).total_seconds()
    m = entity_features(df, trails, [0, 1], layout="map").first()
    assert m.totals == {k: v for k, v in ((0, wide.first().c_0), (1, wide.first().c_1)) if v}
    long = entity_features(df, trails, [0, 1, 77], layout="long").collect()
    assert len(long) == 6 and {(r.c_idx, r.n) for r in long} == {(0, wide.first().c_0), (1, wide.first().c_1), (77, 0)}
    assert {r.last_at for r in long if r.c_idx == 1} == {last} and {r.last_at for r in long if r.c_idx == 77} == {None}
    none = entity_features(spark.createDataFrame([], EVENTS), trails, [0]).first()
    assert (none.n_events, none.c_0, none.last_at) == (0, 0, None)
    assert entity_features(df, spark.createDataFrame([], "uuids string"), [0]).count() == 0
    with pytest.raises(ValueError):
        entity_features(df, trails, [0], layout="cube")


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_tree_aggregate(spark, fan_in):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.4 else r.choice(["a", "b", None]), r.choice([None, 1.0, 2.5])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(13)
    got = {x.k: (x.n, x.v_n, x.s, x.lo, x.hi) for x in tree_aggregate(df, ["k"], {"n": ("count", F.lit(1)), "v_n": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, fan_in).collect()}
    for k in {x[0] for x in rows}:
        v = [x[1] for x in rows if x[0] == k]
        w = [x for x in v if x is not None]
        assert got[k] == (len(v), len(w), sum(w), min(w), max(w))
    assert len(got) == 4


def test_tree_aggregate_empty_names_and_errors(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert tree_aggregate(df, ["k"], {"n": ("count", F.lit(1))}).count() == 0
    same = spark.createDataFrame([("a", 1.0)], "n string, __k0 double")
    assert tree_aggregate(same, ["n"], {"v": ("sum", F.col("__k0"))}).first() == ("a", 1.0)
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {"n": ("median", F.col("v"))})
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {"n": ("sum", F.col("v"))}, fan_in=1)


def test_positions_are_contiguous(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("x")).repartition(7)
    rows = with_position(df, ["x"]).collect()
    assert sorted(r._pos for r in rows) == list(range(1000)) and all(r._pos == r.x for r in rows)
    assert with_position(spark.createDataFrame([], "x int"), ["x"]).count() == 0


def test_first_positions_are_the_positions(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("x")).repartition(7)
    assert sorted(map(tuple, first_positions(df, ["x"], 30).collect())) == [(i, i) for i in range(30)]
    assert first_positions(df, ["x"], 5000).count() == 1000 and first_positions(df, ["x"], 0).count() == 0


def test_positions_need_no_python(spark):
    plan = with_position(spark.range(10), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_splits_are_known_without_a_job(spark):
    done = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = done()
    assert input_splits(spark.range(10, numPartitions=5)) == 5
    assert input_splits(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()) == 8
    assert done() == before


def test_intermediates_are_deleted(spark, tmp_path):
    """By release at once, and all others with the session, though the interpreter goes on."""
    import subprocess
    import sys

    df = materialize(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert os.path.exists(path)
    release(df, spark.range(1))
    assert not os.path.exists(path)
    code = f"""
import os, sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from cellweave.plans import materialize
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
materialize(s.range(5)).count()
assert any(f.endswith(".parquet") for _, _, fs in os.walk({str(tmp_path)!r}) for f in fs)
s.stop()
assert not any(f.endswith(".parquet") for _, _, fs in os.walk({str(tmp_path)!r}) for f in fs)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)


def test_materialize_keeps_types(spark):
    df = spark.createDataFrame([(1, None, {1: 2.0})], T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.MapType(T.IntegerType(), T.DoubleType()))]))
    assert materialize(df).schema == df.schema and materialize(df).collect() == df.collect()


def test_fold_and_micros(spark):
    r = spark.createDataFrame([("  Shop/ÜMbrella-1 ", dt.datetime(1969, 12, 31, 23, 59, 59, 5)), (None, None)], "s string, t timestamp_ntz").select(fold("s").alias("s"), micros("t").alias("t")).collect()
    assert [tuple(x) for x in r] == [("shopmbrella1", -999_995), (None, None)]


def test_chunk_constant_is_bounded():
    assert S.CHUNK <= 1 << 20
