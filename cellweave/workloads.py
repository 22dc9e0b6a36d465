"""Queries over the driver's tables for the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import is_set_time
from cellweave.operators.features import entity_features
from cellweave.operators.sessions import sessions
from cellweave.operators.tree import tree_aggregate
from cellweave.plans import materialize

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- problem 3: sessions


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "trail_events"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_sessions(spark, sf_dir).select("first_r_idx", "last_r_idx")


# --- problem 5: one row of features for each trail


def _features(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    types = [r[0] for r in table(spark, sf_dir, "trail_cols").select("c_idx").filter("c_idx IS NOT NULL").collect()]  # the output's columns
    return entity_features(table(spark, sf_dir, "trail_events"), table(spark, sf_dir, "trails"), types, layout=layout)


def p5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "wide")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "long")


# --- problem 7: results of keys that hold most rows


def p7_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "trail_events")
    cells = table(spark, sf_dir, "frame_cells")
    timed = F.when(is_set_time("timestamps", events.schema["timestamps"].dataType.simpleString()), F.col("timestamps"))
    present = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0), F.col("value"))
    rows = events.select(F.lit("uuids").alias("key_field"), F.col("uuids").alias("key_value"), timed.alias("t"), F.lit(None).cast("double").alias("v")).unionAll(
        cells.select(F.lit("_index"), F.col("_index"), F.lit(None).cast(events.schema["timestamps"].dataType), present)
    )
    return tree_aggregate(
        rows,
        ["key_field", "key_value"],
        {"n_rows": ("count", F.lit(1)), "n_timed": ("count", F.col("t")), "first_at": ("min", F.col("t")), "last_at": ("max", F.col("t")), "n_values": ("count", F.col("v")), "total": ("sum", F.col("v"))},
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = p7_key_totals(spark, sf_dir).select("key_field", "key_value", "n_rows")
    # Per-key counts, one row a key, are written once, so that the two totals don't run the aggregation again.
    counts = materialize(counts, "counts")
    whole = counts.groupBy("key_field").agg(F.sum("n_rows").alias("n_all"))  # two rows
    heavy = counts.join(F.broadcast(whole), "key_field").filter("key_value IS NOT NULL AND n_rows * 50 >= n_all")
    return heavy.select("key_field", "key_value")


QUERIES: dict[str, Query] = {"p3_found": p3_found, "p3_sessions": p3_sessions, "p5_features": p5_features, "p5_totals": p5_totals, "p7_found": p7_found, "p7_key_totals": p7_key_totals}

_EVENTS = "SELECT r_idx, any_value(uuids) AS uuids, any_value(timestamps) AS timestamps, any_value(c_idx) AS c_idx FROM trail_events WHERE uuids IS NOT NULL AND r_idx IS NOT NULL AND timestamps IS NOT NULL AND timestamps <> TIMESTAMP '1970-01-01' GROUP BY r_idx"

_KNOWN = f"e AS ({_EVENTS}), known AS (SELECT * FROM e WHERE c_idx IN (SELECT c_idx FROM trail_cols))"
_LATEST = "(SELECT max(epoch_us(timestamps)) FROM trail_events WHERE timestamps <> TIMESTAMP '1970-01-01')"


def _types(path: str = "/root/testdata/sf0.01/trail_cols.parquet") -> list[int]:
    """The types of the tables that the SQL is run on: the wide result's columns, which a view's text must name."""
    return sorted(c for c in pq.read_table(path, columns=["c_idx"]).column(0).to_pylist() if c is not None) if Path(path).exists() else []


_SESSIONS = f"""WITH e AS ({_EVENTS}),
l AS (SELECT *, timestamps - lag(timestamps) OVER w > INTERVAL 1800 SECOND AS brk FROM e WINDOW w AS (PARTITION BY uuids ORDER BY timestamps, r_idx)),
s AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY uuids ORDER BY timestamps, r_idx) AS k FROM l)
SELECT uuids, arg_min(r_idx, (timestamps, r_idx)) AS first_r_idx, arg_max(r_idx, (timestamps, r_idx)) AS last_r_idx, min(timestamps) AS started_at, max(timestamps) AS ended_at,
  CAST(epoch_us(max(timestamps)) - epoch_us(min(timestamps)) AS DOUBLE) / 1e6 AS seconds, COUNT(*) AS n_events FROM s GROUP BY uuids, k"""

_KEYS = """SELECT 'uuids' AS key_field, uuids AS key_value, CASE WHEN timestamps <> TIMESTAMP '1970-01-01' THEN timestamps END AS t, CAST(NULL AS DOUBLE) AS v FROM trail_events
UNION ALL SELECT '_index', _index, CAST(NULL AS TIMESTAMP), CASE WHEN NOT isnan(value) AND value <> 0 THEN value END FROM frame_cells"""

ORACLE: dict[str, str] = {
    "p3_found": f"SELECT first_r_idx, last_r_idx FROM ({_SESSIONS}) x",
    "p3_sessions": _SESSIONS,
    "p5_features": f"""WITH {_KNOWN},
facts AS (SELECT uuids, COUNT(*) AS n_events, max(timestamps) AS last_at, {", ".join(f"COUNT(*) FILTER (c_idx = {t}) AS c_{t}" for t in _types())} FROM known GROUP BY uuids)
SELECT t.uuids, COALESCE(f.n_events, 0) AS n_events, last_at, CAST({_LATEST} - epoch_us(last_at) AS DOUBLE) / 1e6 AS seconds_since_last, {", ".join(f"COALESCE(c_{t}, 0) AS c_{t}" for t in _types())} FROM trails t LEFT JOIN facts f ON t.uuids = f.uuids""",
    "p5_totals": f"""WITH {_KNOWN}, pairs AS (SELECT uuids, c_idx, COUNT(*) AS n, max(timestamps) AS last_at FROM known GROUP BY uuids, c_idx)
SELECT t.uuids, k.c_idx, COALESCE(p.n, 0) AS n, p.last_at FROM trails t CROSS JOIN (SELECT c_idx FROM trail_cols WHERE c_idx IS NOT NULL) k LEFT JOIN pairs p ON p.uuids = t.uuids AND p.c_idx = k.c_idx""",
    "p7_key_totals": f"SELECT key_field, key_value, COUNT(*) AS n_rows, COUNT(t) AS n_timed, min(t) AS first_at, max(t) AS last_at, COUNT(v) AS n_values, SUM(v) AS total FROM ({_KEYS}) r GROUP BY key_field, key_value",
    "p7_found": f"SELECT key_field, key_value FROM (SELECT key_field, key_value, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY key_field) AS n_all FROM ({_KEYS}) r GROUP BY key_field, key_value) q WHERE key_value IS NOT NULL AND n * 50 >= n_all",
}
