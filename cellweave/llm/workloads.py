"""Queries over the driver's tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import fold, is_set_time
from cellweave.plans import materialize
from cellweave.llm.distinct import distinct_counts, distinct_state, regrouped
from cellweave.llm.encoding import damage_report, repaired_texts
from cellweave.llm.packing import packed_containers
from cellweave.llm.pairs import co_occurrence, surprising
from cellweave.llm.runs import collapsed_runs
from cellweave.llm.subsequences import frequent_subsequences
from cellweave.llm.tokens import encode_corpus

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- problem 1: ordered patterns of columns


def p1_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_subsequences(table(spark, sf_dir, "trail_events"), table(spark, sf_dir, "trail_cols"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_patterns(spark, sf_dir).select("pattern")


# --- problem 2: distinct identifiers

_SETS = [(), ("ymd",), ("cols",), ("id",), ("ymd", "cols"), ("ymd", "id"), ("cols", "id"), ("ymd", "cols", "id")]


def _hits(spark: SparkSession, sf_dir: str, *groups: str) -> DataFrame:
    hits = table(spark, sf_dir, "clickstream")
    timed = hits.filter(is_set_time("timestamps", hits.schema["timestamps"].dataType.simpleString()))
    label = fold("cols")
    every = {"ymd": F.date_format("timestamps", "yyyyMMdd").cast("bigint"), "cols": F.when(label != "", label), "id": F.col("id")}
    return distinct_state(timed, fold("uuids"), {g: every[g] for g in groups})


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_counts(_hits(spark, sf_dir, "ymd", "cols", "id"), _SETS)


def p2_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _hits(spark, sf_dir, "ymd", "cols")
    monday = F.date_trunc("week", F.to_date(F.col("ymd").cast("string"), "yyyyMMdd")).cast("date")
    weeks = regrouped(days, {"week": monday, "cols": F.col("cols")})
    return distinct_counts(weeks, [("week",), ("week", "cols")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = distinct_counts(_hits(spark, sf_dir, "ymd", "cols"), [("ymd",), ("ymd", "cols")])
    of_day = F.max(F.when(F.col("grouping") == "ymd", F.col("n_distinct"))).over(Window.partitionBy("ymd"))
    share = counts.withColumn("n_day", of_day).filter("grouping = 'ymd+cols' AND n_distinct * 10 >= n_day * 3")
    return share.select("ymd", "cols")


# --- problem 4: runs of equal labels


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed_runs(table(spark, sf_dir, "trail_events"), table(spark, sf_dir, "trail_cols"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed_runs(table(spark, sf_dir, "trail_events"), table(spark, sf_dir, "trail_cols"), least=2).select("first_r_idx", "last_r_idx")


# --- problem 6: labels held together


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "frame_cells").filter("value IS NOT NULL AND NOT isnan(value) AND value <> 0")
    label = fold("cols")
    return co_occurrence(cells, F.col("uuids"), F.when(label != "", label))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("cols_a", "cols_b", "n_ab", "n_a", "n_b", "n", "ratio")


def p6_surprising(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialize(_pairs(spark, sf_dir), "surprise")
    items = pairs.select("cols_a").union(pairs.select("cols_b")).distinct().count()
    return surprising(pairs, items * (items - 1) // 2)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = "n_ab >= 5 AND n_ab * 1000 >= 3 * n AND n_ab * n >= 3 * n_a * n_b"
    return _pairs(spark, sf_dir).filter(cases).select("cols_a", "cols_b")


# --- problem 8: token ids


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


# --- problem 9: containers of 2,048 tokens


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_containers(encode_corpus(table(spark, sf_dir, "documents"), counts_only=True))


# --- problem 10: wrongly decoded texts


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_texts(table(spark, sf_dir, "documents")).filter("lost OR size(misread_as) > 0")


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_report(repaired_texts(table(spark, sf_dir, "documents")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_repaired(spark, sf_dir).select("doc_id")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_patterns": p1_patterns,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p2_weeks": p2_weeks,
    "p4_found": p4_found,
    "p4_collapsed": p4_collapsed,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p6_surprising": p6_surprising,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_repaired": p10_repaired,
    "p10_report": p10_report,
}


def _folded(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


_EVENTS = "SELECT r_idx, any_value(uuids) AS uuids, any_value(timestamps) AS timestamps, any_value(c_idx) AS c_idx FROM trail_events WHERE uuids IS NOT NULL AND r_idx IS NOT NULL AND timestamps IS NOT NULL AND timestamps <> TIMESTAMP '1970-01-01' GROUP BY r_idx"

_HITS = f"""SELECT {_folded('uuids')} AS u, CAST(strftime(timestamps, '%Y%m%d') AS BIGINT) AS ymd, CAST(date_trunc('week', CAST(timestamps AS DATE)) AS DATE) AS week, NULLIF({_folded('cols')}, '') AS cols, id
FROM clickstream WHERE uuids IS NOT NULL AND timestamps IS NOT NULL AND timestamps <> TIMESTAMP '1970-01-01'"""


def _count(groups: tuple[str, ...], every: tuple[str, ...]) -> str:
    kinds = {"ymd": "BIGINT", "cols": "VARCHAR", "id": "INTEGER", "week": "DATE"}
    cols = ", ".join(g if g in groups else f"CAST(NULL AS {kinds[g]}) AS {g}" for g in every)
    where = " AND ".join(f"{g} IS NOT NULL" for g in groups) or "TRUE"
    by = f" GROUP BY {', '.join(groups)}" if groups else ""
    return f"SELECT '{'+'.join(groups)}' AS grouping, {cols}, COUNT(DISTINCT u) AS n_distinct FROM h WHERE {where}{by}"


_RUNS = f"""WITH e AS ({_EVENTS}), k AS (SELECT c_idx, COALESCE({_folded('cols')}, '') AS label FROM trail_cols),
n AS (SELECT e.*, k.label FROM e LEFT JOIN k USING (c_idx)),
l AS (SELECT *, COALESCE(label = lag(label) OVER w AND timestamps - lag(timestamps) OVER w <= INTERVAL 600 SECOND, FALSE) AS same FROM n WINDOW w AS (PARTITION BY uuids ORDER BY timestamps, r_idx)),
s AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY uuids ORDER BY timestamps, r_idx) AS g FROM l)
SELECT uuids, any_value(label) AS label, arg_min(r_idx, (timestamps, r_idx)) AS first_r_idx, arg_max(r_idx, (timestamps, r_idx)) AS last_r_idx, min(timestamps) AS started_at, max(timestamps) AS ended_at,
  CAST(epoch_us(max(timestamps)) - epoch_us(min(timestamps)) AS DOUBLE) / 1e6 AS seconds, COUNT(*) AS n_events FROM s GROUP BY uuids, g"""

_PAIRS = f"""WITH b AS (SELECT DISTINCT uuids, {_folded('cols')} AS c FROM frame_cells WHERE uuids IS NOT NULL AND NOT isnan(value) AND value <> 0 AND {_folded('cols')} <> ''),
s AS (SELECT c, COUNT(*) AS n FROM b GROUP BY c), t AS (SELECT COUNT(DISTINCT uuids) AS n FROM b),
p AS (SELECT x.c AS cols_a, y.c AS cols_b, COUNT(*) AS n_ab FROM b x JOIN b y ON x.uuids = y.uuids AND x.c < y.c GROUP BY x.c, y.c)
SELECT cols_a, cols_b, n_ab, a.n AS n_a, z.n AS n_b, t.n AS n, n_ab * CAST(t.n AS DOUBLE) / (CAST(a.n AS DOUBLE) * z.n) AS ratio FROM p JOIN s a ON a.c = cols_a JOIN s z ON z.c = cols_b, t"""

ORACLE: dict[str, str] = {
    "p6_counts": _PAIRS,
    "p6_found": f"SELECT cols_a, cols_b FROM ({_PAIRS}) q WHERE n_ab >= 5 AND n_ab * 1000 >= 3 * n AND n_ab * n >= 3 * n_a * n_b",
    "p2_counts": f"WITH h AS ({_HITS}) " + " UNION ALL ".join(_count(s, ("ymd", "cols", "id")) for s in _SETS),
    "p2_weeks": f"WITH h AS ({_HITS}) " + " UNION ALL ".join(_count(s, ("week", "cols")) for s in (("week",), ("week", "cols"))),
    "p2_found": f"WITH h AS ({_HITS}) SELECT a.ymd, a.cols FROM (SELECT ymd, cols, COUNT(DISTINCT u) AS n FROM h WHERE cols IS NOT NULL GROUP BY ymd, cols) a JOIN (SELECT ymd, COUNT(DISTINCT u) AS n FROM h GROUP BY ymd) b ON a.ymd = b.ymd WHERE a.n * 10 >= b.n * 3",
    "p4_collapsed": _RUNS,
    "p4_found": f"SELECT first_r_idx, last_r_idx FROM ({_RUNS}) r WHERE n_events >= 2",
}
