"""Queries over the driver's tables for the sparse frame, one for each operation, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.frame import SparseFrame, concat, event_matrix, one_hot, vstack
from cellweave.plans import new_path
from cellweave.sources import division_bounds

Query = Callable[[SparkSession, str], DataFrame]
KINDS = ["click", "error", "purchase", "signup", "view"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hot(spark: SparkSession, sf_dir: str, index: list[str], categories: list[str] = KINDS) -> SparseFrame:
    return one_hot(_table(spark, sf_dir, "events"), "event_type", categories, index, order_by=["event_id"])


def _by_user(spark: SparkSession, sf_dir: str) -> SparseFrame:
    return _hot(spark, sf_dir, ["user_id", "ts"])


def _orders(spark: SparkSession, sf_dir: str, status: str, name: str) -> SparseFrame:
    """Orders of a status for each customer: a frame with one column and unique keys."""
    rows = _table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"), F.lit(1.0).alias(name))
    return SparseFrame.from_wide(rows, "k").groupby_sum()


def _join(how: str) -> Query:
    return lambda spark, d: _orders(spark, d, "F", "n_f").join(_orders(spark, d, "P", "n_p"), how=how).to_wide()


def _add(how: str) -> Query:
    return lambda spark, d: _orders(spark, d, "F", "n").add(_orders(spark, d, "P", "n"), how=how).to_wide()


def _join_dup(spark: SparkSession, d: str) -> DataFrame:
    prices = SparseFrame.from_wide(_table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price")), "k")
    balances = SparseFrame.from_wide(_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "k")
    return prices.join(balances, how="inner").to_wide()


def _concat(spark: SparkSession, d: str) -> DataFrame:
    balances = SparseFrame.from_wide(_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "k")
    return concat([_orders(spark, d, "F", "n_f"), _orders(spark, d, "P", "n_p"), balances], axis=1).to_wide()


def _same(spark: SparkSession, d: str) -> DataFrame:
    pair = _by_user(spark, d)[["click", "error"]]
    return pair.join(pair).to_wide()


def _stack(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events")
    parts = [one_hot(events.filter(F.col("event_id") % 2 == r), "event_type", KINDS, ["user_id", "ts"], order_by=["event_id"]) for r in (0, 1)]
    return vstack(parts).to_wide()


def _high_k(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    return SparseFrame.from_long(rows, "l_suppkey", "l_partkey", "l_quantity").groupby_sum().to_long("l_partkey", "value")


def _level(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")
    frame = SparseFrame.from_wide(rows.groupBy("l_orderkey", "l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).sum("l_quantity"), ["l_orderkey", "l_suppkey"], ["A", "N", "R"])
    return frame.groupby_sum(level=1).to_long("l_returnflag", "qty")


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events")
    frame = event_matrix(events, "user_id", "ts", "event_type", order_by=["event_id"])
    return frame.set_index(idx=F.struct("user_id", "ts")).to_long().select("idx.user_id", "idx.ts", "col", "value")


def _positions(pick: Callable[[SparseFrame], SparseFrame]) -> Query:
    return lambda spark, d: pick(_hot(spark, d, ["event_id"])).to_wide().select("event_id")


def _from_orders(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("double"))
    rows = _table(spark, d, "orders").select(key.alias("o_custkey"), "o_totalprice")
    return SparseFrame.from_wide(rows, "o_custkey").dropna().to_wide()


def _dedup(keep: str | bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        by = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
        out = SparseFrame.from_wide(rows, "l_orderkey", order_by=by).drop_duplicate_idx(keep=keep).to_wide()
        return out.select("l_orderkey", *(F.col(c).cast(rows.schema[c].dataType) for c in by))

    return run


def _rounded(op: str, digits: int | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = _by_user(spark, d).reduced(op, 0)
        return out.select(*(F.round(c, digits).alias(c) if digits else F.col(c) for c in out.columns))

    return run


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    frame = _by_user(spark, d)
    ids = _table(spark, d, "events").orderBy("event_id").select(F.col("event_id").cast("double"))
    return frame.assign(eid=ids.toArrow().column(0).to_numpy()).to_wide()  # the array is the operand


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "frame")
    _by_user(spark, d).to_parquet(path)
    return SparseFrame.read_parquet(path, spark).to_wide()


def _pandas(spark: SparkSession, d: str) -> DataFrame:
    local = _table(spark, d, "customer").select("c_custkey", "c_acctbal").toPandas().set_index("c_custkey")  # a local table is the operand
    return SparseFrame.from_pandas(local, npartitions=4, spark=spark).to_wide()


def _double(spark: SparkSession, d: str) -> DataFrame:
    def twice(pdf):
        return pdf.assign(**{k: pdf[k] * 2 for k in KINDS})

    return _hot(spark, d, ["event_id"]).map_partitions(twice).to_wide()


def _shape(spark: SparkSession, d: str) -> DataFrame:
    frame = _by_user(spark, d)
    rows = frame.to_wide().agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.withColumn("n_cols", F.lit(len(frame.columns)).cast("bigint"))


QUERIES: dict[str, Query] = {
    "one_hot": lambda s, d: _by_user(s, d).to_wide(),
    "one_hot_extra": lambda s, d: _hot(s, d, ["user_id", "ts"], [*KINDS, "refund"]).to_wide(),
    "event_matrix": _matrix,
    "groupby_index": lambda s, d: _hot(s, d, ["user_id"]).groupby_sum().to_wide(),
    "groupby_by": lambda s, d: _by_user(s, d).groupby_sum(by=F.col("ts").cast("date")).rename_index("day").to_wide(),
    "groupby_level": _level,
    "groupby_high_k": _high_k,
    "join_outer": _join("outer"),
    "join_inner": _join("inner"),
    "join_left": _join("left"),
    "join_right": _join("right"),
    "join_dup": _join_dup,
    "join_same": _same,
    "concat_axis1": _concat,
    "add_outer": _add("outer"),
    "add_inner": _add("inner"),
    "vstack": _stack,
    "getitem": lambda s, d: _by_user(s, d)[["view", "click"]].to_wide(),
    "take_cols": lambda s, d: _by_user(s, d).take([0, 2], axis=1).to_wide(),
    "rename": lambda s, d: _by_user(s, d).rename(lambda c: c + "_new").to_wide(),
    "assign_scalar": lambda s, d: _by_user(s, d).assign(one=1).to_wide(),
    "assign_array": _assigned,
    "loc_label": lambda s, d: _by_user(s, d).loc[7].to_wide(),
    "loc_slice": lambda s, d: _by_user(s, d).loc[3:9].to_wide(),
    "loc_dates": lambda s, d: _hot(s, d, ["ts"]).loc["2024-01-15":"2024-01-17"].to_wide(),
    "loc_multi": lambda s, d: _hot(s, d, ["ts", "user_id"]).loc["2024-01-10"].to_wide(),
    "loc_bool": lambda s, d: (f := _by_user(s, d)).loc[f.index > 2].to_wide(),
    "loc_list": lambda s, d: _by_user(s, d).loc[[2, 5]].to_wide(),
    "iloc_slice": _positions(lambda f: f.iloc[10:20]),
    "iloc_list": _positions(lambda f: f.iloc[[3, 4, 7]]),
    "head": _positions(lambda f: f.head_frame(5)),
    "dropna": _from_orders,
    "dedup_first": _dedup("first"),
    "dedup_last": _dedup("last"),
    "dedup_none": _dedup(False),
    "set_index_col": lambda s, d: _by_user(s, d).set_index(column="click").rename_index("idx").to_wide(),
    "set_index_level": lambda s, d: _by_user(s, d).set_index(level=0).rename_index("idx").to_wide(),
    "set_index_idx": lambda s, d: _hot(s, d, ["event_id"]).set_index(idx=F.col("event_id")).to_wide(),
    "sort_index": lambda s, d: _by_user(s, d).sort_index().to_wide(),
    "sum_all": lambda s, d: _by_user(s, d).reduced("sum").withColumnRenamed("value", "total"),
    "sum_cols": _rounded("sum"),
    "sum_rows": lambda s, d: _hot(s, d, ["event_id"]).reduced("sum", 1).withColumnRenamed("value", "total"),
    "mean_cols": _rounded("mean", 6),
    "max_cols": _rounded("max"),
    "min_cols": _rounded("min"),
    "std_cols": _rounded("std", 6),
    "nnz": lambda s, d: _by_user(s, d).nnz_frame(),
    "shape": _shape,
    "todense": lambda s, d: _hot(s, d, ["event_id"]).to_wide(),
    "construct_wide": lambda s, d: SparseFrame(_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).to_wide(),
    "roundtrip": _roundtrip,
    "from_pandas": _pandas,
    "map_partitions": _double,
    "divisions_check": lambda s, d: division_bounds(_table(s, d, "nation"), "n_regionkey", "n_nationkey"),
}

_HOT = ", ".join(f"CAST(event_type = '{k}' AS DOUBLE) AS {k}" for k in KINDS)
_SUM = ", ".join(f"SUM(CAST(event_type = '{k}' AS DOUBLE)) AS {k}" for k in KINDS)
_ALL = ", ".join(KINDS)
_E = f"(SELECT event_id, user_id, ts, {_HOT} FROM events) e"
_F, _P = (f"(SELECT o_custkey AS k, CAST(COUNT(*) AS DOUBLE) AS {n} FROM orders WHERE o_orderstatus = '{s}' GROUP BY o_custkey)" for s, n in (("F", "n_f"), ("P", "n_p")))
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _rows(columns: str = f"user_id, ts, {_ALL}", where: str = "") -> str:
    return f"SELECT {columns} FROM {_E}{where and ' WHERE ' + where}"


def _joined(kind: str) -> str:
    return f"SELECT COALESCE(a.k, b.k) AS k, COALESCE(a.n_f, 0.0e0) AS n_f, COALESCE(b.n_p, 0.0e0) AS n_p FROM {_F} a {kind} JOIN {_P} b ON a.k = b.k"


def _place(where: str) -> str:
    return f"SELECT event_id FROM (SELECT event_id, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS pos FROM events) p WHERE {where}"


def _once(way: str) -> str:
    return f"SELECT l_orderkey, {', '.join(_LINE)} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(f'{c} {way}' for c in _LINE)}) AS rn FROM lineitem) t WHERE rn = 1"


def _each(expression: str) -> str:
    return _rows(", ".join(f"{expression.format(k)} AS {k}" for k in KINDS))


ORACLE: dict[str, str] = {
    "one_hot": _rows(),
    "one_hot_extra": f"SELECT user_id, ts, {_HOT}, CAST(event_type = 'refund' AS DOUBLE) AS refund FROM events",
    "event_matrix": "SELECT user_id, ts, event_type AS col, CAST(1 AS DOUBLE) AS value FROM events",
    "groupby_index": f"SELECT user_id, {_SUM} FROM events GROUP BY user_id",
    "groupby_by": f"SELECT CAST(ts AS DATE) AS day, {_SUM} FROM events GROUP BY CAST(ts AS DATE)",
    "groupby_level": "SELECT l_suppkey, l_returnflag, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey, l_returnflag",
    "groupby_high_k": "SELECT l_suppkey, l_partkey, SUM(l_quantity) AS value FROM lineitem GROUP BY l_suppkey, l_partkey",
    "join_outer": _joined("FULL OUTER"),
    "join_inner": _joined("INNER"),
    "join_left": _joined("LEFT"),
    "join_right": _joined("RIGHT"),
    "join_dup": "SELECT o.o_custkey AS k, o.o_totalprice AS price, c.c_acctbal AS bal FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_same": _rows("user_id, ts, click, error, click AS click_2, error AS error_2"),
    "concat_axis1": f"SELECT COALESCE(a.k, b.k, c.c_custkey) AS k, COALESCE(a.n_f, 0.0e0) AS n_f, COALESCE(b.n_p, 0.0e0) AS n_p, COALESCE(c.c_acctbal, 0.0e0) AS bal FROM {_F} a FULL OUTER JOIN {_P} b ON a.k = b.k FULL OUTER JOIN customer c ON COALESCE(a.k, b.k) = c.c_custkey",
    "add_outer": f"SELECT COALESCE(a.k, b.k) AS k, COALESCE(a.n_f, 0.0e0) + COALESCE(b.n_p, 0.0e0) AS n FROM {_F} a FULL OUTER JOIN {_P} b ON a.k = b.k",
    "add_inner": f"SELECT a.k AS k, a.n_f + b.n_p AS n FROM {_F} a INNER JOIN {_P} b ON a.k = b.k",
    "vstack": _rows(where="event_id % 2 = 0") + " UNION ALL " + _rows(where="event_id % 2 = 1"),
    "getitem": _rows("user_id, ts, view, click"),
    "take_cols": _rows("user_id, ts, click, purchase"),
    "rename": _rows("user_id, ts, " + ", ".join(f"{k} AS {k}_new" for k in KINDS)),
    "assign_scalar": _rows(f"user_id, ts, {_ALL}, CAST(1 AS DOUBLE) AS one"),
    "assign_array": _rows(f"user_id, ts, {_ALL}, CAST(event_id AS DOUBLE) AS eid"),
    "loc_label": _rows(where="user_id = 7"),
    "loc_slice": _rows(where="user_id BETWEEN 3 AND 9"),
    "loc_dates": _rows(f"ts, {_ALL}", "ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-18'"),
    "loc_multi": _rows(f"ts, user_id, {_ALL}", "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'"),
    "loc_bool": _rows(where="user_id > 2"),
    "loc_list": _rows(where="user_id IN (2, 5)"),
    "iloc_slice": _place("pos >= 10 AND pos < 20"),
    "iloc_list": _place("pos IN (3, 4, 7)"),
    "head": _place("pos < 5"),
    "dropna": "SELECT CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0",
    "dedup_first": _once("ASC"),
    "dedup_last": _once("DESC"),
    "dedup_none": f"SELECT l_orderkey, {', '.join(_LINE)} FROM (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) t WHERE c = 1",
    "set_index_col": _rows(f"click AS idx, {_ALL}"),
    "set_index_level": _rows(f"user_id AS idx, {_ALL}"),
    "set_index_idx": _rows(f"event_id AS idx, {_ALL}"),
    "sort_index": _rows(),
    "sum_all": "SELECT CAST(COUNT(*) AS DOUBLE) AS total FROM events",
    "sum_cols": _each("SUM({})"),
    "sum_rows": _rows("event_id, " + " + ".join(KINDS) + " AS total"),
    "mean_cols": _each("ROUND(SUM({}) / COUNT(*), 6)"),
    "max_cols": _each("MAX({})"),
    "min_cols": _each("MIN({})"),
    "std_cols": _each("ROUND(STDDEV_POP({}), 6)"),
    "nnz": _rows("CAST(" + " + ".join(f"SUM(CAST({k} <> 0 AS INTEGER))" for k in KINDS) + " AS BIGINT) AS nnz"),
    "shape": "SELECT COUNT(*) AS n_rows, CAST(5 AS BIGINT) AS n_cols FROM events",
    "todense": _rows(f"event_id, {_ALL}"),
    "construct_wide": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
    "roundtrip": _rows(),
    "from_pandas": "SELECT c_custkey, c_acctbal FROM customer",
    "map_partitions": _rows("event_id, " + ", ".join(f"{k} * 2 AS {k}" for k in KINDS)),
    "divisions_check": "SELECT n_regionkey, MIN(n_nationkey) AS istart, MAX(n_nationkey) AS istop FROM nation GROUP BY n_regionkey",
}
