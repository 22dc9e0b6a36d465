"""Queries over the driver's tables for frames of hundreds and thousands of labels, for archives and for keys that
are null or NaN, and their SQL. Cells are compared in long form, as (index, col, value) of those that aren't 0."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.frame import SparseFrame, concat, one_hot, vstack
from cellweave.plans import new_path
from cellweave.sources import check_sorted

Query = Callable[[SparkSession, str], DataFrame]
#: Added to the labels of a second frame, so that both are told apart.
APART = 1_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, d: str) -> list[int]:
    return _table(spark, d, "part").select("p_partkey").orderBy("p_partkey").toArrow().column(0).to_pylist()  # the labels


def _rows(spark: SparkSession, d: str, where: str = "TRUE") -> SparseFrame:
    """A row for each lineitem with 1 at its part; the order key is the index, so keys repeat."""
    lines = _table(spark, d, "lineitem").filter(where)
    return one_hot(lines, "l_partkey", _parts(spark, d), "l_orderkey", order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def _sold(spark: SparkSession, d: str, flag: str) -> SparseFrame:
    """Quantities of each supplier (index) and part (label) of the lineitems of a flag."""
    lines = _table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select("l_suppkey", "l_partkey", "l_quantity")
    return SparseFrame.from_long(lines, "l_suppkey", "l_partkey", "l_quantity", _parts(spark, d))


def _bulk(spark: SparkSession, d: str) -> SparseFrame:
    """Quantities of all lineitems by supplier and part, with sums of both signs and of very different size."""
    lines = _table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_quantity") - 25 + 1e9 * (F.col("l_suppkey") % 2)).alias("q"))
    return SparseFrame.from_long(lines, "l_suppkey", "l_partkey", "q", _parts(spark, d))


def _picked(pick: Callable[[SparseFrame], SparseFrame]) -> Query:
    return lambda s, d: pick(_rows(s, d)).to_long()


def _joined(how: str) -> Query:
    return lambda s, d: _sold(s, d, "A").join(_sold(s, d, "R").rename(lambda c: c + APART), how=how).to_long()


def _added(how: str) -> Query:
    return lambda s, d: _sold(s, d, "A").add(_sold(s, d, "R"), how=how).to_long()


def _by_label(op: str, digits: int) -> Query:
    return lambda s, d: _bulk(s, d).reduced(op, 0, shape="long").select("column", (F.round("value", digits) + 0.0).alias("value"))


def _by_row(op: str, digits: int) -> Query:
    return lambda s, d: _bulk(s, d).reduced(op, 1).select("l_suppkey", (F.round("value", digits) + 0.0).alias("value"))


def _of_all(op: str, digits: int) -> Query:
    return lambda s, d: _bulk(s, d).reduced(op).select((F.round("value", digits) + 0.0).alias("total"))


def _missing_keys(spark: SparkSession, d: str, status: str, name: str) -> SparseFrame:
    """Orders of a status by a key that is NaN for a third of them and null for another third."""
    key = F.when(F.col("o_custkey") % 3 == 0, F.lit(float("nan"))).when(F.col("o_custkey") % 3 == 1, F.col("o_custkey").cast("double"))
    return SparseFrame.from_wide(_table(spark, d, "orders").filter(F.col("o_orderstatus") == status).select(key.alias("k"), F.lit(1.0).alias(name)), "k")


def _dropped(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey").cast("double"))
    lines = _table(spark, d, "lineitem").select(key.alias("k"), "l_partkey")
    return one_hot(lines, "l_partkey", _parts(spark, d), "k").dropna().to_long()


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "frame")
    _rows(spark, d).to_parquet(path)
    return SparseFrame.read_parquet(path, spark).to_long()


def _archived(spark: SparkSession, d: str) -> SparseFrame:
    """Three archives of suppliers, written and read again. An archive is a local file, so this is for one machine."""
    import os

    path = new_path(spark, "archives").removeprefix("file://")
    os.makedirs(path)
    frame = _sold(spark, d, "A")
    frame = frame.groupby_sum().rename_index("l_suppkey")
    for i, (low, high) in enumerate(((None, 20), (21, 50), (51, None))):
        frame.loc[low:high].sort_index().to_npz(f"{path}/{i}.npz")
    return SparseFrame.read_npz(f"file://{path}/*.npz", spark, sorted=True).rename_index("l_suppkey")


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Sums of a partition, of which each key's rows lie in one: right only if the function sees it whole."""
    lines = _table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice").repartition(2, "l_suppkey")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby("l_suppkey", as_index=False).agg(n=("l_quantity", "size"), l_quantity=("l_quantity", "sum"))

    return SparseFrame.from_wide(lines, "l_suppkey").map_partitions(total, meta=["n", "l_quantity"]).to_wide()


def _batches(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    return SparseFrame.from_wide(lines, "l_suppkey").map_batches(lambda pdf: pdf.assign(l_quantity=pdf.l_quantity * 2)).to_wide()


def _leveled(spark: SparkSession, d: str) -> DataFrame:
    lines = SparseFrame.from_wide(_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])
    prices = SparseFrame.from_wide(_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), "k")
    return lines.join(prices, level=0, how="left").to_wide()


def _customers(spark: SparkSession, d: str) -> SparseFrame:
    return SparseFrame.from_wide(_table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation")), "c_custkey")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """All rows through the driver, which is what todense does."""
    return spark.createDataFrame(_customers(spark, d).todense().reset_index())


def _set(spark: SparkSession, d: str) -> DataFrame:
    frame = _customers(spark, d)
    frame["one"] = 1
    return frame.to_wide()


def _flags(spark: SparkSession, d: str) -> DataFrame:
    frame = _customers(spark, d)
    return frame.loc[np.arange(frame.shape[0]) % 3 == 0].to_wide()


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    """Key ranges of files that really lie there: one for each region."""
    path = new_path(spark, "nations")
    nations = _table(spark, d, "nation").withColumn("key", F.col("n_regionkey") * 1000 + F.col("n_nationkey"))
    nations.repartition(1).write.partitionBy("n_regionkey").parquet(path)
    return check_sorted(spark.read.parquet(path), "key").select("istart", "istop")


QUERIES: dict[str, Query] = {
    "map_one_hot": lambda s, d: _rows(s, d).to_long(),
    "map_groupby": lambda s, d: _rows(s, d).groupby_sum().to_long(),
    "map_groupby_by": lambda s, d: _rows(s, d).groupby_sum(by=F.col("l_orderkey") % 10).rename_index("k").to_long(),
    "map_dedup_first": _picked(lambda f: f.drop_duplicate_idx("first")),
    "map_dedup_last": _picked(lambda f: f.drop_duplicate_idx("last")),
    "map_dedup_none": _picked(lambda f: f.drop_duplicate_idx(False)),
    "map_vstack": lambda s, d: vstack([_rows(s, d, "l_linenumber % 2 = 0"), _rows(s, d, "l_linenumber % 2 = 1")]).to_long(),
    "map_iloc": _picked(lambda f: f.iloc[5:500:7]),
    "map_iloc_list": _picked(lambda f: f.iloc[[3, 11, 4000]]),
    "map_iloc_end": _picked(lambda f: f.iloc[-10:]),
    "map_head": _picked(lambda f: f.head_frame(25)),
    "map_loc": _picked(lambda f: f.loc[10:50]),
    "map_loc_list": _picked(lambda f: f.loc[[7, 3, 7]]),
    "map_loc_bool": _picked(lambda f: f.loc[f.index % 5 == 0]),
    "map_getitem": _picked(lambda f: f[[30, 10, 20]]),
    "map_take_cols": _picked(lambda f: f.take([0, -1, 5], axis=1)),
    "map_rename": _picked(lambda f: f.rename(lambda c: c + APART)),
    "map_assign": _picked(lambda f: f.assign(two=2)),
    "map_set_index_col": _picked(lambda f: f.set_index(column=10).rename_index("idx")),
    "map_set_index_idx": _picked(lambda f: f.set_index(idx=F.col("l_orderkey") * 2)),
    "map_sort_index": _picked(lambda f: f.sort_index()),
    "map_dropna": _dropped,
    "map_roundtrip": _round_trip,
    "map_values": lambda s, d: _rows(s, d).values,
    "map_nnz": lambda s, d: _bulk(s, d).nnz_frame(),
    "map_join_outer": _joined("outer"),
    "map_join_inner": _joined("inner"),
    "map_join_left": _joined("left"),
    "map_join_right": _joined("right"),
    "map_add_outer": _added("outer"),
    "map_add_inner": _added("inner"),
    "map_add_left": _added("left"),
    "map_concat": lambda s, d: concat([_sold(s, d, "A"), _sold(s, d, "R").rename(lambda c: c + APART), _sold(s, d, "N").rename(lambda c: c + 2 * APART)], axis=1).to_long(),
    "map_sum_cols": _by_label("sum", 2),
    "map_mean_cols": _by_label("mean", 2),
    "map_std_cols": _by_label("std", 2),
    "map_max_cols": _by_label("max", 2),
    "map_min_cols": _by_label("min", 2),
    "map_sum_rows": _by_row("sum", 2),
    "map_mean_rows": _by_row("mean", 2),
    "map_std_rows": _by_row("std", 2),
    "map_max_rows": _by_row("max", 2),
    "map_min_rows": _by_row("min", 2),
    "map_sum_all": _of_all("sum", 2),
    "map_std_all": _of_all("std", 1),
    "std_all": lambda s, d: SparseFrame.from_wide(_table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1e9).alias("v")), "o_orderkey").reduced("std").select(F.round("value", 6).alias("total")),
    "join_missing": lambda s, d: _missing_keys(s, d, "F", "n_f").groupby_sum().join(_missing_keys(s, d, "P", "n_p").groupby_sum()).to_wide(),
    "join_nan": lambda s, d: _missing_keys(s, d, "P", "n_p").join(_missing_keys(s, d, "F", "n_f").groupby_sum(), how="left").to_wide(),
    "add_null": lambda s, d: _missing_keys(s, d, "F", "n").groupby_sum().add(_missing_keys(s, d, "P", "n").groupby_sum()).to_wide(),
    "add_null_inner": lambda s, d: _missing_keys(s, d, "F", "n").groupby_sum().add(_missing_keys(s, d, "P", "n").groupby_sum(), how="inner").to_wide(),
    "roundtrip_npz": lambda s, d: _archived(s, d).to_long(),
    "map_whole_partition": _whole,
    "map_batches": _batches,
    "join_axis0": lambda s, d: (f := _customers(s, d)).join(f, axis=0).to_wide(),
    "join_level": _leveled,
    "todense_local": _dense,
    "setitem": _set,
    "loc_array": _flags,
    "file_bounds": _bounds,
}

_ONE = "CAST(1 AS DOUBLE) AS value"
_EACH = f"SELECT l_orderkey, l_partkey AS col, {_ONE} FROM lineitem"
_PLACED = f"SELECT l_orderkey, l_partkey AS col, {_ONE}, ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos, COUNT(*) OVER () AS n FROM lineitem"
_SUMS = "SELECT l_suppkey, l_partkey AS col, SUM(l_quantity) AS value FROM lineitem WHERE l_returnflag = '{}' GROUP BY ALL HAVING value <> 0"
_BULK = "b AS (SELECT l_suppkey, l_partkey, SUM(l_quantity - 25 + 1e9 * (l_suppkey % 2)) AS q FROM lineitem GROUP BY ALL), s AS (SELECT DISTINCT l_suppkey FROM lineitem), cells AS (SELECT s.l_suppkey, p.p_partkey AS col, COALESCE(b.q, 0) AS q FROM s CROSS JOIN part p LEFT JOIN b ON b.l_suppkey = s.l_suppkey AND b.l_partkey = p.p_partkey)"
_CALLS = {"sum": "SUM(q)", "mean": "AVG(q)", "std": "STDDEV_POP(q)", "max": "MAX(q)", "min": "MIN(q)"}
_KEY = "CASE WHEN o_custkey % 3 = 0 THEN CAST('nan' AS DOUBLE) WHEN o_custkey % 3 = 1 THEN CAST(o_custkey AS DOUBLE) END"
_COUNTED = f"f AS (SELECT {_KEY} AS k, CAST(COUNT(*) AS DOUBLE) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT {_KEY} AS k, CAST(COUNT(*) AS DOUBLE) AS n_p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)"


def _at(where: str) -> str:
    return f"SELECT l_orderkey, col, value FROM ({_PLACED}) x WHERE {where}"


def _once(way: str) -> str:
    by = ", ".join(f"{c} {way}" for c in ("l_linenumber", "l_partkey", "l_suppkey"))
    return f"SELECT l_orderkey, col, value FROM (SELECT l_orderkey, l_partkey AS col, {_ONE}, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {by}) AS rn FROM lineitem) x WHERE rn = 1"


def _both(on: str) -> str:
    """Cells of both sides of the suppliers that a join keeps."""
    return f"WITH a AS ({_SUMS.format('A')}), r AS ({_SUMS.format('R')}), k AS ({on}) SELECT a.* FROM a JOIN k USING (l_suppkey) UNION ALL SELECT r.l_suppkey, r.col + {APART} AS col, r.value FROM r JOIN k USING (l_suppkey)"


def _total(on: str) -> str:
    return f"WITH a AS ({_SUMS.format('A')}), r AS ({_SUMS.format('R')}), k AS ({on}), c AS (SELECT * FROM a UNION ALL SELECT * FROM r) SELECT c.l_suppkey, c.col, SUM(c.value) AS value FROM c JOIN k USING (l_suppkey) GROUP BY ALL"


_OUTER, _INNER, _LEFT, _RIGHT = "SELECT l_suppkey FROM a UNION SELECT l_suppkey FROM r", "SELECT l_suppkey FROM a INTERSECT SELECT l_suppkey FROM r", "SELECT DISTINCT l_suppkey FROM a", "SELECT DISTINCT l_suppkey FROM r"

ORACLE: dict[str, str] = {
    "map_one_hot": _EACH,
    "map_groupby": "SELECT l_orderkey, l_partkey AS col, CAST(COUNT(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL",
    "map_groupby_by": "SELECT l_orderkey % 10 AS k, l_partkey AS col, CAST(COUNT(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL",
    "map_dedup_first": _once("ASC"),
    "map_dedup_last": _once("DESC"),
    "map_dedup_none": f"SELECT l_orderkey, col, value FROM (SELECT l_orderkey, l_partkey AS col, {_ONE}, COUNT(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) x WHERE c = 1",
    "map_vstack": _EACH,
    "map_iloc": _at("pos >= 5 AND pos < 500 AND (pos - 5) % 7 = 0"),
    "map_iloc_list": _at("pos IN (3, 11, 4000)"),
    "map_iloc_end": _at("pos >= n - 10"),
    "map_head": _at("pos < 25"),
    "map_loc": f"{_EACH} WHERE l_orderkey BETWEEN 10 AND 50",
    "map_loc_list": f"{_EACH} WHERE l_orderkey = 3 UNION ALL {_EACH} WHERE l_orderkey = 7 UNION ALL {_EACH} WHERE l_orderkey = 7",
    "map_loc_bool": f"{_EACH} WHERE l_orderkey % 5 = 0",
    "map_getitem": f"{_EACH} WHERE l_partkey IN (10, 20, 30)",
    "map_take_cols": f"{_EACH} WHERE l_partkey IN (SELECT p_partkey FROM (SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY p_partkey) AS place, COUNT(*) OVER () AS n FROM part) x WHERE place IN (1, 6, n))",
    "map_rename": f"SELECT l_orderkey, l_partkey + {APART} AS col, {_ONE} FROM lineitem",
    "map_assign": f"SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS col, {_ONE} FROM lineitem UNION ALL SELECT l_orderkey, 'two', 2 FROM lineitem",
    "map_set_index_col": f"SELECT CAST(l_partkey = 10 AS DOUBLE) AS idx, l_partkey AS col, {_ONE} FROM lineitem",
    "map_set_index_idx": f"SELECT l_orderkey * 2 AS idx, l_partkey AS col, {_ONE} FROM lineitem",
    "map_sort_index": _EACH,
    "map_dropna": f"SELECT CAST(l_orderkey AS DOUBLE) AS k, l_partkey AS col, {_ONE} FROM lineitem WHERE l_orderkey % 3 <> 0",
    "map_roundtrip": _EACH,
    "map_values": _EACH,
    "map_nnz": f"WITH {_BULK} SELECT COUNT(*) AS nnz FROM cells WHERE q <> 0",
    "map_join_outer": _both(_OUTER),
    "map_join_inner": _both(_INNER),
    "map_join_left": _both(_LEFT),
    "map_join_right": _both(_RIGHT),
    "map_add_outer": _total(_OUTER),
    "map_add_inner": _total(_INNER),
    "map_add_left": _total(_LEFT),
    "map_concat": f"{_SUMS.format('A')} UNION ALL SELECT l_suppkey, col + {APART}, value FROM ({_SUMS.format('R')}) x UNION ALL SELECT l_suppkey, col + 2 * {APART}, value FROM ({_SUMS.format('N')}) y",
    **{f"map_{op}_cols": f'WITH {_BULK} SELECT col AS "column", ROUND({call}, 2) + 0.0e0 AS value FROM cells GROUP BY col' for op, call in _CALLS.items()},
    **{f"map_{op}_rows": f"WITH {_BULK} SELECT l_suppkey, ROUND({call}, 2) + 0.0e0 AS value FROM cells GROUP BY l_suppkey" for op, call in _CALLS.items()},
    "map_sum_all": f"WITH {_BULK} SELECT ROUND(SUM(q), 2) AS total FROM cells",
    "map_std_all": f"WITH {_BULK} SELECT ROUND(STDDEV_POP(q), 1) AS total FROM cells",
    "std_all": "SELECT ROUND(STDDEV_POP(o_orderkey % 7), 6) AS total FROM orders",
    "join_missing": f"WITH {_COUNTED} SELECT COALESCE(f.k, p.k) AS k, COALESCE(n_f, 0) AS n_f, COALESCE(n_p, 0) AS n_p FROM f FULL OUTER JOIN p ON f.k IS NOT DISTINCT FROM p.k",
    "join_nan": f"WITH {_COUNTED}, o AS (SELECT {_KEY} AS k FROM orders WHERE o_orderstatus = 'P') SELECT o.k, CAST(1 AS DOUBLE) AS n_p, COALESCE(n_f, 0) AS n_f FROM o LEFT JOIN f ON f.k IS NOT DISTINCT FROM o.k",
    "add_null": f"WITH {_COUNTED} SELECT COALESCE(f.k, p.k) AS k, COALESCE(n_f, 0) + COALESCE(n_p, 0) AS n FROM f FULL OUTER JOIN p ON f.k IS NOT DISTINCT FROM p.k",
    "add_null_inner": f"WITH {_COUNTED} SELECT f.k, n_f + n_p AS n FROM f JOIN p ON f.k IS NOT DISTINCT FROM p.k",
    "roundtrip_npz": _SUMS.format("A"),
    "map_whole_partition": "SELECT l_suppkey, CAST(COUNT(*) AS DOUBLE) AS n, SUM(l_quantity) AS l_quantity FROM lineitem GROUP BY l_suppkey",
    "map_batches": "SELECT l_suppkey, l_quantity * 2 AS l_quantity FROM lineitem",
    "join_axis0": "SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation FROM customer UNION ALL SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) FROM customer",
    "join_level": "SELECT l_orderkey, l_linenumber, l_quantity, COALESCE(o_totalprice, 0) AS o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
    "todense_local": "SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation FROM customer",
    "setitem": "SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation, CAST(1 AS DOUBLE) AS one FROM customer",
    "loc_array": "SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) x WHERE pos % 3 = 0",
    "file_bounds": "SELECT MIN(n_regionkey * 1000 + n_nationkey) AS istart, MAX(n_regionkey * 1000 + n_nationkey) AS istop FROM nation GROUP BY n_regionkey",
}
