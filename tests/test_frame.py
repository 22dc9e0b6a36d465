"""The sparse frame against dense NumPy and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.frame import SparseFrame, concat, event_matrix, one_hot, vstack
from cellweave.frame.indexing import period
from cellweave.frame.layout import LONG, MAP, WIDE


@pytest.fixture(scope="module")
def eye(spark):
    return lambda n, index=None, columns=None: SparseFrame(np.identity(n), index=index, columns=columns, spark=spark)


def dense(f):
    out = f.todense(pandas=False)
    return out[:, None] if out.ndim == 1 else out


def test_empty(spark):
    f = SparseFrame(np.array([]), index=[], columns=["A", "B"], spark=spark)
    assert f.shape == (0, 2) and f.nnz() == 0 and isinstance(repr(f), str)


def test_group_by_index(spark):
    rng = np.random.default_rng(0)
    rows = rng.permutation(np.tile(np.arange(10), 10))
    f = SparseFrame(np.identity(10)[rows], index=rows, spark=spark)
    assert np.array_equal(dense(f.groupby_sum()), 10 * np.identity(10))
    tile = rng.random((10, 10))
    g = SparseFrame(tile[rows], index=rows, spark=spark).groupby()
    assert np.allclose(dense(g), 10 * tile)


@pytest.mark.parametrize("k", [3, 100])
def test_group_keeps_zero_rows_and_null_keys(spark, k):
    data = np.zeros((4, k))
    data[0, 1] = 2
    f = SparseFrame(data, index=[1.0, 1.0, 2.0, float("nan")], spark=spark).groupby_sum()
    assert f._layout == (WIDE if k == 3 else LONG) and f.shape == (3, k) and f.nnz() == 1
    assert dense(f).sum() == 2


def test_group_by_level_label_array_and_column(spark):
    idx = pd.MultiIndex.from_tuples([("a", 1), ("a", 2), ("b", 1)], names=["x", "y"])
    f = SparseFrame(pd.DataFrame([[1, 0], [2, 1], [4, 0]], index=idx, columns=["p", "q"]), spark=spark)
    assert f.groupby_sum(level=0).todense().to_dict() == {"p": {"a": 3, "b": 4}, "q": {"a": 1, "b": 0}}
    assert f.groupby_sum(level=1).todense()["p"].to_dict() == {1: 5, 2: 2}
    assert f.groupby_sum().shape == (3, 2)
    assert f.groupby_sum(by="q").todense()["p"].to_dict() == {0.0: 5, 1.0: 2}
    assert f.groupby_sum(by=[7, 7, 8]).todense()["p"].to_dict() == {7: 3, 8: 4}
    assert f.groupby_sum(by=F.upper("x")).todense()["p"].to_dict() == {"A": 3, "B": 4}
    with pytest.raises(ValueError):
        f.groupby_sum(by=[1])
    with pytest.raises(ValueError):
        SparseFrame([[1]], spark=spark).groupby_sum(level=0)


def parts(spark):
    rng = np.random.default_rng(1)
    second, third = np.zeros((4, 10)), np.zeros((4, 10))
    second[np.arange(4), np.arange(2, 6)] = 10
    third[np.arange(4), np.arange(6, 10)] = 20
    out = []
    for data, index in ((np.identity(10), np.arange(10)), (second, np.arange(2, 6)), (third, np.arange(6, 10))):
        p = rng.permutation(len(index))
        out.append(SparseFrame(data[p], index=index[p], columns=list("abcdefghij"), spark=spark))
    return out


@pytest.mark.parametrize("how", ["outer", "inner", "left", "right"])
def test_join_matches_pandas(spark, how):
    a, b, _ = parts(spark)
    left, right = a.todense(), b.rename(str.upper).todense()
    want = left.join(right, how=how).fillna(0).sort_index()
    got = a.join(b.rename(str.upper), how=how).sort_index().todense()
    assert np.array_equal(got.to_numpy(), want.to_numpy()) and got.index.tolist() == want.index.tolist()


def test_join_layouts_agree(spark):
    rng = np.random.default_rng(2)
    x, y = (rng.random((5, 40)) * (rng.random((5, 40)) < 0.2) for _ in range(2))
    a, b = SparseFrame(x, index=[1, 2, 3, 4, 5], spark=spark), SparseFrame(y, index=[4, 5, 6, 7, 8], spark=spark)
    got = a.join(b)
    assert got._layout == MAP and got.shape == (8, 80)
    want = pd.DataFrame(x, index=range(1, 6)).join(pd.DataFrame(y, index=range(4, 9)), lsuffix="l", how="outer").fillna(0)
    assert np.allclose(got.sort_index().todense().to_numpy(), want.to_numpy())


def test_join_special(spark, eye):
    f = eye(10)
    assert np.array_equal(dense(f.join(f)), np.hstack([np.identity(10)] * 2))
    assert np.array_equal(dense(f.join(f, axis=0)), np.vstack([np.identity(10)] * 2))
    assert "Join" not in f.join(f).to_wide()._jdf.queryExecution().optimizedPlan().toString()
    a, b = eye(5, index=range(5)), eye(5, index=range(5, 10))
    assert np.array_equal(dense(a.join(b).sort_index()), np.identity(10))
    with pytest.raises(NotImplementedError):
        a.join(eye(4, columns=list("abcd")), axis=0)
    for bad in ({"axis": 2}, {"how": "cross"}):
        with pytest.raises(ValueError):
            a.join(b, **bad)
    dup = SparseFrame([[1], [2]], index=[1, 1], spark=spark)
    assert dup.join(SparseFrame([[1], [2]], index=[1, 1], spark=spark)).shape == (4, 2)
    empty = SparseFrame(np.zeros((0, 2)), index=[], columns=["x", "y"], spark=spark).set_index(idx=F.lit(1).cast("bigint"))
    assert a.join(empty).shape == (5, 7)
    multi = SparseFrame(pd.DataFrame({"v": [1, 2]}, index=pd.MultiIndex.from_tuples([("a", 1), ("b", 2)])), spark=spark)
    assert multi.join(SparseFrame(pd.DataFrame({"w": [5]}, index=["a"]), spark=spark), level=0, how="left").todense()["w"].tolist() == [5, 0]


def test_add(spark, eye):
    a, b, c = parts(spark)
    assert np.array_equal(dense(a.add(b).add(c).sort_index()), np.diag([1.0, 1, 11, 11, 11, 11, 21, 21, 21, 21]))
    x = SparseFrame(np.ones((3, 5)), index=[0, 1, 2], spark=spark)
    y = SparseFrame(np.ones((3, 5)), index=[2, 3, 4], spark=spark)
    want = np.ones((5, 5))
    want[2] = 2
    assert np.array_equal(dense(x.add(y).sort_index()), want)
    assert np.array_equal(dense(x.groupby_sum().add(y.groupby_sum()).sort_index()), want)
    assert x.add(y, how="inner").shape == (1, 5) and x.add(y, how="left").shape == (3, 5)
    big = SparseFrame(np.ones((2, 100)), index=[1, 2], spark=spark)
    assert dense(big.add(big, how="inner")).sum() == 400
    dup = SparseFrame([[1.0], [2.0]], index=[1, 1], spark=spark)
    assert sorted(dense(dup.add(SparseFrame([[10.0], [20.0]], index=[1, 1], spark=spark)))[:, 0]) == [11, 12, 21, 22]
    with pytest.raises(AssertionError):
        x.add(eye(5, columns=list("abcde")))


def test_stack_and_concat(spark, eye):
    f = vstack([eye(5)] * 10)
    assert np.array_equal(dense(f), np.vstack([np.identity(5)] * 10))
    with pytest.raises(AssertionError):
        vstack([eye(5), eye(5, columns=list("abcde"))])
    with pytest.raises(NotImplementedError):
        concat([eye(5), eye(5, columns=list("abcde"))])
    assert concat([eye(3), eye(3, columns=list("abc")), eye(3, columns=list("def"))], axis=1).shape == (3, 9)
    assert np.array_equal(dense(vstack([eye(70)[list(range(65))], eye(70)[list(range(65))]])), np.vstack([np.identity(70)[:, :65]] * 2))


def test_positions(eye):
    f = eye(5, index=list("ABCDE"), columns=list("ABCDE"))
    e = np.identity(5)
    for got, want in ((f.iloc[:2], e[:2]), (f.iloc[[3, 4, 3]], e[[3, 4, 3]]), (f.iloc[3], e[[3]]), (f.iloc[1:], e[1:]), (f.iloc[-1], e[[-1]]), (f.iloc[::2], e[::2]), (f.iloc[::-1], e[::-1]), (f.iloc[-2:], e[-2:]), (f.take([2, 0]), e[[2, 0]]), (f.iloc[1:4:2], e[1:4:2])):
        assert np.array_equal(dense(got), want)
    assert f.head(2).index.tolist() == ["A", "B"]
    with pytest.raises(NotImplementedError):
        f.iloc[1, 2]


def test_labels(eye):
    f = eye(5, index=list("ABCDE"))
    assert f.loc["A"].shape == (1, 5) and f.loc["B":"D"].shape == (3, 5) and f.loc["C":].shape == (3, 5) and f.loc[:"C"].shape == (3, 5)
    assert f.loc[["D", "A", "D"]].todense().index.tolist() == ["D", "A", "D"]
    with pytest.raises(KeyError):
        f.loc["Z"].todense()
    two = SparseFrame(pd.DataFrame({"v": [1, 2, 3]}, index=pd.MultiIndex.from_tuples([("a", 1), ("a", 2), ("b", 1)])), spark=f._df.sparkSession)
    assert two.loc["a", 2].shape == (1, 1) and two.loc["a"].shape == (2, 1)
    with pytest.raises(NotImplementedError):
        f.loc["A", "B"]
    bare = one_hot(f._df.sparkSession.createDataFrame([("x",)], "c string"), "c", ["x", "y"])
    assert bare.to_wide().columns == ["x", "y"] and bare.sum() == 1
    for call in (lambda: bare.index, lambda: bare.iloc[[0]]):
        with pytest.raises(ValueError):
            call()
    n = eye(5)
    assert n.loc[n.index > 2].todense().index.tolist() == [3, 4]
    assert n.loc[np.array([True, False, False, True, False])].todense().index.tolist() == [0, 3]


def test_dates(spark):
    days = pd.date_range("2016-10-01", periods=5, freq="D")
    f = SparseFrame(pd.DataFrame(np.identity(5), index=pd.MultiIndex.from_arrays([days, range(5)]), columns=list("ABCDE")), spark=spark)
    for a, b in (("2016-10-01", "2016-10-03"), (pd.Timestamp("2016-10-01"), pd.Timestamp("2016-10-03")), (dt.date(2016, 10, 1), dt.date(2016, 10, 3))):
        assert f.loc[a:b].shape == (3, 5)
    assert f.loc["2016-10"].shape == (5, 5) and f.loc["2016-10-02"].shape == (1, 5) and f.loc[pd.Timestamp("2016-10-02")].shape == (1, 5)
    assert f.set_index(level=1).todense().index.tolist() == [0, 1, 2, 3, 4]
    assert period("2016-12") == (pd.Timestamp("2016-12-01"), pd.Timestamp("2017-01-01"))
    assert period("2016-02-28 23:59") == (pd.Timestamp("2016-02-28 23:59"), pd.Timestamp("2016-02-29"))
    with pytest.raises(KeyError):
        period("yesterday")


def test_date_filter_reaches_the_scan(spark):
    f = one_hot(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "event_type", ["click", "error", "purchase", "signup", "view"], "ts")
    plan = f.loc["2024-01-15":"2024-01-17"].to_wide()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-15" in plan and "Python" not in plan and "props" not in plan


def test_set_index(spark, eye):
    f = eye(5, index=list("ABCDE"), columns=list("VWXYZ"))
    assert sorted(f.set_index(column="V").todense().index) == [0, 0, 0, 0, 1]
    assert f.set_index(idx=[9, 8, 7, 6, 5]).todense().sort_index().index.tolist() == [5, 6, 7, 8, 9]
    g = f.copy()
    assert g.set_index(idx=[5, 6, 7, 8, 9], inplace=True) is None and 5 in g.todense().index
    for bad in ({}, {"level": 0}):
        with pytest.raises(ValueError):
            f.set_index(**bad)


def test_assign(spark, eye):
    f = eye(5, columns=list("ABCDE"))
    assert f.assign(F=1).todense()["F"].tolist() == [1] * 5 and f.shape == (5, 5)
    assert f.assign(F=np.arange(5), G=2).todense()[["F", "G"]].to_numpy().tolist() == [[i, 2] for i in range(5)]
    f["H"] = [1, 0, 1, 0, 1]
    assert f.shape == (5, 6) and f.todense()["H"].tolist() == [1, 0, 1, 0, 1]
    for call in (lambda: f.assign(A=1), lambda: f.assign(A=np.ones(5)), lambda: f.__setitem__("A", 1)):
        with pytest.raises(NotImplementedError):
            call()
    with pytest.raises(ValueError):
        f.assign(Q=[1, 2])
    assert eye(70).assign(new=3).todense()["new"].tolist() == [3] * 70


def test_local_arrays_are_sent_by_parts(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from cellweave.frame_workloads import QUERIES
    from cellweave.plans import local

    def refuse(*_):
        raise AssertionError("a row object for each value")

    assert QUERIES["assign_array"](spark, "/root/testdata/sf0.001").where("eid >= 0").count() == 1000
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", refuse)
        QUERIES["assign_array"](spark, "/root/testdata/sf0.001")
    sent, create = [], spark.createDataFrame
    monkeypatch.setattr(local, "SENT_BYTES", 4_000)
    monkeypatch.setattr(local, "PART_BYTES", 8_000)
    monkeypatch.setattr(local, "_CHUNK", 300)
    f = SparseFrame.from_wide(spark.range(5_000).withColumn("x", F.lit(1.0)), "id")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: sent.append(data.nbytes) or create(data, *a, **k))
    values = np.random.default_rng(0).random(5_000)
    times = np.datetime64("2024-01-01T00:00:00") + np.arange(5_000)
    assigned, timed, named, flagged = f.assign(v=values), f.set_index(idx=times), f.set_index(idx=[f"k{i}" for i in range(5_000)]), f.loc[values > 0.5]
    assert max(sent) < 10_000 and len(sent) > 20
    assert "Generate" not in flagged._df._jdf.queryExecution().optimizedPlan().toString()  # read from where its size is known
    monkeypatch.undo()
    assert np.array_equal(assigned.todense()["v"].to_numpy(), values)
    assert (timed.sort_index().todense().index.to_numpy() == times).all()
    assert sorted(named.todense().index) == sorted(f"k{i}" for i in range(5_000))
    assert sorted(flagged.todense().index) == np.nonzero(values > 0.5)[0].tolist()
    with pytest.raises(ValueError):
        f.assign(v=values[:-1])


def test_many_labels_are_held_packed(spark, monkeypatch):
    import tracemalloc

    n, sizes, create = 200_000, [], spark.createDataFrame
    rows = spark.createDataFrame([(1, 5, 2.0), (2, n - 1, 3.0), (2, 5, -1.0)], "k long, c long, v double")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: sizes.append(len(data)) or create(data, *a, **k))
    tracemalloc.start()
    try:
        f = concat([SparseFrame.from_long(rows, "k", "c", "v", list(range(n))).rename(lambda c, i=i: c + i * n) for i in range(3)], axis=1)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 100 * n  # 24 bytes of labels for each of n, and what is on the way
    cells = sorted(map(tuple, f.to_long().collect()))
    assert max(sizes) < 20  # not a row object for each label
    assert cells == sorted((k, c + i * n, v) for i in range(3) for k, c, v in [(1, 5, 2.0), (2, n - 1, 3.0), (2, 5, -1.0)])
    assert f.shape == (2, 3 * n) and f.columns[-1] == 3 * n - 1


def test_labels_equal_a_tuple():
    from cellweave.frame.labels import Labels, in_order

    for each in ([], [3, 1, 2], ["a", "b"], [1, "b"], [1, 2.5], [True, False], [1, 2**63], [-(2**63)], [None, 1], [np.int64(3), 4], [(1, 2), "x"]):
        made = Labels(each)
        assert made == tuple(each) and made == Labels(iter(each)) and list(made) == each and len(made) == len(each)
        assert [type(x) for x in made] == [type(x) for x in each] and hash(made) == hash(tuple(each))
        assert made + ["z"] == (*each, "z") and made + Labels([7]) == (*each, 7) and made != (*each, 0)
        assert all(x in made and made.index(x) == each.index(x) and made[each.index(x)] == x for x in each) and "no" not in made
        assert len(made.arrow()) == len(each) if len({type(x) for x in each}) == 1 and each != [(1, 2), "x"] and 2**63 not in each else True
    assert Labels([1, 2]) == Labels([1.0, 2.0]) and Labels([0, 1]) == Labels([False, True]) and Labels([1]) != [1]
    assert Labels([1, 2]).whole and Labels([np.int32(1)]).whole and not Labels([True]).whole and not Labels([1, "a"]).whole
    assert in_order(()) and in_order(range(3)) and in_order((0, 1)) and not in_order((1, 0)) and not in_order(range(1, 3)) and not in_order(("a",))


def test_set_index_by_one_of_many_columns_makes_one_expression(spark, monkeypatch):
    made, lit = [], F.lit
    rows = spark.createDataFrame([(1, 5, 2.0), (2, 2_999, 3.0), (2, 5, -1.0), (3, 7, 1.0)], "k long, c long, v double")
    f = SparseFrame.from_long(rows, "k", "c", "v", range(3_000))
    monkeypatch.setattr(F, "lit", lambda x: made.append(x) or lit(x))
    g = f.set_index(column=5)
    assert len(made) < 100  # not one for each label
    monkeypatch.undo()
    assert sorted(map(tuple, g.to_long().collect())) == [(-1.0, 5, -1.0), (-1.0, 2_999, 3.0), (0.0, 7, 1.0), (2.0, 5, 2.0)]
    assert sorted(map(tuple, f.rename(str).groupby_sum(by="5").to_long().collect())) == [(-1.0, "2999", 3.0), (-1.0, "5", -1.0), (0.0, "7", 1.0), (2.0, "5", 2.0)]


def test_columns(eye):
    f = eye(10, columns=list("abcdefghij"))
    assert np.array_equal(dense(f[["j", "a"]]), np.identity(10)[:, [9, 0]]) and f["b"].shape == (10, 1) and f[("c", "d")].columns == ("c", "d")
    assert f.take([2, -1], axis=1).columns == ("c", "j")
    with pytest.raises(KeyError):
        f["z"]
    g = f.rename(lambda c: c + "_new")
    assert g.columns[0] == "a_new" and f.columns[0] == "a"
    assert g.rename(str.upper, inplace=True) is None and g.columns[0] == "A_NEW"
    assert f._get_axis(1) == f.columns
    with pytest.raises(ValueError):
        f._get_axis(2)


def test_index_cleaning(eye):
    f = eye(5, index=[1.0, float("nan"), 2.0, float("nan"), 3.0])
    assert np.array_equal(dense(f.dropna()), np.identity(5)[[0, 2, 4]])
    g = eye(8, index=[0, 0, 2, 3, 3, 5, 5, 5])
    assert np.array_equal(dense(g.drop_duplicate_idx().sort_index()), np.identity(8)[[0, 2, 3, 5]])
    assert np.array_equal(dense(g.drop_duplicate_idx(keep="last").sort_index()), np.identity(8)[[1, 2, 4, 7]])
    assert np.array_equal(dense(g.drop_duplicate_idx(keep=False)), np.identity(8)[[2]])
    with pytest.raises(ValueError):
        g.drop_duplicate_idx(keep="any")
    h = eye(3, index=[3, 1, 2], columns=list("abc")).sort_index()
    assert h.todense().index.tolist() == [1, 2, 3] and h.columns == ("a", "b", "c")


@pytest.mark.parametrize("k", [4, 90])
def test_reductions(spark, k):
    rng = np.random.default_rng(4)
    x = (rng.random((6, k)) - 0.5) * (rng.random((6, k)) < 0.4)
    x[:, 0] = -1 - np.arange(6)
    f = SparseFrame(x, spark=spark)
    for op in ("sum", "mean", "std", "max", "min"):
        assert getattr(f, op)() == pytest.approx(getattr(x, op)())
        assert np.allclose([*getattr(f, op)(axis=0).first()], getattr(x, op)(axis=0))
        rows = {r[0]: r[1] for r in getattr(f, op)(axis=1).collect()}
        assert np.allclose([rows[i] for i in range(6)], getattr(x, op)(axis=1))
    assert f.nnz() == np.count_nonzero(x) and f.shape == x.shape
    with pytest.raises(ValueError):
        f.sum(axis=3)


@pytest.mark.parametrize("k", [1, 65])
def test_std_keeps_digits(spark, k):
    """Of large numbers that lie close together, in every layout and direction."""
    x = np.zeros((4, k))
    x[:, 0] = 1e9 + np.arange(1, 5)
    f = SparseFrame(x, index=range(4), spark=spark)
    assert f._layout == (WIDE if k == 1 else MAP)
    assert f.std(axis=0).first()[0] == pytest.approx(np.std([1, 2, 3, 4]), rel=1e-6)
    assert f.std(axis=0, shape="long").filter("column = 0").first()[1] == pytest.approx(np.std([1, 2, 3, 4]), rel=1e-6)
    assert f.std() == pytest.approx(x.std(), rel=1e-9)
    flat = SparseFrame(1e9 + np.tile(np.arange(1.0, 5), (2, 20)), index=[0, 1], spark=spark)
    assert [r[1] for r in flat.std(axis=1).collect()] == pytest.approx([np.std([1, 2, 3, 4])] * 2, rel=1e-6)


@pytest.mark.parametrize("k", [2, 3000])
def test_shape_of_reductions_is_asked_for(spark, k):
    f = SparseFrame(np.ones((2, k)), spark=spark)
    assert f.sum(axis=0, shape="long").columns == ["column", "value"] and f.sum(axis=0, shape="long").count() == k
    if k == 2:
        assert f.sum(axis=0).columns == ["0", "1"]
    else:
        assert len(f.reduced("sum", 0).columns) == k
    with pytest.raises(ValueError):
        f.sum(axis=0, shape="tall")


@pytest.mark.parametrize("k", [1, 100])
def test_missing_keys_match_as_they_group(spark, k):
    """Null with null and NaN with NaN, in joins and in sums, whichever way these take."""
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (1.0, 4.0)], "k double, v double")
    made = df.select("k", *(F.col("v").alias(f"v{i}") for i in range(k)))
    f = SparseFrame(made, "k")
    grouped = f.groupby_sum()
    assert f.join(grouped.rename(lambda c: "w" + c)).shape == (3, 2 * k)
    for total in (f.add(f), grouped.add(grouped), f.add(grouped), grouped.add(grouped, how="inner")):
        assert total.shape == (3, k) and sorted(dense(total)[:, 0]) == [2, 4, 8]
    two = SparseFrame(spark.createDataFrame([("a", None, 1.0), (None, None, 2.0)], "x string, y int, v double"), ["x", "y"])
    assert two.add(two).shape == (2, 1)


def week(n=49):
    dates = pd.date_range("2017-01-01", periods=n)
    return pd.DataFrame({"date": dates, "weekday": dates.day_name(), "id": np.tile(np.arange(7), n // 7)})


DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def test_one_hot(spark):
    df = spark.createDataFrame(week())
    assert np.array_equal(dense(one_hot(df, "weekday", DAYS, "id").groupby_sum().sort_index()), 7 * np.identity(7))
    more = [*DAYS[:6], "Yesterday", DAYS[6], "Birthday"]
    got = dense(one_hot(df, "weekday", more, "id").groupby_sum().sort_index())
    assert got.shape == (7, 9) and not got[:, [6, 8]].any()
    assert one_hot(df, "weekday", DAYS, ["date", "id"]).index_names == ["date", "id"]
    many = [*DAYS, *(f"x{i}" for i in range(100))]
    assert one_hot(df, "weekday", many, "id").groupby_sum().nnz() == 7


@pytest.mark.parametrize("cats", [DAYS[:6], [*DAYS[:6], *(f"x{i}" for i in range(100))]])
def test_one_hot_unknown_category(spark, cats):
    f = one_hot(spark.createDataFrame(week()), "weekday", cats, "id")
    with pytest.raises(ValueError):
        f.todense()
    with pytest.raises(ValueError):
        one_hot(spark.createDataFrame(week()), "weekday", cats, "id").shape
    with pytest.raises(ValueError):
        one_hot(spark.createDataFrame([(1, None)], "id int, weekday string"), "weekday", cats, "id").todense()


def test_event_matrix(spark):
    rows = [(f"u{u}", 60 * u + e, f"user{u}", ["view", "buy", "", None][e % 4]) for u in range(3) for e in range(3)]
    df = spark.createDataFrame(rows, "uuid string, ts bigint, username string, action string")
    f = event_matrix(df, "uuid", "ts", "username")
    assert f.columns == ("user0", "user1", "user2") and np.array_equal(dense(f).argmax(axis=1), [0, 0, 0, 1, 1, 1, 2, 2, 2])
    assert event_matrix(df, "uuid", "ts", "action").columns == ("view", "buy", "")
    assert np.array_equal(dense(f.add(f).sort_index()), 2 * dense(f.sort_index()))
    lacking = event_matrix(spark.createDataFrame([("a", 1, None), ("a", 2, "x")], "uuid string, ts bigint, f string"), "uuid", "ts", "f")
    assert lacking.shape == (2, 1) and lacking.nnz() == 1


def test_long(spark):
    df = spark.createDataFrame([("a", 7, 1.0), ("a", 7, 2.0), ("b", 9, 4.0), ("c", None, None)], "k string, c int, v double")
    f = SparseFrame.from_long(df, "k", "c", "v")
    assert f.columns == (7, 9) and f.shape == (3, 2) and f.nnz() == 2 and f.todense()[7].to_dict() == {"a": 3, "b": 0, "c": 0}
    assert sorted(map(tuple, f.to_long().collect())) == [("a", 7, 3.0), ("b", 9, 4.0)]
    assert f[[9]].todense().to_dict() == {"a": 0, "b": 4, "c": 0}


def test_local_input(spark):
    assert SparseFrame(pd.Series(np.ones(10)), spark=spark).shape == (10, 1)
    assert SparseFrame(np.ones(4), spark=spark).shape == (4, 1)
    with pytest.raises(TypeError):
        SparseFrame(pd.DataFrame({"a": ["x"], "b": [1]}), spark=spark)
    with pytest.raises(TypeError):
        SparseFrame(spark.createDataFrame([("a", "b")], "k string, v string"), "k", ["v"])
    with pytest.raises(ValueError):
        SparseFrame(np.ones((2, 2, 2)), spark=spark)
    with pytest.raises(ValueError):
        SparseFrame(np.ones((2, 2)), columns=["a"], spark=spark)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, __cells double, __c0 double")
    f = SparseFrame(df, "k")
    assert f.to_wide().columns == ["k", "__cells", "__c0"] and f.join(f).to_wide().columns == ["k", "__cells", "__c0", "__cells_2", "__c0_2"]
    g = SparseFrame(spark.createDataFrame([(1, 5.0)], "k int, `a.b` double"), "k")
    assert g.todense().to_dict() == {1: 5.0}


def test_repr(spark, eye):
    text = repr(SparseFrame(np.zeros((10, 1000)), spark=spark))
    assert "10x1000" in text and "0 stored" in text
    assert "npartitions" in eye(3).structure() and eye(3).__sizeof__() > 0 and np.asarray(eye(3)).shape == (3, 3)


def test_parquet(spark, eye, tmp_path):
    for f, name in ((eye(4, index=list("abcd"), columns=list("wxyz")), "wide"), (eye(80), "map")):
        f.to_parquet(str(tmp_path / name))
        g = SparseFrame.read_parquet(str(tmp_path / name), spark)
        assert g.todense().sort_index().equals(f.todense().sort_index()) and g.columns == f.columns


def test_npz(spark, eye, tmp_path):
    for i in range(4):
        eye(100).iloc[25 * i : 25 * i + 25].to_npz(str(tmp_path / f"{i}.npz"))
    f = SparseFrame.read_npz(f"{tmp_path}/*.npz", spark, sorted=True)
    assert f.shape == (100, 100) and np.array_equal(dense(f), np.identity(100))
    eye(3, index=[5, 6, 7]).to_npz(str(tmp_path / "9.npz"))
    eye(100).iloc[:2].to_npz(str(tmp_path / "91.npz"))
    with pytest.raises(ValueError):
        SparseFrame.read_npz(f"{tmp_path}/9*.npz", spark, sorted=True)
    with pytest.raises(FileNotFoundError):
        SparseFrame.read_npz(f"{tmp_path}/none*.npz", spark)
    few = SparseFrame(np.diag([1.0, 0, 2]), index=["a", "b", "c"], columns=list("xyz"), spark=spark)
    few.to_npz(str(tmp_path / "s1.npz"))
    assert SparseFrame.read_npz(f"file://{tmp_path}/s1.npz", spark).todense().to_dict() == few.todense().to_dict()
    few[["x", "z", "y"]].to_npz(str(tmp_path / "s2.npz"))  # the same labels in another order
    with pytest.raises(ValueError):
        SparseFrame.read_npz(f"{tmp_path}/s*.npz", spark).todense()
    with pytest.raises(ValueError):
        SparseFrame(pd.DataFrame({"v": [1]}, index=pd.MultiIndex.from_tuples([("a", 1)])), spark=spark).to_npz(str(tmp_path / "m.npz"))


def test_npz_is_written_sparse(spark, tmp_path):
    """A frame whose dense form would take 32 GB."""
    rows = spark.range(100_000).select("id", (F.col("id") % 40_000).alias("c"), F.lit(1.0).alias("v"))
    SparseFrame.from_long(rows, "id", "c", "v", range(40_000)).to_npz(str(tmp_path / "big.npz"))
    with np.load(tmp_path / "big.npz") as z:
        assert z["shape"].tolist() == [100_000, 40_000] and len(z["data"]) == 100_000 and z["indptr"][-1] == 100_000
        assert (z["frame_index"] % 40_000 == z["indices"]).all()


def test_from_pandas_and_map_partitions(spark):
    pdf = pd.DataFrame(np.arange(20.0).reshape(10, 2), index=list("JIHGFEDCBA"), columns=["p", "q"])
    f = SparseFrame.from_pandas(pdf, npartitions=3, spark=spark)
    assert f.shape == (10, 2) and f.npartitions <= 3 and len(f.to_delayed()) == f.npartitions
    assert f.loc["A":"B"].shape == (2, 2) and f.loc["C":].shape == (8, 2) and f.loc[:"C"].shape == (3, 2)
    assert f.map_partitions(lambda d: d.assign(p=d.p * 2)).todense()["p"].to_dict() == (pdf.p * 2).to_dict()
    g = f.map_partitions(lambda d: d[[d.columns[0], "p"]], meta=["only"])
    assert g.columns == ("only",) and g.shape == (10, 1)


def test_map_partitions_sees_whole_partitions(spark):
    rows = spark.range(25_000, numPartitions=1).select("id", F.lit(1.0).alias("v"))
    size = lambda pdf: pdf.assign(v=len(pdf))
    f = SparseFrame(rows, "id")
    assert {r[0] for r in f.map_partitions(size).to_wide().select("v").distinct().collect()} == {25_000.0}
    assert max(r[0] for r in f.map_batches(size).to_wide().select("v").distinct().collect()) < 25_000
    assert SparseFrame(rows.limit(0), "id").map_partitions(size).shape == (0, 1)


def test_streaming_sums(spark, tmp_path):
    from cellweave.streaming import windowed_one_hot_sums

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    build = lambda t: windowed_one_hot_sums(t, "event_type", ["click", "view"], ["user_id"], "ts", "1 day", "40 days")
    q = build(stream).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sums").collect())) == sorted(map(tuple, build(src).collect()))


def test_public_names(spark):
    import cellweave

    assert cellweave.sparse_one_hot is cellweave.one_hot_encode is cellweave.one_hot
    assert cellweave.from_pandas(pd.DataFrame({"a": [1.0, 2.0]}), npartitions=2, spark=spark).shape == (2, 1)


def test_labels_of_a_long_frame_are_found_when_needed(spark):
    df = spark.createDataFrame([("a", "y", 1.0), ("b", "x", 2.0), ("b", "x", 3.0)], "k string, c string, v double")
    f = SparseFrame.from_long(df, "k", "c", "v").groupby_sum()
    assert f._known is None and sorted(map(tuple, f.to_long().collect())) == [("a", "y", 1.0), ("b", "x", 5.0)] and f._known is None
    assert f.columns == ("x", "y") and f.todense().to_numpy().tolist() == [[0, 1], [5, 0]]
    assert f.add(f).todense().to_numpy().tolist() == [[0, 2], [10, 0]]


def test_core_does_not_import_the_subpackage():
    from pathlib import Path

    import cellweave

    root = Path(cellweave.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
