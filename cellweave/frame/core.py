"""SparseFrame: a labelled sparse matrix as one lazy Spark DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.frame.labels import Labels, in_order
from cellweave.frame.layout import CELLS, COL, LONG, MAP, VALUE, WIDE, WIDE_LIMIT, empty_map, fresh, long_rows, map_of, renumbered
from cellweave.plans import first_positions, local_column, with_position

HOW = ("inner", "outer", "left", "right")
#: Rows at the front that a task takes by itself instead of numbering all rows.
TOP_ROWS = 100_000
#: Failures on executors that the driver raises as ValueError.
_REFUSED = ("unknown category", "archives have different columns")


def _checked(action: Callable[[], Any]) -> Any:
    """Run an action; a failed check of the data becomes a ValueError."""
    try:
        return action()
    except PySparkException as e:
        for refused in _REFUSED:
            if refused in str(e):
                raise ValueError(f"{refused}: " + str(e).split(refused, 1)[1].split("\n")[0].strip(": ")) from None
        raise


class SparseFrame:
    """Rows with index keys and columns with labels; a cell without a value is 0.

    All operations are lazy except shape, nnz, repr, scalars, positions and the discovery of labels, which run
    jobs. Rows have no order of their own: positions follow ``order_by``, or else the index. Keys are equal in
    joins and sums where groupby_sum puts them in one group: null equals null, and NaN equals NaN.
    """

    def __init__(self, data: Any, index: Any = None, columns: Sequence | None = None, spark: SparkSession | None = None, order_by: Sequence[str] | None = None):
        """data: a Spark DataFrame (index: its key columns, columns: its value columns), or a local array,
        list, pandas DataFrame or Series, or sparse matrix with tocoo() (index: its row labels)."""
        if isinstance(data, DataFrame):
            made = SparseFrame.from_wide(data, index, columns, order_by)
        else:
            from cellweave.frame.build import from_local

            made = from_local(data, index, columns, spark or SparkSession.active())
        self.__dict__.update(made.__dict__)

    @classmethod
    def _made(cls, df: DataFrame, index: Sequence[tuple[Any, str]], order: Sequence[str], labels: Sequence, refs: Sequence, layout: str, unique: bool = False, must_exist: Any = None) -> SparseFrame:
        f = cls.__new__(cls)
        f._raw, f._index, f._order, f._layout = df, list(index), list(order), layout
        f._known = None if labels is None else (Labels(labels), refs if isinstance(refs, range) else tuple(refs))
        f._unique, f._must_exist, f._shape, f._nnz = unique, must_exist, None, None
        return f

    # A LONG frame whose labels aren't known yet has the label itself in COL. Whatever needs the labels finds
    # them, once, by a job.

    def _resolve(self) -> None:
        from cellweave.frame.build import column_ids

        if self._known is None:
            labels, coded = column_ids(self._raw.withColumnRenamed(COL, "__raw"), "__raw", None)
            self._raw, self._known = coded.select(*self._kept, COL, VALUE), (labels, range(len(labels)))

    @property
    def _df(self) -> DataFrame:
        self._resolve()
        return self._raw

    @property
    def _labels(self) -> Labels:
        self._resolve()
        return self._known[0]

    @property
    def _refs(self) -> tuple | range:
        self._resolve()
        return self._known[1]

    def _with(self, **change: Any) -> SparseFrame:
        if self._known is None and not change.keys() - {"index", "order", "unique"}:
            return SparseFrame._made(**{"df": self._raw, "index": self._index, "order": self._order, "labels": None, "refs": None, "layout": LONG, "unique": self._unique} | change)
        given = {"df": self._df, "index": self._index, "order": self._order, "labels": self._labels, "refs": self._refs, "layout": self._layout, "unique": self._unique}
        return SparseFrame._made(**given | change)

    @classmethod
    def from_wide(cls, df: DataFrame, index: str | Sequence[str], columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> SparseFrame:
        """Numeric columns as cells; null cells are 0. Other types raise TypeError."""
        index = [index] if isinstance(index, str) else list(index or [])
        columns = [c for c in df.columns if c not in index] if columns is None else list(columns)
        for c in columns:
            if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
                raise TypeError(f"column {c!r} is {df.schema[c].dataType.simpleString()}, not numeric")
        keys, order = [(c, fresh("i")) for c in index], [(c, fresh("o")) for c in order_by or []]
        cells = [(c, fresh("c")) for c in columns]
        q = lambda c: F.col(f"`{c}`")
        base = df.select(*(q(c).alias(p) for c, p in [*keys, *order]), *(F.coalesce(q(c).cast("double"), F.lit(0.0)).alias(p) for c, p in cells))
        made = cls._made(base, keys, [p for _, p in order] or [p for _, p in keys], columns, [p for _, p in cells], WIDE)
        return made if len(columns) <= WIDE_LIMIT else made._as_map()

    @classmethod
    def from_long(cls, df: DataFrame, index: str | Sequence[str], col: str, value: str, columns: Sequence | None = None) -> SparseFrame:
        """Rows (index, col, value) as cells; equal (index, col) are summed, so an index key is one row.
        A null col gives a row without cells. Labels that aren't given are those that occur, ascending; they
        are found by a job when an operation needs them, which grouping and the long form don't."""
        from cellweave.frame.build import column_ids

        index = [index] if isinstance(index, str) else list(index)
        labels, coded = (None, df) if columns is None else column_ids(df, col, columns)
        keys = [(c, fresh("i")) for c in index]
        place = F.col(col).alias(COL) if columns is None else F.col(COL)
        base = coded.select(*(F.col(c).alias(p) for c, p in keys), place, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(VALUE))
        return cls._made(base, keys, [p for _, p in keys], labels, labels and range(len(labels)), LONG, unique=True)

    # --- layouts

    @property
    def _keys(self) -> list[str]:
        return [p for _, p in self._index]

    @property
    def _kept(self) -> list[str]:
        return list(dict.fromkeys([*self._keys, *self._order]))

    def _as_map(self) -> SparseFrame:
        n = len(self._labels)
        if self._layout == LONG:
            summed = self._summed()
            pair = F.when(F.col(COL).isNotNull() & (F.col(VALUE) != 0), F.struct(F.col(COL).alias("key"), F.col(VALUE).alias("value")))
            cells = F.map_from_entries(F.collect_list(pair)).alias(CELLS)
            return self._with(df=summed.groupBy(*self._keys).agg(cells), order=self._keys, refs=range(n), layout=MAP)
        if self._layout == MAP and in_order(self._refs):
            return self
        cells = map_of(self._refs) if self._layout == WIDE else renumbered(F.col(CELLS), self._refs)
        return self._with(df=self._df.select(*self._kept, cells.alias(CELLS)), refs=range(n), layout=MAP)

    def _rows(self) -> SparseFrame:
        """The frame with one physical row for each of its rows."""
        return self._as_map() if self._layout == LONG else self

    def _summed(self) -> DataFrame:
        """LONG rows (index, COL, VALUE), each cell once."""
        rows = long_rows(self._df, self._keys, self._layout, self._refs, outer=True)
        return rows.groupBy(*self._keys, COL).agg(F.sum(VALUE).alias(VALUE))

    def _value(self, place: int) -> Column:
        r = self._refs[place]
        return F.col(r) if self._layout == WIDE else F.coalesce(F.col(CELLS)[F.lit(r)], F.lit(0.0))

    def _values(self) -> list[Column]:
        return [self._value(i) for i in range(len(self._refs))]

    def _as_wide(self) -> SparseFrame:
        rows = self._rows()
        if rows._layout == WIDE:
            return rows
        names = [fresh("c") for _ in rows._refs]
        return rows._with(df=rows._df.select(*rows._kept, *(v.alias(c) for v, c in zip(rows._values(), names))), refs=names, layout=WIDE)

    def _named(self) -> DataFrame:
        """The physical rows with the index columns under their own names too."""
        return self._df.select("*", *(F.col(p).alias(n) for n, p in zip(self.index_labels(), self._keys)))

    def wide_labels(self) -> list[str]:
        """Names of the wide columns: labels as strings, repeated ones with _2, _3, ..."""
        seen: dict[str, int] = {str(n): 1 for n, _ in self._index}
        out = []
        for label in map(str, self._labels):
            k = seen[label] = seen.get(label, 0) + 1
            out.append(label if k == 1 else f"{label}_{k}")
        return out

    def index_labels(self) -> list[str]:
        return [str(n) if n is not None else f"index_{i}" if len(self._index) > 1 else "index" for i, (n, _) in enumerate(self._index)]

    def to_wide(self) -> DataFrame:
        """Index columns and a double column for each label."""
        rows = self._rows()
        return rows._df.select(*(F.col(p).alias(n) for n, p in zip(rows.index_labels(), rows._keys)), *(v.alias(c) for v, c in zip(rows._values(), rows.wide_labels())))

    def to_long(self, col: str = "col", value: str = "value") -> DataFrame:
        """(index, col, value) of the non-zero cells. Labels must be of one type."""
        from cellweave.frame.build import labelled

        names = [F.col(p).alias(n) for n, p in zip(self.index_labels(), self._keys)]
        if self._known is None:
            summed = self._raw.filter(F.col(COL).isNotNull()).groupBy(*self._keys, COL).agg(F.sum(VALUE).alias(VALUE)).filter(F.col(VALUE) != 0)
            return summed.select(*names, F.col(COL).alias(col), F.col(VALUE).alias(value))
        rows = self._summed() if self._layout == LONG else long_rows(self._df, self._keys, self._layout, self._refs, outer=False)
        rows = rows.filter(F.col(COL).isNotNull() & (F.col(VALUE) != 0))
        return labelled(rows, self._labels, col).select(*names, col, F.col(VALUE).alias(value))

    values = data = property(to_long)

    # --- facts

    @property
    def columns(self) -> tuple:
        return tuple(self._labels)

    @property
    def index(self) -> Column:
        """The first index column, for conditions such as sf.loc[sf.index > 2]."""
        if not self._index:
            raise ValueError("the frame has no index")
        return F.col(self.index_labels()[0])

    @property
    def index_names(self) -> list:
        return [n for n, _ in self._index]

    ndim = 2

    @property
    def shape(self) -> tuple[int, int]:
        if self._shape is None:
            rows = self._df.select(*self._keys).distinct() if self._layout == LONG else self._df
            self._shape = (_checked(rows.count), len(self._labels))
        return self._shape

    def nnz_frame(self) -> DataFrame:
        """One row nnz: the number of non-zero cells."""
        if self._layout == WIDE:
            each = reduce(Column.__add__, [(F.col(r) != 0).cast("bigint") for r in self._refs], F.lit(0).cast("bigint"))
        elif self._layout == MAP:
            each = F.size(renumbered(F.col(CELLS), self._refs)).cast("bigint")
        else:
            return self._summed().filter(F.col(COL).isNotNull() & (F.col(VALUE) != 0)).agg(F.count(F.lit(1)).alias("nnz"))
        return self._df.agg(F.coalesce(F.sum(each), F.lit(0)).alias("nnz"))

    def nnz(self) -> int:
        if self._nnz is None:
            self._nnz = _checked(lambda: self.nnz_frame().first()[0])
        return self._nnz

    @property
    def empty(self) -> bool:
        return not self._labels or self._df.isEmpty()

    @property
    def npartitions(self) -> int:
        """Partitions as they come out; a plan that shuffles is run up to its last shuffle to know them."""
        return self._df.rdd.getNumPartitions()

    def __len__(self) -> int:
        return self.shape[0]

    def __sizeof__(self) -> int:
        """Estimated bytes of the cells in a compressed row form, 12 a cell and 8 a row."""
        return 12 * self.nnz() + 8 * (self.shape[0] + 1)

    def _get_axis(self, axis: int):
        if axis not in (0, 1):
            raise ValueError(f"no axis {axis}")
        return self.index if axis == 0 else self.columns

    def __repr__(self) -> str:
        shown = list(range(len(self._labels)))
        if len(shown) > 50:
            shown = [*shown[:25], *shown[-25:]]
        top = self._cols(shown).head(5) if self._labels else pd.DataFrame()
        n, k = self.shape
        return f"{top}\n[{n}x{k} SparseFrame of type '<class 'float64'>'\n with {self.nnz()} stored elements]"

    def structure(self) -> str:
        """The frame's partitions and labels, without a job on its rows."""
        names = self.wide_labels()
        names = names if len(names) <= 50 else [*names[:25], "...", *names[-25:]]
        return f"SparseFrame structure: npartitions={self.npartitions}, layout={self._layout}, index={self.index_labels()}, columns={names}"

    # --- edges

    def compute(self) -> pd.DataFrame:
        return self.todense()

    def todense(self, pandas: bool = True):
        """All rows, dense, on the driver. One column gives a Series."""
        names = self.index_labels()
        rows = self._rows()
        if rows._order:
            rows = rows._with(df=rows._df.orderBy(*rows._order))
        out = _checked(rows.to_wide().toPandas)
        if self._must_exist is not None and out.empty:
            raise KeyError(self._must_exist)
        out = out.set_index(names) if names else out
        out.columns = list(self._labels)
        if not pandas:
            return out.to_numpy()[:, 0] if out.shape[1] == 1 else out.to_numpy()
        return out.iloc[:, 0] if out.shape[1] == 1 else out

    def toarray(self) -> np.ndarray:
        return self.todense(pandas=False)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.asarray(self.toarray(), dtype=dtype)

    def head(self, n: int = 1) -> pd.DataFrame:
        return self.head_frame(n)._dense()

    def _dense(self) -> pd.DataFrame:
        out = self.todense()
        return out.to_frame() if isinstance(out, pd.Series) else out

    def head_frame(self, n: int = 1) -> SparseFrame:
        """The first n rows, found without numbering all."""
        rows = self._rows()
        return rows._with(df=rows._df.orderBy(*rows._order).limit(n))

    def copy(self) -> SparseFrame:
        return self._with()

    def persist(self) -> SparseFrame:
        self._df.persist()
        return self

    def visualize(self) -> None:
        self._df.explain("formatted")

    def to_delayed(self) -> list[DataFrame]:
        """One DataFrame for each partition, in wide form; for inspection."""
        wide = self.to_wide().withColumn("__p", F.spark_partition_id())
        return [wide.filter(F.col("__p") == p).drop("__p") for p in range(wide.rdd.getNumPartitions())]

    # --- columns

    def _cols(self, places: Sequence[int]) -> SparseFrame:
        base = self._as_map() if self._layout == LONG else self
        return base._with(labels=[base._labels[i] for i in places], refs=[base._refs[i] for i in places])

    def __getitem__(self, labels) -> SparseFrame:
        """The columns of these labels, in this order; a single label or a list or tuple of labels."""
        single = labels in self._labels if not isinstance(labels, (list, np.ndarray, pd.Index)) else False
        wanted = [labels] if single or isinstance(labels, (str, int, float)) else list(labels)
        missing = [x for x in wanted if x not in self._labels]
        if missing:
            raise KeyError(missing)
        return self._cols([i for x in wanted for i, label in enumerate(self._labels) if label == x])

    def take(self, idx: Sequence[int], axis: int = 0) -> SparseFrame:
        if axis == 1:
            return self._cols([range(len(self._labels))[i] for i in idx])
        if axis != 0:
            raise ValueError(f"no axis {axis}")
        return self.iloc[list(idx)]

    def rename(self, columns: Callable[[Any], Any], inplace: bool = False) -> SparseFrame | None:
        labels = Labels(columns(c) for c in self._labels)
        if inplace:
            self._known = (labels, self._refs)
            return None
        return self._with(labels=labels)

    def assign(self, **columns: Any) -> SparseFrame:
        """New columns, from left to right: a number, a Column over the index, or an array of one value a row."""
        out = self
        for label, value in columns.items():
            out = out._assigned(label, value)
        return out

    def __setitem__(self, label: Any, value: Any) -> None:
        self.__dict__.update(self._assigned(label, value).__dict__)

    def _assigned(self, label: Any, value: Any) -> SparseFrame:
        if label in self._labels:
            raise NotImplementedError(f"column {label!r} exists")
        rows = self._rows()
        if isinstance(value, (list, tuple, np.ndarray, pd.Series)):
            rows, value = rows._by_position(np.asarray(value, float))
        else:
            value = value if isinstance(value, Column) else F.lit(float(value))
        name = fresh("c")
        named = rows._named().withColumn(name, F.coalesce(value.cast("double"), F.lit(0.0)))
        if rows._layout == WIDE and len(rows._labels) < WIDE_LIMIT:
            base = named.select(*rows._kept, *dict.fromkeys(rows._refs), name)
            return rows._with(df=base, labels=rows._labels + [label], refs=(*rows._refs, name))
        k = len(rows._labels)
        cells = map_of(rows._refs) if rows._layout == WIDE else renumbered(F.col(CELLS), rows._refs)
        own = F.map_filter(F.create_map(F.lit(k), F.col(name)), lambda _, v: v != 0)
        return rows._with(df=named.select(*rows._kept, F.map_concat(cells, own).alias(CELLS)), labels=rows._labels + [label], refs=range(k + 1), layout=MAP)

    # --- positions

    def with_positions(self, name: str, below: int | None = None) -> SparseFrame:
        """The frame with a hidden column of 0-based row positions; with ``below`` at least the rows at smaller
        positions, of which a number that a task can hold are found without numbering all."""
        rows = self._rows()
        if not rows._order:
            raise ValueError("positions need an index or order_by")
        if below is not None and below <= TOP_ROWS:
            return rows._with(df=first_positions(rows._df, rows._order, below, name), order=[name])
        return rows._with(df=with_position(rows._df, rows._order, name), order=[name])

    def _by_position(self, values: np.ndarray) -> tuple[SparseFrame, Column]:
        """The frame joined with one local value a row, and that value's column."""
        pos, val = fresh("p"), fresh("v")
        numbered = self.with_positions(pos)
        n = numbered._df.count()
        if len(values) != n:
            raise ValueError(f"{len(values)} values for {n} rows")
        column = pa.array(values.astype("datetime64[us]") if values.dtype.kind == "M" else values)
        local = local_column(self._df.sparkSession, column, pos, val)
        return numbered._with(df=numbered._df.join(local, pos)), F.col(val)

    @property
    def loc(self):
        from cellweave.frame.indexing import Loc

        return Loc(self)

    @property
    def iloc(self):
        from cellweave.frame.indexing import ILoc

        return ILoc(self)

    # --- index

    def _filtered(self, condition: Column, **change: Any) -> SparseFrame:
        """Rows that meet a condition over the index columns under their own names, or physical ones."""
        clash = set(self.index_labels()) & set(self._df.columns)
        rows = self._df if clash else self._named()
        return self._with(df=rows.filter(condition).select(*self._df.columns), **change)

    def dropna(self) -> SparseFrame:
        """Rows whose index keys are all neither null nor NaN; cells aren't looked at."""
        keep = F.lit(True)
        for p in self._keys:
            keep = keep & F.col(p).isNotNull()
            if isinstance(self._df.schema[p].dataType, (T.DoubleType, T.FloatType)):
                keep = keep & ~F.isnan(p)
        return self._filtered(keep)

    def drop_duplicate_idx(self, keep: str | bool = "first") -> SparseFrame:
        """One row for each index key: the first or last by order, or, with False, only keys that occur
        once. Reduced before the shuffle, so a heavy key doesn't gather its rows in one task."""
        if keep not in ("first", "last", False):
            raise ValueError(f"keep={keep!r}")
        rows = self._rows()
        rest = [c for c in rows._df.columns if c not in rows._keys]
        if not rest:
            once = rows._df.groupBy(*rows._keys).agg(F.count(F.lit(1)).alias("__n"))
            return rows._with(df=(once.filter("__n = 1") if keep is False else once).drop("__n"), unique=True)
        own, by = F.struct(*rest), F.struct(*rows._order)
        pick = F.max_by(own, by) if keep == "last" else F.min_by(own, by)
        once = rows._df.groupBy(*rows._keys).agg(pick.alias("__r"), F.count(F.lit(1)).alias("__n"))
        once = once.filter("__n = 1") if keep is False else once
        return rows._with(df=once.select(*rows._keys, "__r.*"), unique=True)

    def sort_index(self) -> SparseFrame:
        """Ascending by index, nulls first; labels are kept."""
        rows = self._rows()
        return rows._with(df=rows._df.orderBy(*rows._keys), order=rows._keys)

    def set_index(self, column: Any = None, idx: Any = None, level: int | None = None, inplace: bool = False) -> SparseFrame | None:
        """A new index: ``idx`` (a Column over the index, or an array of one key a row), else ``level`` of a
        multi-index, else ``column``, which stays a column."""
        if idx is not None:
            if isinstance(idx, (Column, str)):
                rows, key = self._rows(), F.col(idx) if isinstance(idx, str) else idx
            else:
                rows, key = self._rows()._by_position(np.asarray(idx))
            name = fresh("i")
            label = idx if isinstance(idx, str) else "idx"
            out = rows._with(df=rows._named().withColumn(name, key).select(*rows._df.columns, name), index=[(label, name)], unique=False)
        elif level is not None:
            if len(self._index) < 2:
                raise ValueError("level needs a multi-index")
            out = self._rows()._with(index=[self._rows()._index[level]], unique=False)
        elif column is not None:
            rows = self._as_wide() if len(self._labels) <= WIDE_LIMIT else self._rows()
            at = rows._labels.index(column)
            name = fresh("i")
            out = rows._with(df=rows._df.withColumn(name, rows._value(at)), index=[(column, name)], unique=False)
        else:
            raise ValueError("give column, idx or level")
        if inplace:
            self.__dict__.update(out.__dict__)
            return None
        return out

    def rename_index(self, *names: str) -> SparseFrame:
        return self._with(index=[(n, p) for n, (_, p) in zip(names, self._index, strict=True)])

    # --- aggregation

    def groupby_sum(self, by: Any = None, level: int | None = None) -> SparseFrame:
        """Sums of every column for each key: the whole index (default, or by="index"), one level of a
        multi-index, a column's label, a Column over the index, or an array of one key a row."""
        frame = self
        if by is None or (isinstance(by, str) and by == "index"):
            if level is not None:
                if len(self._index) < 2:
                    raise ValueError("level needs a multi-index")
                frame = self._with(index=[self._index[level]])
        elif isinstance(by, str) and by in self._labels:
            frame = self.set_index(column=by)
        else:
            frame = self.set_index(idx=by)
            if not isinstance(by, (str, Column)):
                frame = frame.rename_index("by")
        keys = frame._keys
        if frame._known is None:
            return frame._with(order=keys, unique=True)
        if frame._layout == WIDE:
            sums = frame._df.groupBy(*keys).agg(*(F.sum(r).alias(r) for r in dict.fromkeys(frame._refs) if r not in keys), *(F.lit(1).alias("__one") for _ in [0] if not frame._refs))
            return frame._with(df=sums, order=keys, unique=True)
        if frame._layout == MAP:
            rows = long_rows(frame._df, keys, MAP, frame._refs, outer=True)
            return frame._with(df=rows, order=keys, refs=range(len(frame._labels)), layout=LONG, unique=True)
        return frame._with(order=keys, unique=True)

    groupby = groupby_sum

    def reduced(self, op: str, axis: int | None = None, shape: str = "wide") -> DataFrame:
        """sum, mean, std (of the population), max or min, zeros included: one row "value" of all cells
        (axis None), (index, value) of each row (axis 1), or the value of each label (axis 0): as one row with
        a column a label (shape "wide"), or as rows (column, value) (shape "long"), which is the form to take
        for thousands of labels, as a plan of as many columns is slow to make."""
        if op not in ("sum", "mean", "std", "max", "min"):
            raise ValueError(op)
        if axis not in (None, 0, 1):
            raise ValueError(f"no axis {axis}")
        if shape not in ("wide", "long"):
            raise ValueError(f"shape {shape!r}: expected 'wide' or 'long'")
        rows, k = self._rows(), len(self._labels)
        if axis == 1:
            names = [F.col(p).alias(n) for n, p in zip(rows.index_labels(), rows._keys)]
            v = F.map_values(renumbered(F.col(CELLS), rows._refs)) if rows._layout == MAP else F.array(*rows._values())
            total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
            if op == "std":
                base = rows._df.select(*names, v.alias("__v"), (total / k).alias("__m"))
                apart = F.aggregate("__v", F.lit(0.0), lambda a, x: a + (x - F.col("__m")) * (x - F.col("__m")))
                holes = (F.lit(k) - F.size("__v")) * F.col("__m") * F.col("__m")
                return base.select(*rows.index_labels(), F.sqrt((apart + holes) / k).alias("value"))
            filled = F.when(F.size(v) < k, F.concat(v, F.array(F.lit(0.0)))).otherwise(v)
            out = {"sum": total, "mean": total / k, "max": F.array_max(filled), "min": F.array_min(filled)}[op]
            return rows._df.select(*names, out.alias("value"))
        built = {"sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min}[op]
        if axis == 0 and rows._layout == WIDE and shape == "wide":
            return rows._df.agg(*(built(F.col(r)).alias(n) for r, n in zip(rows._refs, rows.wide_labels()))) if k else rows._df.agg(F.count(F.lit(1)))
        n = rows._df.agg(F.count(F.lit(1)).alias("__n"))
        cells = long_rows(rows._df, [], rows._layout, rows._refs, outer=False)
        facts = [F.sum(VALUE).alias("s"), F.avg(VALUE).alias("m"), F.var_pop(VALUE).alias("v"), F.max(VALUE).alias("hi"), F.min(VALUE).alias("lo"), F.count(F.lit(1)).alias("c")]

        def final(size: Column) -> Column:
            s, m, v, c = F.coalesce("s", F.lit(0.0)), F.coalesce("m", F.lit(0.0)), F.coalesce("v", F.lit(0.0)), F.coalesce("c", F.lit(0))
            hole, share = c < size, c / size
            return {
                "sum": s,
                "mean": s / size,
                # Of c cells with mean m and variance v, and zeros.
                "std": F.sqrt(share * v + share * (F.lit(1.0) - share) * m * m),
                "max": F.when(hole, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi")),
                "min": F.when(hole, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo")),
            }[op]

        if axis is None:
            return cells.agg(*facts).join(F.broadcast(n)).select(final(F.col("__n") * k).alias("value"))  # one row each
        from cellweave.frame.build import labelled

        every = rows._df.sparkSession.range(k).select(F.col("id").cast("int").alias(COL))
        each = every.join(cells.groupBy(COL).agg(*facts), COL, "left").join(F.broadcast(n)).select(COL, final(F.col("__n")).alias("value"))
        if shape == "long":
            return labelled(each, self._labels, "column").select("column", "value")
        whole = each.agg(F.map_from_entries(F.collect_list(F.struct(COL, "value"))).alias("m"))
        return whole.select(*(F.col("m")[F.lit(i)].alias(c) for i, c in enumerate(rows.wide_labels())))

    def _reduction(self, op: str, axis: int | None, shape: str):
        out = self.reduced(op, axis, shape)
        return _checked(lambda: out.first()[0]) if axis is None else out

    def sum(self, axis: int | None = None, shape: str = "wide"):
        return self._reduction("sum", axis, shape)

    def mean(self, axis: int | None = None, shape: str = "wide"):
        return self._reduction("mean", axis, shape)

    def std(self, axis: int | None = None, shape: str = "wide"):
        return self._reduction("std", axis, shape)

    def max(self, axis: int | None = None, shape: str = "wide"):
        return self._reduction("max", axis, shape)

    def min(self, axis: int | None = None, shape: str = "wide"):
        return self._reduction("min", axis, shape)

    # --- alignment

    def join(self, other: Any, axis: int = 1, how: str = "outer", level: int | None = None) -> SparseFrame:
        """axis 1: rows with equal index keys, the columns of both, missing cells 0. Equal keys on both sides
        give each combination. Frames over the same rows are put together without a join. With ``level``,
        one level of this frame's index is matched with the other's single index. axis 0: vstack."""
        from cellweave.frame.align import joined

        other = other if isinstance(other, SparseFrame) else SparseFrame(other, spark=self._df.sparkSession)
        if axis == 0:
            if self._labels != other._labels:
                raise NotImplementedError("rows of frames with different columns")
            return vstack([self, other])
        if axis != 1:
            raise ValueError(f"no axis {axis}")
        if how not in HOW:
            raise ValueError(f"how={how!r}")
        return joined(self, other, how, level)

    def add(self, other: SparseFrame, how: str = "outer") -> SparseFrame:
        """Sums of cells with equal index keys and labels; missing rows are 0."""
        from cellweave.frame.align import added

        assert self._labels == other._labels, "frames have different columns"
        if how not in HOW:
            raise ValueError(f"how={how!r}")
        return added(self, other, how)

    # --- partitions

    def map_partitions(self, func: Callable[..., pd.DataFrame], meta: Any = None, **kwargs: Any) -> SparseFrame:
        """func applied to each partition as one pandas table of the wide form; ``meta`` gives the labels of its
        result, by default the same. The result may have any number of rows; index columns come first in it.
        A partition is held whole by its task; ``map_batches`` is for functions of single rows. Positions
        follow the index afterwards."""
        return self._mapped(func, meta, kwargs, whole=True)

    def map_batches(self, func: Callable[..., pd.DataFrame], meta: Any = None, **kwargs: Any) -> SparseFrame:
        """Like map_partitions, with a partition's rows in batches of bounded size, one after the other."""
        return self._mapped(func, meta, kwargs, whole=False)

    def _mapped(self, func: Callable[..., pd.DataFrame], meta: Any, kwargs: dict, whole: bool) -> SparseFrame:
        labels = self.columns if meta is None else tuple(meta.columns if hasattr(meta, "columns") else meta)
        wide, names = self.to_wide(), self.index_labels()
        cells = self._with(labels=labels, refs=labels).wide_labels()
        schema = T.StructType([*(wide.schema[n] for n in names), *(T.StructField(c, T.DoubleType()) for c in cells)])

        def run(batches):
            if whole:
                held = list(batches)
                batches = [pd.concat(held, ignore_index=True)] if held else []
            for pdf in batches:
                out = func(pdf, **kwargs)
                out.columns = [*names, *cells]
                yield out.astype(dict.fromkeys(cells, float))

        made = SparseFrame.from_wide(wide.mapInPandas(run, schema), names, cells)
        return made._with(labels=labels)

    # --- storage

    def to_parquet(self, path: str, mode: str = "errorifexists") -> None:
        from cellweave.sources.native import write

        write(self, path, mode)

    @classmethod
    def read_parquet(cls, path: str, spark: SparkSession | None = None, sorted: bool = False) -> SparseFrame:
        from cellweave.sources.native import read

        return read(spark or SparkSession.active(), path, sorted)

    def to_npz(self, path: str) -> None:
        from cellweave.sources.npz import write

        write(self, path)

    @classmethod
    def read_npz(cls, path: str, spark: SparkSession | None = None, sorted: bool = False) -> SparseFrame:
        from cellweave.sources.npz import read

        return read(spark or SparkSession.active(), path, sorted)

    @classmethod
    def from_pandas(cls, pdf: pd.DataFrame | pd.Series, npartitions: int | None = None, chunksize: int | None = None, spark: SparkSession | None = None) -> SparseFrame:
        """A local table, range-partitioned and sorted by its index."""
        from cellweave.frame.build import from_local

        made = from_local(pdf, None, None, spark or SparkSession.active())
        if chunksize:
            npartitions = -(-len(pdf) // chunksize)
        ranged = made._df.repartitionByRange(npartitions, *made._keys) if npartitions else made._df.repartitionByRange(*made._keys)
        return made._with(df=ranged.sortWithinPartitions(*made._keys))

    vstack = staticmethod(lambda frames: vstack(frames))
    concat = staticmethod(lambda frames, axis=0: concat(frames, axis))


def vstack(frames: Sequence[SparseFrame]) -> SparseFrame:
    """The rows of all frames, one after the other. Labels must be equal."""
    from cellweave.frame.align import stacked

    frames = list(frames)
    assert all(f._labels == frames[0]._labels for f in frames), "frames have different columns"
    return stacked(frames)


def concat(frames: Sequence[SparseFrame], axis: int = 0) -> SparseFrame:
    """axis 0: vstack; axis 1: one outer join after the other."""
    frames = list(frames)
    if axis == 0:
        if any(f._labels != frames[0]._labels for f in frames):
            raise NotImplementedError("rows of frames with different columns")
        return vstack(frames)
    return reduce(lambda a, b: a.join(b, axis=axis, how="outer"), frames)


__all__ = ["SparseFrame", "concat", "empty_map", "vstack"]
