"""Building frames: one-hot columns, event matrices, local data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.frame.core import SparseFrame
from cellweave.frame.labels import Labels
from cellweave.frame.layout import CELLS, COL, MAP, WIDE, WIDE_LIMIT, empty_map, fresh
from cellweave.plans import local_column
from cellweave.plans.sizes import BROADCAST_BYTES


def label_table(spark: SparkSession, labels: Iterable, kind: str, name: str, col: str = COL) -> DataFrame:
    """(name, col): labels and their places; broadcast if their checked size allows it. Those over a size are
    written to the shared folder."""
    labels = Labels(labels)
    table = local_column(spark, labels.arrow(), "__at", "__each").select(F.col("__each").cast(kind).alias(name), F.col("__at").cast("int").alias(col))
    size = sum(len(str(x)) + 32 for x in labels)
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def labelled(rows: DataFrame, labels: Sequence, name: str) -> DataFrame:
    """Rows with a column of their places' labels. Integer labels stay integers, others become strings."""
    labels = Labels(labels)
    whole = labels.whole
    table = label_table(rows.sparkSession, (int(x) if whole else str(x) for x in labels), "bigint" if whole else "string", name)
    return rows.join(table, COL)


def column_ids(df: DataFrame, col: str, columns: Sequence | None) -> tuple[Labels, DataFrame]:
    """The labels, and df with the place of each row's label in COL; null for a null label. Labels that
    aren't given are collected in ascending order: the frame's column list lives on the driver."""
    kind = df.schema[col].dataType
    if columns is None:
        columns = [r[0] for r in df.select(col).distinct().filter(F.col(col).isNotNull()).orderBy(col).collect()]
    columns = Labels(columns)
    table = label_table(df.sparkSession, columns, kind.simpleString(), "__label")
    coded = df.join(table, F.col(col) == F.col("__label"), "left").filter(_known(F.col(col).isNull() | F.col("__label").isNotNull(), col))
    return columns, coded


def _known(condition: Column, col: str) -> Column:
    """A filter that keeps every row and fails where the condition doesn't hold; unlike a column it can't be
    pruned away."""
    message = F.concat(F.lit("unknown category: "), F.coalesce(F.col(col).cast("string"), F.lit("null")))
    return F.assert_true(condition, message).isNull()


def one_hot(df: DataFrame, column: str, categories: Sequence, index_col: str | Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> SparseFrame:
    """One row for each row of df with 1 at its category. Categories without rows are columns of zeros; a
    null or unlisted category fails as ValueError when the frame is computed. Lazy. Works on streams."""
    categories = list(categories)
    index = [index_col] if isinstance(index_col, str) else list(index_col or [])
    keys, order = [(c, fresh("i")) for c in index], [(c, fresh("o")) for c in order_by or []]
    kept = [F.col(c).alias(p) for c, p in [*keys, *order]]
    by = [p for _, p in order] or [p for _, p in keys]
    if len(categories) <= WIDE_LIMIT:
        cells = [fresh("c") for _ in categories]
        checked = df.filter(_known(F.coalesce(F.col(column).isin(categories), F.lit(False)), column))
        base = checked.select(*kept, *((F.col(column) == F.lit(x)).cast("double").alias(c) for x, c in zip(categories, cells)))
        return SparseFrame._made(base, keys, by, categories, cells, WIDE)
    table = label_table(df.sparkSession, categories, df.schema[column].dataType.simpleString(), "__label")
    coded = df.join(table, F.col(column) == F.col("__label"), "left").filter(_known(F.col("__label").isNotNull(), column))
    return SparseFrame._made(coded.select(*kept, F.create_map(F.col(COL), F.lit(1.0)).alias(CELLS)), keys, by, categories, range(len(categories)), MAP)


def event_matrix(df: DataFrame, uuid: str, ts: str, field: str, ts_unit: str = "s", order_by: Sequence[str] = ()) -> SparseFrame:
    """One row for each event, one-hot in one field, with the index (uuid, ts). Columns are the field's
    values in the order of their first event by (uuid, ts, order_by), found by one job; '' is one column; an
    event without the field is a row of zeros. Integer times count ``ts_unit``s (s, ms, us) since 1970."""
    if isinstance(df.schema[ts].dataType, T.IntegralType):
        scale = {"s": 1_000_000, "ms": 1000, "us": 1}[ts_unit]
        df = df.withColumn(ts, F.timestamp_micros(F.col(ts).cast("bigint") * scale))
    order = [uuid, ts, *order_by]
    first = df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.min(F.struct(*order)).alias("__first"))
    labels = [r[0] for r in first.orderBy("__first").select(field).collect()]
    table = label_table(df.sparkSession, labels, df.schema[field].dataType.simpleString(), "__label")
    keys = [(c, fresh("i")) for c in (uuid, ts)]
    ords = [(c, fresh("o")) for c in order]
    coded = df.join(table, F.col(field) == F.col("__label"), "left")
    cells = F.when(F.col(COL).isNotNull(), F.create_map(F.coalesce(COL, F.lit(0)), F.lit(1.0))).otherwise(empty_map())
    base = coded.select(*(F.col(c).alias(p) for c, p in [*keys, *ords]), cells.alias(CELLS))
    return SparseFrame._made(base, keys, [p for _, p in ords], labels, range(len(labels)), MAP)


def from_local(data: Any, index: Any, columns: Sequence | None, spark: SparkSession) -> SparseFrame:
    """A frame of driver-sized data: array, list, pandas DataFrame or Series, or a sparse matrix with
    tocoo(). Rows keep their order. Cells that aren't numbers raise TypeError."""
    if isinstance(data, pd.Series):
        data = data.to_frame(data.name if data.name is not None else 0)
    if isinstance(data, pd.DataFrame):
        index, columns, data = data.index, list(data.columns), data.to_numpy()
    entries = None
    if hasattr(data, "tocoo"):
        coo = data.tocoo()
        shape, entries = coo.shape, (np.asarray(coo.row), np.asarray(coo.col), np.asarray(coo.data, float))
    else:
        data = np.asarray(data)
        if data.dtype == object or data.dtype.kind not in "biufc":
            try:
                data = data.astype(float)
            except (TypeError, ValueError):
                raise TypeError("cells must be numbers") from None
        if data.ndim > 2:
            raise ValueError("a frame has two dimensions")
        if data.size == 0 and columns is not None:
            data = data.reshape(len(index) if index is not None else 0, len(columns)) if data.ndim < 2 else data
        elif data.ndim < 2:
            data = data.reshape(-1, 1)
        shape = data.shape
        at = np.nonzero(data)
        entries = (*at, data[at].astype(float))
    index = pd.RangeIndex(shape[0]) if index is None else index if isinstance(index, pd.Index) else pd.Index(index)
    columns = list(range(shape[1])) if columns is None else list(columns)
    if len(index) != shape[0] or len(columns) != shape[1]:
        raise ValueError(f"{shape[0]} rows and {shape[1]} columns, but {len(index)} and {len(columns)} labels")
    levels = [index.get_level_values(i) for i in range(index.nlevels)]
    keys, pos = [(level.name, fresh("i")) for level in levels], fresh("o")
    order = np.argsort(entries[0], kind="stable")
    r, c, v = (x[order] for x in entries)
    nz = v != 0
    r, c, v = r[nz], c[nz], v[nz]
    cuts = np.searchsorted(r, np.arange(shape[0] + 1))
    cells = []
    for i in range(shape[0]):
        row: dict[int, float] = {}
        for k, x in zip(c[cuts[i] : cuts[i + 1]].tolist(), v[cuts[i] : cuts[i + 1]].tolist()):
            row[k] = row.get(k, 0.0) + x
        cells.append(list(row.items()))
    fields = [T.StructField(p, _kind(level)) for (_, p), level in zip(keys, levels)]
    schema = T.StructType([*fields, T.StructField(pos, T.LongType()), T.StructField("__e", T.ArrayType(T.StructType([T.StructField("key", T.IntegerType()), T.StructField("value", T.DoubleType())])))])
    rows = list(zip(*(map(_plain, level) for level in levels), range(shape[0]), cells)) if shape[0] else []
    df = spark.createDataFrame(rows, schema).select(*(p for _, p in keys), pos, F.map_from_entries("__e").alias(CELLS))
    made = SparseFrame._made(df, keys, [pos], columns, range(len(columns)), MAP)
    return made._as_wide() if len(columns) <= WIDE_LIMIT else made


def _kind(level: pd.Index) -> T.DataType:
    if isinstance(level, pd.DatetimeIndex):
        return T.TimestampNTZType()
    return {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType()}.get(level.dtype.kind, T.StringType())


def _plain(x: Any) -> Any:
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return x.item() if isinstance(x, np.generic) else x if x is None or isinstance(x, (int, float, bool)) else str(x)
