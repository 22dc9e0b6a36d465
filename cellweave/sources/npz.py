"""Frames as npz archives of a compressed sparse row matrix: data, indices, indptr, shape, frame_index and
frame_columns. Archives are found and read by the engine, so a pattern may name any file system it knows; many
are read in parallel, one task an archive. Writing is for frames whose non-zero cells fit the driver, one
archive being one file there."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.frame.core import SparseFrame, _checked
from cellweave.frame.layout import CELLS, MAP, fresh


def write(frame: SparseFrame, path: str) -> None:
    """One archive. Rows come in the frame's order; no dense row is made."""
    f = frame._rows()
    if len(f._keys) != 1:
        raise ValueError("an archive has one index column; use Parquet for several")
    order = f._order
    f = f._as_map()
    rows = f._df.orderBy(*order) if order else f._df
    t = _checked(lambda: rows.select(F.col(f._keys[0]).alias("k"), F.map_keys(CELLS).alias("c"), F.map_values(CELLS).alias("v")).toArrow()).combine_chunks()
    n = t.num_rows
    index = t.column("k").to_pandas().to_numpy()
    per = t.column("c").combine_chunks()
    per = per if isinstance(per, pa.Array) else pa.concat_arrays(per.chunks)
    values = t.column("v").combine_chunks()
    values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
    size = per.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
    cols, data = per.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.flatten().to_numpy(zero_copy_only=False)
    at = np.lexsort((cols, np.repeat(np.arange(n), size)))
    labels = list(f._labels)
    columns = np.array([str(c) for c in labels]) if any(isinstance(c, str) for c in labels) else np.array(labels)
    np.savez(path, data=data[at], indices=cols[at], indptr=np.concatenate([[0], np.cumsum(size)]), shape=np.array([n, len(labels)]), frame_index=index if index.dtype != object else index.astype(str), frame_columns=columns)


def _header(z) -> tuple[str, str]:
    """Labels as text, and the kind of the index, of an archive."""
    return json.dumps(z["frame_columns"].tolist(), default=str), z["frame_index"].dtype.kind


def _headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            with np.load(io.BytesIO(content)) as z:
                labels, kind = _header(z)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([labels]), pa.array([kind])], names=["path", "labels", "kind"])


def _rows(key: pa.DataType, labels: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with np.load(io.BytesIO(content)) as z:  # pickled archives are refused
                    if _header(z)[0] != labels:
                        raise ValueError(f"archives have different columns: {path}")
                    indptr, indices, data, index = (z[k] for k in ("indptr", "indices", "data", "frame_index"))
                n = len(indptr) - 1
                cells = pa.MapArray.from_arrays(pa.array(indptr.astype(np.int32)), pa.array(indices.astype(np.int32)), pa.array(data.astype(float)))
                keys = pa.array(index[:n].astype("datetime64[us]") if index.dtype.kind == "M" else index[:n]).cast(key)
                yield pa.RecordBatch.from_arrays([keys, pa.array([path] * n, pa.string()), pa.array(np.arange(n)), cells], names=["k", "p", "r", CELLS])

    return run


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each archive of a pattern. FileNotFoundError if there is none."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from None
        raise


def read(spark: SparkSession, path: str, sorted: bool = False) -> SparseFrame:
    """All archives of a pattern, in the order of their paths. Their columns must be equal, in equal order, else
    a ValueError when the frame is computed. With ``sorted`` their index ranges must be ascending and disjoint,
    else ValueError; that, and reading the first archive's labels, runs a job."""
    files = archives(spark, path)
    first = files.select("path").agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(path)
    about = files.filter(F.col("path") == first).mapInArrow(_headers, "path string, labels string, kind string").first()
    labels, kind = json.loads(about["labels"]), about["kind"]
    arrow, of = {"i": (pa.int64(), T.LongType()), "u": (pa.int64(), T.LongType()), "f": (pa.float64(), T.DoubleType()), "M": (pa.timestamp("us"), T.TimestampNTZType())}.get(kind, (pa.string(), T.StringType()))
    schema = T.StructType([T.StructField("k", of), T.StructField("p", T.StringType()), T.StructField("r", T.LongType()), T.StructField(CELLS, T.MapType(T.IntegerType(), T.DoubleType()))])
    rows = files.mapInArrow(_rows(arrow, about["labels"]), schema)
    if sorted:
        if kind not in "iufM":
            raise ValueError("sorted archives need a numeric or time index")
        step = rows.withColumn("before", F.lag("k").over(Window.partitionBy("p").orderBy("r")))
        ends = npz_bounds(rows)
        crossing = ends.withColumn("before", F.lag("istop").over(Window.orderBy("part")))  # one row a file
        if not _checked(step.filter("before > k").isEmpty) or not crossing.filter("before >= istart").isEmpty():
            raise ValueError("archives aren't sorted by their index")
    key, p, r = fresh("i"), fresh("o"), fresh("o")
    cells = F.map_filter(CELLS, lambda k, v: v != 0).alias(CELLS)
    return SparseFrame._made(rows.select(F.col("k").alias(key), F.col("p").alias(p), F.col("r").alias(r), cells), [(None, key)], [p, r], labels, range(len(labels)), MAP)


def npz_bounds(rows: DataFrame) -> DataFrame:
    """(part, istart, istop): the least and greatest key of each archive."""
    return rows.groupBy(F.col("p").alias("part")).agg(F.min("k").alias("istart"), F.max("k").alias("istop"))
