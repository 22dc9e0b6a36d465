"""Frames as Parquet: the index columns under their names, the cells as columns or a map, and one row of
labels beside them. Reading prunes columns and row groups like any Parquet table."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellweave.frame.core import SparseFrame
from cellweave.frame.layout import CELLS, MAP, WIDE, fresh
from cellweave.sources.divisions import check_sorted


def write(frame: SparseFrame, path: str, mode: str = "errorifexists") -> None:
    f = frame._rows()
    names = f.index_labels()
    keys = [F.col(p).alias(n) for p, n in zip(f._keys, names)]
    if f._layout == WIDE:
        cells = [F.col(r).alias(f"c{i}") for i, r in enumerate(f._refs)]
    else:
        cells = [F.col(CELLS).alias("cells")]
        f = f._as_map()
    f._df.select(*keys, *cells).write.mode(mode).parquet(f"{path}/rows")
    about = json.dumps({"index": [n if n is None else str(n) for n, _ in f._index], "names": names, "labels": list(f._labels), "layout": f._layout, "unique": f._unique}, default=str)
    f._df.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.mode(mode).text(f"{path}/labels")


def read(spark: SparkSession, path: str, sorted: bool = False) -> SparseFrame:
    """With ``sorted``, files must have disjoint ranges of the first index column, else ValueError."""
    about = json.loads(spark.read.text(f"{path}/labels").first()[0])
    df = spark.read.parquet(f"{path}/rows")
    if sorted:
        check_sorted(df, about["names"][0])
    keys = [(n, fresh("i")) for n in about["index"]]
    kept = [F.col(f"`{c}`").alias(p) for c, (_, p) in zip(about["names"], keys)]
    n = len(about["labels"])
    if about["layout"] == WIDE:
        refs = [fresh("c") for _ in range(n)]
        cells = [F.col(f"c{i}").alias(r) for i, r in enumerate(refs)]
    else:
        refs, cells = range(n), [F.col("cells").alias(CELLS)]
    return SparseFrame._made(df.select(*kept, *cells), keys, [p for _, p in keys], about["labels"], refs, about["layout"] if about["layout"] == WIDE else MAP, about["unique"])
