"""Key ranges of a table's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def division_bounds(df: DataFrame, part: str | Column, key: str) -> DataFrame:
    """(part, istart, istop): the least and greatest key of each part. Parts without a key have nulls."""
    part = F.col(part) if isinstance(part, str) else part
    return df.groupBy(part).agg(F.min(key).alias("istart"), F.max(key).alias("istop"))


def check_sorted(df: DataFrame, key: str) -> DataFrame:
    """The bounds of each file of a table, in key order. ValueError unless the files' ranges are disjoint."""
    bounds = division_bounds(df, F.input_file_name().alias("part"), key)
    before = F.lag("istop").over(Window.orderBy("istart", "istop"))  # one row a file
    crossing = bounds.withColumn("before", before).filter("before >= istart")
    if not crossing.isEmpty():
        raise ValueError("files overlap in their keys")
    return bounds
