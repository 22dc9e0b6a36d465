"""One-hot sums kept up to date over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_one_hot_sums(stream: DataFrame, column: str, categories: Sequence, keys: Sequence[str], time: str, every: str, late: str) -> DataFrame:
    """(window_start, keys, a double column for each category): how often each category occurred for each
    key in each window of length ``every``. Events later than ``late`` behind the watermark are dropped by
    the engine once their window is final; others are counted wherever they belong. Null and unlisted
    categories are zeros. Works on a static table too."""
    of = F.window(F.col(time).cast("timestamp"), every)
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    sums = [F.sum(F.coalesce((F.col(column) == F.lit(c)).cast("double"), F.lit(0.0))).alias(str(c)) for c in categories]
    grouped = timed.groupBy(of.alias("w"), *keys).agg(*sums)
    return grouped.select(F.col("w.start").alias("window_start"), *keys, *(f"`{c}`" for c in categories))
