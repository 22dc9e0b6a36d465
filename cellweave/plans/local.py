"""Local columns as tables, without an object for each value on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.plans.materialize import new_path

#: Values of a row that is sent to the executors, which take it apart.
_CHUNK = 1 << 16
#: Bytes of values that go with a plan. The optimizer sees few rows there and broadcasts them, so they are few.
SENT_BYTES = 1 << 20
#: Bytes of a part of the values that are written.
PART_BYTES = 8 << 20


def _sent(values: pa.Array, first: int, place: str, name: str, spark: SparkSession) -> DataFrame:
    starts = np.arange(0, len(values), _CHUNK)
    lists = pa.ListArray.from_arrays(pa.array([*starts, len(values)], pa.int32()), values)
    table = spark.createDataFrame(pa.table({"__first": pa.array(starts + first, pa.int64()), "__values": lists}))
    return table.select("__first", F.posexplode("__values").alias("__at", name)).select((F.col("__first") + F.col("__at")).alias(place), name)


def local_column(spark: SparkSession, values: pa.Array, place: str, name: str) -> DataFrame:
    """(place, name): local values with their places from 0. Many values are written to the shared folder part
    by part, so that beside the values the driver holds one part only. Runs a job for each part."""
    size = max(values.nbytes, 8 * len(values))  # booleans take bits here, but rows as others do
    if size <= SENT_BYTES:
        return _sent(values, 0, place, name, spark)
    path, step = new_path(spark, "local"), max(1, len(values) * PART_BYTES // size)
    for first in range(0, len(values), step):
        part = _sent(values.slice(first, step), first, place, name, spark)
        part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)
