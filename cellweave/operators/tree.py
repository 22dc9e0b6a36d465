"""Per-key aggregates in which no task receives all partial states of a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.plans import input_splits

#: Partial states of a key that one task merges in a round.
FAN_IN = 8

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: Mapping[str, tuple[str, Column]], fan_in: int = FAN_IN) -> DataFrame:
    """One row (keys, states) for each key. ``states`` maps a name to ("count" | "sum" | "min" | "max",
    column); a count counts the non-null values of its column.

    The input's scan splits are the fixed-size chunks. Each is combined where it is read, so that a chunk
    sends one state a key however many rows the key has; states are then merged in rounds, ``fan_in`` chunks
    of a key to a task, until one is left. The number of rounds is the logarithm of the number of chunks.

    Null keys form a key of their own. Sums, minima and maxima without a non-null value are null. An empty
    input gives no row; other columns are ignored, and input columns may be called like the states.
    """
    for op, _ in states.values():
        if op not in _FIRST:
            raise ValueError(f"unknown state {op!r}")
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    names = [f"__s{i}" for i in range(len(states))]
    rows = df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c.alias(n) for n, (_, c) in zip(names, states.values())))
    by = [f"__k{i}" for i in range(len(keys))]
    chunks = max(1, input_splits(rows))
    rows = rows.withColumn("__chunk", F.spark_partition_id())
    first = True
    while True:
        chunks = -(-chunks // fan_in)
        group = [*by, *([F.expr(f"__chunk div {fan_in}").cast("int").alias("__chunk")] if chunks > 1 else [])]
        ops = _FIRST if first else _MERGE
        rows, first = rows.groupBy(*group).agg(*(ops[op](n).alias(n) for n, (op, _) in zip(names, states.values()))), False
        if chunks <= 1:
            break
    return rows.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), *(F.col(n).alias(out) for n, out in zip(names, states)))
