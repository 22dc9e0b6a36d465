"""Contiguous global row positions without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.plans.materialize import materialize

#: Binary digits of monotonically_increasing_id that number the rows of a partition; the others name it.
_ROW_BITS = 33


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "_pos") -> DataFrame:
    """Append ``name``: the 0-based position of each row in the given order. Runs a job.

    Rows are range-partitioned on the order, sorted and numbered within each partition, and the
    partitions' row counts, one row each, give the offsets. The numbered table is written once, so that
    counts and rows come from the same partitioning. Ties in the order are numbered in any order; give a
    unique order for a repeatable result.
    """
    keys = _columns(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), "position")
    part, row = F.shiftright("__id", _ROW_BITS).cast("int"), F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = local.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return local.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, row + F.col("__off")).drop("__part", "__off", "__id")


def first_positions(df: DataFrame, order: Sequence[str | Column], n: int, name: str = "_pos") -> DataFrame:
    """The first n rows in the given order with their positions, as with_position gives them. Each partition
    keeps its own first n rows, of which one task takes the first; meant for an n that a task can hold."""
    keys = _columns(order)
    return df.orderBy(*keys).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("bigint") - 1)
