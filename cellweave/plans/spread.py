"""Splits of an input, and parallelism of CPU-bound steps over few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def input_splits(df: DataFrame) -> int:
    """Splits in which the rows of a plan arrive, found without running any job: a plan of scans has its
    scans' splits; one that shuffles has at most the configured number."""
    run = df._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString():
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return run.toRdd().getNumPartitions()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df itself if it is read in at least as many splits as there are cores; else df spread over the cores
    by its keys, so that one large file doesn't leave all but one of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if input_splits(df) >= cores else df.repartition(cores, *keys)
