"""Size checks in front of every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest table, by the optimizer's own statistics, that may be broadcast.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, taken without running a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint when its checked size is within the limit; df itself beyond, so that the
    join becomes a shuffled one."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
