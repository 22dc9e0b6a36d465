"""Sessions: each entity's events, parted by pauses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import is_set_time, micros
from cellweave.operators.stretches import doubled_roots, stretches


def _linked_within(gap_us: int):
    def cut(t: np.ndarray, label, same: np.ndarray) -> np.ndarray:
        near = same.copy()
        near[1:] &= t[1:] - t[:-1] <= gap_us
        return doubled_roots(near)

    return cut


def sessions(events: DataFrame, gap_seconds: float = 1800, entity: str = "uuids", time: str = "timestamps", event: str = "r_idx") -> DataFrame:
    """One row (entity, first_r_idx, last_r_idx, started_at, ended_at, seconds, n_events) for each session: a
    longest stretch of one entity's events, ordered by time and event id, in which no step exceeds the gap.
    A step of exactly the gap stays in the session.

    Each event is linked to its predecessor within the gap; pointers are doubled until the roots are stable,
    first within each range of events and then, by self-joins, across the ranges' edges; sessions are the
    groups of one root.

    Rows with a null entity, a null or unset time (1970-01-01 00:00:00) or a null event id are no events. An
    event delivered again with equal content counts once. Equal times are ordered by event id. An empty input
    gives no session; other columns of the input are ignored.
    """
    kind = events.schema[time].dataType.simpleString()
    rows = events.filter(F.col(entity).isNotNull() & F.col(event).isNotNull() & is_set_time(time, kind)).select(
        F.col(entity).cast("string").alias("key"), F.col(time).alias("t"), F.col(event).cast("bigint").alias("id")
    )
    gap_us = round(gap_seconds * 1e6)
    follows = micros("first_t") - micros("prev_t") <= F.lit(gap_us)
    found = stretches(rows, _linked_within(gap_us), follows)
    return found.select(
        F.col("key").alias(entity),
        F.col("first_id").alias("first_r_idx"),
        F.col("last_id").alias("last_r_idx"),
        F.col("first_t").alias("started_at"),
        F.col("last_t").alias("ended_at"),
        ((micros("last_t") - micros("first_t")) / F.lit(1e6)).alias("seconds"),
        F.col("n").alias("n_events"),
    )
