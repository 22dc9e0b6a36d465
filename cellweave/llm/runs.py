"""Runs of repeated consecutive events."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import fold, is_set_time, micros
from cellweave.operators.stretches import stretches
from cellweave.plans import small_broadcast

#: Symbols that are no label: a break between neighbours, and an event that isn't known.
BREAK, UNKNOWN = 0, 1
_REPEATED = re.compile(r"([^\x00\x01])\1+", re.DOTALL)


def symbol_string(label: np.ndarray, joined: np.ndarray) -> tuple[str, np.ndarray]:
    """One code point for each event, and each event's place in the string. Labels are numbered within the
    chunk, so a chunk's labels always fit the code points; surrogates are left out. A break stands before
    each event that isn't joined to the one before it."""
    _, local = np.unique(label, return_inverse=True)
    symbol = local.astype(np.uint32) + 2
    symbol[symbol >= 0xD800] += 0x800
    symbol[label < 0] = UNKNOWN
    breaks = ~joined
    breaks[:1] = False
    place = np.arange(len(label)) + np.cumsum(breaks)
    text = np.full(len(label) + int(breaks.sum()), BREAK, np.uint32)
    text[place] = symbol
    return text.astype("<u4").tobytes().decode("utf-32-le"), place


def _repeats_within(gap_us: int):
    def cut(t: np.ndarray, label: np.ndarray, same: np.ndarray) -> np.ndarray:
        joined = same.copy()
        joined[1:] &= t[1:] - t[:-1] <= gap_us
        text, place = symbol_string(label, joined)
        spans = np.array([m.span() for m in _REPEATED.finditer(text)], dtype=np.int64).reshape(-1, 2)
        first = np.searchsorted(place, spans[:, 0])  # a run holds no break: its places are consecutive
        change = np.zeros(len(t) + 1, np.int64)
        np.add.at(change, first + 1, 1)
        np.add.at(change, first + spans[:, 1] - spans[:, 0], -1)
        inside = np.cumsum(change[:-1]) > 0
        return np.maximum.accumulate(np.where(inside, 0, np.arange(len(t))))

    return cut


def canonical_labels(types: DataFrame, kind: str = "c_idx", label: str = "cols") -> DataFrame:
    """(kind, canon, label): the folded label of each type and the least type with that label. Null and
    blank labels are one label, ''."""
    named = types.filter(F.col(kind).isNotNull()).select(F.col(kind), F.coalesce(fold(label), F.lit("")).alias("label")).distinct()
    # A label's types are few; the window needs no join, so the table's size estimate stays that of types.
    least = F.min(kind).over(Window.partitionBy("label")).cast("int")
    return named.select(kind, least.alias("canon"), "label")


def collapsed_runs(
    events: DataFrame, types: DataFrame, gap_seconds: float = 600, least: int = 1, entity: str = "uuids", time: str = "timestamps", event: str = "r_idx", kind: str = "c_idx", label: str = "cols"
) -> DataFrame:
    """Each entity's ordered events with every run of equal labels collapsed into one row (entity, label,
    first_r_idx, last_r_idx, started_at, ended_at, seconds, n_events); single events are runs of one.
    ``least`` = 2 gives the repetitions alone.

    A run is a longest stretch of neighbouring known events of one entity with equal folded labels and no
    step over the gap; a step of exactly the gap stays in the run. Labels become code points, each range of
    the ordered events one string with breaks at pauses, and a backreference pattern matches the
    repetitions; runs at the ranges' edges are joined afterwards.

    Rows with a null entity, event id or time, or an unset time (1970-01-01 00:00:00), are no events and
    don't part a run. Events whose type is null or isn't listed belong to no run, end the one before them
    and come out alone with a null label. Repeated deliveries count once; equal times are ordered by event
    id. Empty events give no row. Other columns are ignored.
    """
    of = events.schema[time].dataType.simpleString()
    canon = small_broadcast(canonical_labels(types, kind, label).select(F.col(kind).alias("k"), "canon"))
    rows = (
        events.filter(F.col(entity).isNotNull() & F.col(event).isNotNull() & is_set_time(time, of))
        .select(F.col(entity).cast("string").alias("key"), F.col(time).alias("t"), F.col(event).cast("bigint").alias("id"), F.col(kind).alias("k"))
        .join(canon, "k", "left")
        .select("key", "t", "id", F.coalesce("canon", F.lit(-1)).alias("label"))
    )
    gap_us = round(gap_seconds * 1e6)
    follows = (F.col("label") >= 0) & (F.col("label") == F.col("prev_label")) & (micros("first_t") - micros("prev_t") <= F.lit(gap_us))
    found = stretches(rows, _repeats_within(gap_us), follows, least=least)
    names = small_broadcast(canonical_labels(types, kind, label).select("canon", F.col("label").alias("name")).distinct())
    return found.join(names, F.col("label") == F.col("canon"), "left").select(
        F.col("key").alias(entity),
        F.col("name").alias("label"),
        F.col("first_id").alias("first_r_idx"),
        F.col("last_id").alias("last_r_idx"),
        F.col("first_t").alias("started_at"),
        F.col("last_t").alias("ended_at"),
        ((micros("last_t") - micros("first_t")) / F.lit(1e6)).alias("seconds"),
        F.col("n").alias("n_events"),
    )
