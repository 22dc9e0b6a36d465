"""Distinct identifiers per group and combination of groups, from mergeable partial results.

Identifiers are hashed to 64 bits and the hash range is cut into disjoint buckets. A state is the set of
(bucket, hash, groups) that occur. All rows of an identifier lie in one bucket, so each bucket's counts are
exact for any combination of groups, and counts of different buckets add up. States of different days, or
of different files, are put together by union.

The only error is a collision of hashes: n different identifiers are counted too low by n * (n - 1) / 2**65
in expectation (0.03 for a billion), and never too high.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary digits of the hash that name its bucket.
BUCKET_BITS = 12


def error_bound(n: float) -> float:
    """Expected number of identifiers missed among n different ones."""
    return n * max(0.0, n - 1) / 2**65


def distinct_state(df: DataFrame, identifier: Column, groups: Mapping[str, Column], bits: int = BUCKET_BITS) -> DataFrame:
    """The state of df: distinct rows (bucket, h, groups).

    Rows with a null identifier are left out; null groups are kept. Groups called bucket or h are a ValueError. Repetitions are removed before the
    shuffle, so an identifier with a third of all rows sends one row a group and input split.
    """
    if {"bucket", "h"} & set(groups):
        raise ValueError("groups can't be called bucket or h")
    named = df.select(identifier.alias("__id"), *(c.alias(g) for g, c in groups.items())).filter("__id IS NOT NULL")
    h = F.xxhash64("__id")
    hashed = named.select(F.shiftrightunsigned(h, 64 - bits).cast("int").alias("bucket"), h.alias("h"), *groups)
    return hashed.distinct()


def merge_states(states: Sequence[DataFrame]) -> DataFrame:
    """One state of several with the same groups and bucket bits."""
    return reduce(DataFrame.unionByName, states).distinct()


def regrouped(state: DataFrame, groups: Mapping[str, Column]) -> DataFrame:
    """The state of coarser groups, such as weeks of days, computed from a state alone."""
    return state.select("bucket", "h", *(c.alias(g) for g, c in groups.items())).distinct()


def distinct_counts(state: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(grouping, groups, n_distinct): the number of different identifiers of each group of each set, where
    ``grouping`` names the set's groups joined by '+' ('' for the whole) and groups outside it are null.

    A row with a null group counts only in sets without that group. An empty state gives no row.
    """
    groups = [c for c in state.columns if c not in ("bucket", "h")]
    unknown = {g for s in sets for g in s} - set(groups)
    if unknown:
        raise ValueError(f"no such groups: {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in state.schema.fields}
    member = [
        F.when(
            reduce(Column.__and__, (F.col(g).isNotNull() for g in s), F.lit(True)),
            F.struct(F.lit("+".join(s)).alias("grouping"), *((F.col(g) if g in s else F.lit(None).cast(kinds[g])).alias(g) for g in groups)),
        )
        for s in sets
    ]
    # All of these but the last aggregation keep the partitioning by bucket.
    each = state.repartition("bucket").select("bucket", "h", F.explode(F.array_compact(F.array(*member))).alias("m")).select("bucket", "h", "m.grouping", *(f"m.{g}" for g in groups))
    by_bucket = each.distinct().groupBy("bucket", "grouping", *groups).agg(F.count(F.lit(1)).alias("n"))
    return by_bucket.groupBy("grouping", *groups).agg(F.sum("n").alias("n_distinct"))
