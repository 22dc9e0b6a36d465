"""One row per entity with the totals of every event type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions import is_set_time, micros
from cellweave.plans import small_broadcast

#: Types whose presence one word holds.
_WORD = 64


def entity_features(
    events: DataFrame,
    entities: DataFrame,
    types: Sequence[int],
    as_of: Column | None = None,
    recency_per_type: bool = False,
    layout: str = "wide",
    salts: int | None = None,
    entity: str = "uuids",
    kind: str = "c_idx",
    time: str = "timestamps",
    event: str = "r_idx",
) -> DataFrame:
    """One row (entity, n_events, last_at, seconds_since_last, then the types) for each row of ``entities``,
    those without events included.

    Layout "wide" gives a column c_<type> with the total for each type (and s_<type>, the seconds since the
    last one, if ``recency_per_type``); layout "map" gives one map column ``totals`` of the types that occur;
    layout "long" gives rows (entity, type, n, last_at) instead, one for each entity and each listed type,
    zeros included. The type list is a schema, so it is held on the driver.

    Two stages: rows are spread by (entity, type, salt of the event id) and each part's repeated deliveries
    are removed, counted and reduced to its last time; the parts' partial statistics, at most ``salts`` for a
    pair, are then merged by entity and expanded to the complete type list. ``salts`` is by default the
    number of shuffle partitions, so that a pair with most of the rows is spread over all tasks, however many
    the data need. Expansion looks at one bit of each column, and at a number only where the type occurs.

    Known events count: non-null entity, event id and listed type, and a time neither null nor unset
    (1970-01-01 00:00:00). An event delivered again with equal content counts once. ``as_of`` is by default
    the latest set time of ``events``, for which that column is read first; seconds are null for an entity
    without events. An entity that is null gets a row of zeros; entities listed twice get two rows. Other
    columns are ignored. Empty events give zeros; empty entities give no row.
    """
    if layout not in ("wide", "map", "long"):
        raise ValueError(f"layout {layout!r}: expected 'wide', 'map' or 'long'")
    types = sorted({int(t) for t in types})
    salts = salts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of, key_of = events.schema[time].dataType.simpleString(), events.schema[kind].dataType
    timed = events.filter(is_set_time(time, of))
    rows = timed.filter(F.col(entity).isNotNull() & F.col(event).isNotNull() & F.col(kind).isin(types)).select(
        F.col(entity).alias("__e"), F.col(kind).alias("__k"), F.col(time).alias("t"), F.col(event).alias("id")
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).repartition("__e", "__k", "salt")
    once = salted.groupBy("__e", "__k", "salt", "id").agg(F.max("t").alias("t"))
    parts = once.groupBy("__e", "__k", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"))
    pairs = parts.drop("salt").repartition("__e").groupBy("__e", "__k").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    per = F.sort_array(F.collect_list(F.struct("__k", "n", "last")))
    if layout == "long":
        listed = entities.select(entity).join(pairs.groupBy("__e").agg(per.alias("__p")), F.col(entity) == F.col("__e"), "left")
        return _expanded(listed, types, key_of, entity, kind)
    # Whether a type occurs is a bit, of the type's place in the list, in one of a few words.
    words = [f"__w{i}" for i in range(-(-len(types) // _WORD))] if layout == "wide" else []
    placed = pairs.join(_places(events, types, key_of), "__k") if words else pairs
    has = [F.bit_or(F.when(F.expr(f"__at div {_WORD} = {i}"), F.expr(f"shiftleft(1L, __at % {_WORD})")).otherwise(F.lit(0).cast("bigint"))).alias(w) for i, w in enumerate(words)]
    merged = placed.groupBy("__e").agg(F.sum("n").alias("__n"), F.max("last").alias("__last"), per.alias("__p"), *has)
    base = entities.select(entity).join(merged, F.col(entity) == F.col("__e"), "left")
    now = micros(as_of) if as_of is not None else timed.agg(micros(F.max(time))).scalar()
    out = [
        F.col(entity),
        F.coalesce(F.col("__n"), F.lit(0)).alias("n_events"),
        F.col("__last").alias("last_at"),
        ((now - micros("__last")) / F.lit(1e6)).alias("seconds_since_last"),
    ]
    if layout == "map":
        totals = F.map_from_entries(F.transform("__p", lambda x: F.struct(x["__k"], x["n"])))
        return base.select(*out, F.coalesce(totals, F.create_map().cast(T.MapType(key_of, T.LongType()))).alias("totals"))
    # The numbers of the types that occur, in the list's order, and how many lie in front of each word.
    facts = [F.col("__p"), *(F.coalesce(w, F.lit(0)).alias(w) for w in words)]
    before = [f"cast({' + '.join(f'bit_count({w})' for w in words[:i]) or '0'} AS int) AS __b{i}" for i in range(len(words))]
    if recency_per_type:
        facts += [F.transform("__p", lambda x: micros(x["last"])).alias("__l"), now.alias("__now")]
    # One parsed string a column: hundreds of columns built call by call take the driver seconds.
    has_it = [f"(shiftrightunsigned(__w{i // _WORD}, {i % _WORD}) & 1L) = 1L" for i in range(len(types))]
    place = [f"__b{i // _WORD} + bit_count(__w{i // _WORD} & {(1 << i % _WORD) - 1}L)" for i in range(len(types))]
    wide = [f"if({h}, __p[{p}].n, 0L) AS c_{t}" for t, h, p in zip(types, has_it, place)]
    wide += [f"if({h}, (__now - __l[{p}]) / 1e6D, NULL) AS s_{t}" for t, h, p in zip(types, has_it, place)] if recency_per_type else []
    return base.select(*out, *facts).selectExpr("*", *before).selectExpr(f"`{entity}`", "n_events", "last_at", "seconds_since_last", *wide)


def _places(events: DataFrame, types: Sequence[int], key_of: T.DataType) -> DataFrame:
    """(__k, __at): the place of each type in the list, which is as small as the result's schema."""
    listed = events.sparkSession.createDataFrame([(t, i) for i, t in enumerate(types)], "k bigint, __at int")
    return small_broadcast(listed.select(F.col("k").cast(key_of).alias("__k"), "__at"))


def _expanded(listed: DataFrame, types: Sequence[int], key_of: T.DataType, entity: str, kind: str) -> DataFrame:
    """(entity, type, n, last_at) for each listed type of each entity, from the sorted statistics of those
    that occur: these are filled up with the others, which are the list without them."""
    every = F.lit(list(types)).cast(T.ArrayType(key_of))
    known = F.coalesce("__p", F.array().cast(listed.schema["__p"].dataType))
    last_of = listed.schema["__p"].dataType.elementType["last"].dataType
    zero = F.transform(F.array_except(every, F.coalesce(F.col("__p")["__k"], F.array().cast(T.ArrayType(key_of)))), lambda k: F.struct(k.alias("__k"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(last_of).alias("last")))
    rows = listed.select(F.col(entity).alias("__e"), F.explode(F.concat(known, zero)).alias("x"))
    return rows.select(F.col("__e").alias(entity), F.col("x.__k").alias(kind), F.col("x.n").alias("n"), F.col("x.last").alias("last_at"))
