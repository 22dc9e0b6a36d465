"""Ordered stretches of each entity's events, found without putting one entity into one task.

All events are range-partitioned on (entity, time, event id), so an entity with a third of all rows is
spread over as many partitions as its share needs, and repeated deliveries of an event lie side by side.
Each partition cuts its own rows into stretches. Only the stretches that hold a partition's first or last
row can go on in a neighbour: at most two rows a partition. They are linked to their predecessors and
joined by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.plans import materialize

#: Rows that a task cuts at a time; a stretch longer than this is carried over.
CHUNK = 1 << 17

#: (time, label, same entity as the row before) of a chunk -> first row of each row's stretch.
Cutter = Callable[[np.ndarray, np.ndarray | None, np.ndarray], np.ndarray]


def doubled_roots(linked: np.ndarray) -> np.ndarray:
    """Root of each row, where linked[i] says that row i follows row i - 1: every pointer jumps to its
    target's target until none moves, which takes log2(longest chain) rounds."""
    at = np.arange(len(linked))
    pointer = at - linked.astype(at.dtype)
    if len(pointer):
        pointer[0] = 0
    while True:
        jumped = pointer[pointer]
        if np.array_equal(jumped, pointer):
            return pointer
        pointer = jumped


def table_chunks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def single_array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


_chunks, _one = table_chunks, single_array


def _cut(cutter: Cutter, least: int, chunk: int):
    """The function that turns a sorted partition into its stretches of at least ``least`` events, and the
    stretches at its edges whatever their length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None  # last event so far: joins one chunk to the next
        open_: dict | None = None  # the stretch that holds it
        out_schema = None

        def emit(rows: dict, key: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, *(pa.array(v) if not isinstance(v, pa.Array) else v for v in rows.values())], schema=out_schema)

        for t in table_chunks(batches, chunk):
            has_label = "label" in t.schema.names
            kind = t.schema.field("t").type
            out_schema = pa.schema([("key", pa.string()), ("first_t", kind), ("first_id", pa.int64()), ("last_t", kind), ("last_id", pa.int64()), ("n", pa.int64()), ("label", pa.int32()), ("edge", pa.bool_())])
            carried = last is not None
            if carried:
                t = pa.concat_tables([last, t]).combine_chunks()
            key, when, ids = (single_array(t.column(c)) for c in ("key", "t", "id"))
            if pa.types.is_large_string(key.type):
                key = key.cast(pa.string())
            ts, ids_ = when.cast(pa.int64()).to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
            same = np.zeros(len(ts), bool)
            same[1:] = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            repeated = same.copy()
            repeated[1:] &= (ts[1:] == ts[:-1]) & (ids_[1:] == ids_[:-1])
            label = single_array(t.column("label")).to_numpy(zero_copy_only=False) if has_label else None
            if repeated.any():  # the first of equal rows stays, and its comparison with the row before it
                keep = np.flatnonzero(~repeated)
                key, ts, ids_, same = key.take(pa.array(keep)), ts[keep], ids_[keep], same[keep]
                label = label[keep] if label is not None else None
                t = t.take(pa.array(keep))
            root = cutter(ts, label, same)
            first = np.flatnonzero(root == np.arange(len(root)))
            end = np.append(first[1:], len(root)) - 1
            n = end - first + 1
            lab = label[first] if label is not None else np.zeros(len(first), np.int32)
            f_t, f_id, edge = ts[first], ids_[first], np.zeros(len(first), bool)
            if carried:
                n[0] += open_["n"] - 1
                f_t[0], f_id[0], edge[0] = open_["first_t"], open_["first_id"], open_["edge"]
            else:
                edge[0] = True
            z = len(first) - 1  # stays open
            open_ = {"first_t": f_t[z], "first_id": f_id[z], "last_t": ts[-1], "last_id": ids_[-1], "n": n[z], "label": lab[z], "edge": edge[z]}
            last = t.slice(len(t) - 1)
            done = np.flatnonzero((n[:z] >= least) | edge[:z])
            if len(done):
                yield emit({"first_t": pa.array(f_t[done]).cast(kind), "first_id": f_id[done], "last_t": pa.array(ts[end[done]]).cast(kind), "last_id": ids_[end[done]], "n": n[done].astype(np.int64), "label": lab[done].astype(np.int32), "edge": edge[done]}, key.take(pa.array(first[done])))
        if open_ is not None:
            o = open_
            yield emit({"first_t": pa.array([o["first_t"]]).cast(kind), "first_id": [o["first_id"]], "last_t": pa.array([o["last_t"]]).cast(kind), "last_id": [o["last_id"]], "n": pa.array([o["n"]], pa.int64()), "label": pa.array([o["label"]], pa.int32()), "edge": [True]}, single_array(last.column("key")).cast(pa.string()))

    return run


def stretches(events: DataFrame, cutter: Cutter, follows: Column, least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Stretches of events(key string, t, id bigint[, label int]): one row (key, first_t, first_id, last_t,
    last_id, n, label) for each of at least ``least`` events.

    ``cutter`` cuts a chunk; ``follows`` says the same for a partition's edges, as an expression over
    prev_t and prev_label (of the stretch before) and first_t and label. No column may be null. Rows equal in
    (key, t, id) are one event. An empty input gives an empty result.
    """
    order = ["key", "t", "id"]
    columns = [c for c in (*order, "label") if c in events.columns]
    kind = events.schema["t"].dataType
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("first_t", kind), T.StructField("first_id", T.LongType()), T.StructField("last_t", kind), T.StructField("last_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("edge", T.BooleanType())])
    ordered = events.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = materialize(ordered.mapInArrow(_cut(cutter, least, chunk), schema), "stretches")
    inner = cut.filter(~F.col("edge")).drop("edge")
    return inner.unionByName(_stitched(cut.filter("edge").drop("edge"), follows).filter(F.col("n") >= least))


def _stitched(edges: DataFrame, follows: Column) -> DataFrame:
    """Stretches at partition edges, joined where one goes on in the next. Each has a number within its
    entity and a pointer to its predecessor; a self-join moves every pointer to its target's pointer until
    none moves. There are at most two rows for each partition of the input."""
    by = Window.partitionBy("key").orderBy("first_t", "first_id")
    numbered = edges.select("*", F.row_number().over(by).alias("at"), F.lag("last_t").over(by).alias("prev_t"), F.lag("label").over(by).alias("prev_label"))
    nodes = materialize(numbered.withColumn("pointer", F.when(F.col("prev_t").isNotNull() & follows, F.col("at") - 1).otherwise(F.col("at"))).drop("prev_t", "prev_label"), "edges")
    links = nodes.filter("pointer < at").select("key", "at", "pointer")
    while not links.isEmpty():
        # Targets that are roots have no row in links: such pointers stay.
        target = links.select("key", F.col("at").alias("pointer"), F.col("pointer").alias("next"))
        jumped = links.join(target, ["key", "pointer"], "left")
        moved = materialize(jumped.select("key", "at", F.coalesce("next", "pointer").alias("pointer"), F.col("next").isNotNull().alias("moved")), "pointers")
        links = moved.select("key", "at", "pointer")
        if moved.filter("moved").isEmpty():
            break
    roots = links.withColumnRenamed("pointer", "root")
    whole = nodes.join(roots, ["key", "at"], "left").groupBy("key", F.coalesce("root", "at").alias("root")).agg(
        F.min(F.struct("first_t", "first_id")).alias("first"), F.max(F.struct("last_t", "last_id")).alias("last"), F.sum("n").alias("n"), F.min("label").alias("label")
    )
    return whole.select("key", "first.first_t", "first.first_id", "last.last_t", "last.last_id", "n", "label")
