"""Frequent ordered patterns across many sequences, gaps allowed.

Sequences are laid out as bitmaps: for each item one bit for each position of each sequence. A pattern's
positions after its earliest match are a mask; its extension by an item is the mask and the item's bitmap,
and the sequences with a bit left are its support. Patterns grow depth-first within a block of sequences.

A pattern that holds in a share of all sequences holds in at least that share of some block. So the union
of the blocks' own frequent patterns misses none, and a second pass counts these candidates in every block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions import is_set_time
from cellweave.operators.stretches import CHUNK, _chunks, _one
from cellweave.plans import materialize, small_broadcast

#: 64-bit words of one block's bitmaps, and candidates counted in one pass.
BLOCK_WORDS, CANDIDATES = 1 << 21, 200_000
#: Pieces of a long sequence that one task puts together in a round.
FAN_IN = 64
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def kernel(items: np.ndarray, longest: int) -> np.ndarray:
    """The part of a stretch of a sequence that earliest matches of patterns of up to ``longest`` steps can
    use: positions that are the next of their item after a position used one step earlier, from the
    stretch's start. Every such pattern holds in a sequence of kernels if and only if it holds in the
    sequence of the stretches themselves."""
    if len(items) <= longest:
        return items
    kinds, code = np.unique(items, return_inverse=True)
    order = np.argsort(code, kind="stable")
    places = np.split(order, np.cumsum(np.bincount(code))[:-1])
    used = np.zeros(len(items), bool)
    ends = np.array([-1])
    for _ in range(longest):
        after = [p[i[i < len(p)]] for p in places if len(i := np.unique(np.searchsorted(p, ends, side="right")))]
        ends = np.unique(np.concatenate(after))
        ends = ends[~used[ends]] if len(ends) else ends  # positions used before were extended before
        used[ends] = True
        if not len(ends):
            break
    return items[used]


class Bitmaps:
    """Bitmaps of a block of sequences, grouped by the number of words that a sequence needs."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, items: np.ndarray):
        """flat: the sequences one after the other, as indices of items."""
        self.n_items, self.parts = len(items), []
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        size = _words(lengths)
        for w in np.unique(size[lengths > 0]) if len(lengths) else []:
            rows = np.flatnonzero((size == w) & (lengths > 0))
            n = lengths[rows]
            row = np.repeat(np.arange(len(rows)), n)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            item = flat[np.repeat(start[rows], n) + at]
            cell = (item.astype(np.int64) * len(rows) + row) * w + at // 64
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            bit = np.left_shift(np.uint64(1), (at[order] % 64).astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            bits = np.zeros(self.n_items * len(rows) * w, np.uint64)
            bits[cell[first]] = np.bitwise_or.reduceat(bit, first)
            self.parts.append(bits.reshape(self.n_items, len(rows), w))

    def root(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each part the sequences and the positions that a first step may take."""
        return [(np.arange(p.shape[1]), np.full(p.shape[1:], _ONES)) for p in self.parts]

    def step(self, state: list, item: int) -> tuple[int, list]:
        """Support of a pattern extended by an item, and what stands after each earliest match."""
        support, hits = 0, []
        for part, (rows, mask) in zip(self.parts, state):
            hit = part[item][rows] & mask
            live = np.flatnonzero(hit[:, 0]) if hit.shape[1] == 1 else np.flatnonzero(hit.any(axis=1))
            support += len(live)
            hits.append((rows, hit, live))
        return support, hits

    @staticmethod
    def after(hits: list) -> list:
        """Masks of the positions behind the first set bit, by shift: below the lowest bit w ^ (w - 1) is set."""
        state = []
        for rows, hit, live in hits:
            w = hit[live]
            behind = ~(w ^ (w - np.uint64(1)))
            if w.shape[1] > 1:
                some = w != 0
                earlier = np.zeros_like(some)
                earlier[:, 1:] = np.logical_or.accumulate(some, axis=1)[:, :-1]
                behind = np.where(earlier, _ONES, np.where(some, behind, np.uint64(0)))
            state.append((rows[live], behind))
        return state

    def frequent(self, least: int, shortest: int, longest: int) -> Iterator[tuple[int, ...]]:
        """Patterns of different items with at least this support, depth-first. An item that doesn't extend
        a pattern doesn't extend the pattern's extensions."""

        def grow(prefix: tuple[int, ...], state: list, choices: Sequence[int]) -> Iterator[tuple[int, ...]]:
            good = []
            for x in choices:
                if x not in prefix:
                    support, hits = self.step(state, x)
                    if support >= least:
                        good.append((x, hits))
            keep = [x for x, _ in good]
            for i, (x, hits) in enumerate(good):
                pattern = (*prefix, x)
                if len(pattern) >= shortest:
                    yield pattern
                if len(pattern) < longest and len(keep) > 1:
                    yield from grow(pattern, self.after(hits), keep)
                good[i] = (x, None)

        yield from grow((), self.root(), range(self.n_items))

    def supports(self, trie: dict, out: dict, prefix: tuple[int, ...] = (), state: list | None = None) -> None:
        """Support of each pattern that ends in the trie."""
        state = self.root() if state is None else state
        for x, below in trie.items():
            if x is None:
                continue
            support, hits = self.step(state, x)
            if support:
                pattern = (*prefix, x)
                if None in below:
                    out[pattern] = out.get(pattern, 0) + support
                self.supports(below, out, pattern, self.after(hits))


def _sequences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition (key, t, id, c) as sequences. Those that lie whole in a chunk have a null key; a
    chunk's first and last are pieces, with the key and the place of their first event."""
    last = None
    for t in _chunks(batches, CHUNK):
        carried = last is not None
        if carried:
            t = pa.concat_tables([last, t]).combine_chunks()
        key, when, ids, c = (_one(t.column(x)) for x in ("key", "t", "id", "c"))
        ts, ids_ = when.cast(pa.int64()).to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        same = np.zeros(len(ts), bool)
        same[1:] = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        keep = np.ones(len(ts), bool)
        keep[1:] = ~(same[1:] & (ts[1:] == ts[:-1]) & (ids_[1:] == ids_[:-1]))
        keep[0] = not carried
        last = t.slice(len(t) - 1)
        at = np.flatnonzero(keep)
        if not len(at):
            continue
        new = np.zeros(len(at), bool)
        new[0] = True
        new[1:] = ~same[at][1:] if len(at) == len(ts) - int(carried) else ~pc.equal(key.take(pa.array(at[1:])), key.take(pa.array(at[:-1]))).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        whole = np.ones(len(first), bool)
        whole[[0, -1]] = False
        heads = pa.array(at[first])
        name = pc.if_else(pa.array(whole), pa.scalar(None, pa.string()), key.take(heads).cast(pa.string()))
        offsets = pa.array(np.append(first, len(at)).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, c.take(pa.array(at)).cast(pa.int32()))
        yield pa.RecordBatch.from_arrays([name, when.take(heads), ids.take(heads), lists], names=["key", "t", "id", "items"])


def _lists(b: pa.RecordBatch | pa.Table, column: str = "items") -> tuple[np.ndarray, np.ndarray]:
    col = b.column(column)
    col = _one(col) if isinstance(col, pa.ChunkedArray) else col
    lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), lengths


def _kernels(items: Sequence[int], longest: int):
    """Sequences or pieces restricted to the frequent items, long ones to their kernels."""
    items = np.array(sorted(items), np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, lengths = _lists(b)
            good = np.isin(flat, items)
            owner = np.repeat(np.arange(len(lengths)), lengths)[good]
            flat, lengths = flat[good], np.bincount(owner, minlength=len(lengths))
            if (lengths > 64).any():
                parts = np.split(flat, np.cumsum(lengths)[:-1])
                parts = [kernel(p, longest) if len(p) > 64 else p for p in parts]
                flat, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in b.schema.names if x != "items"), lists], names=[*(x for x in b.schema.names if x != "items"), "items"])

    return run


def _words(lengths: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(np.maximum(1, -(-lengths // 64)))).astype(np.int64)


def _block(batches: Iterable[pa.RecordBatch], items: np.ndarray) -> tuple[Bitmaps, int]:
    """The block that a partition is, with the number of its sequences, empty ones included."""
    flats, lens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for b in batches:
        flat, lengths = _lists(b)
        flats.append(flat)
        lens.append(lengths)
    flat, lengths = np.concatenate(flats), np.concatenate(lens)
    return Bitmaps(np.searchsorted(items, flat), lengths, items), len(lengths)


def _mined(items: Sequence[int], share: tuple[int, int], shortest: int, longest: int):
    items = np.array(sorted(items), np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, n = _block(batches, items)
        least = max(1, -(-n * share[0] // share[1]))
        found = [items[list(p)].tolist() for p in maps.frequent(least, shortest, longest)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["steps"])

    return run


def _counted(items: Sequence[int], candidates):
    items = np.array(sorted(items), np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: dict = {}
        for p in candidates.value:
            node = trie
            for x in np.searchsorted(items, p).tolist():
                node = node.setdefault(x, {})
            node[None] = True
        out: dict = {}
        _block(batches, items)[0].supports(trie, out)
        steps = [items[list(p)].tolist() for p in out]
        yield pa.RecordBatch.from_arrays([pa.array(steps, pa.list_(pa.int32())), pa.array(list(out.values()), pa.int64())], names=["steps", "n"])

    return run


def frequent_subsequences(
    events: DataFrame,
    types: DataFrame,
    share: tuple[int, int] = (1, 25),
    shortest: int = 3,
    longest: int = 5,
    entity: str = "uuids",
    time: str = "timestamps",
    event: str = "r_idx",
    kind: str = "c_idx",
) -> DataFrame:
    """(pattern, n_steps, n_trails, n_all): the patterns of ``shortest`` to ``longest`` pairwise different
    types that occur in this order, with any other events in between, among the known events of at least
    share[0] / share[1] of the entities that have a known event. ``pattern`` is the types joined by one
    blank; ``n_trails`` the number of entities that hold it, each once.

    Known events have a non-null entity and event id, a listed type, and a time neither null nor unset
    (1970-01-01 00:00:00). An entity's events are ordered by time, then event id; repeated deliveries count
    once. Empty events give no pattern. Other columns are ignored.

    One shuffle orders the events by range, so that a heavy entity is spread over many tasks; its pieces
    come together only as kernels. Held on the driver: the frequent items, at most the mean number of
    different types of an entity divided by the share, and the candidate patterns, at most CANDIDATES at a
    time; more are counted in further passes.
    """
    spark = events.sparkSession
    of = events.schema[time].dataType
    known = small_broadcast(types.select(F.col(kind).alias("c")).filter("c IS NOT NULL").distinct())
    rows = (
        events.filter(F.col(entity).isNotNull() & F.col(event).isNotNull() & is_set_time(time, of.simpleString()))
        .select(F.col(entity).cast("string").alias("key"), F.col(time).alias("t"), F.col(event).cast("bigint").alias("id"), F.col(kind).alias("c"))
        .join(known, "c", "left_semi")
    )
    order = ["key", "t", "id"]
    lists = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("t", of), T.StructField("id", T.LongType()), T.StructField("items", lists)])
    ordered = rows.select(*order, "c").repartitionByRange(*order).sortWithinPartitions(*order)
    laid = materialize(ordered.mapInArrow(_sequences, schema), "sequences")
    whole, pieces = laid.filter("key IS NULL"), laid.filter("key IS NOT NULL")

    held = whole.select(F.explode(F.array_distinct("items")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    held_in_pieces = pieces.select("key", F.explode("items").alias("c")).distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    n_all = whole.count() + pieces.select("key").distinct().count()
    out = "pattern string, n_steps int, n_trails bigint, n_all bigint"
    if not n_all:
        return spark.createDataFrame([], out)
    supports = held.unionByName(held_in_pieces).groupBy("c").agg(F.sum("n").alias("n"))
    items = [r[0] for r in supports.filter(F.col("n") * share[1] >= n_all * share[0]).select("c").collect()]
    if not items:
        return spark.createDataFrame([], out)

    reduce_ = _kernels(items, longest)
    reduced = materialize(whole.select("items").mapInArrow(reduce_, T.StructType([schema["items"]])).unionByName(_joined(pieces, reduce_, schema)), "reduced")
    # Even blocks: a small one would have nearly all of its patterns among the candidates.
    words = reduced.agg(F.sum(F.pow(2, F.ceil(F.log2(F.greatest(F.ceil(F.size("items") / 64), F.lit(1))))))).first()[0]
    sequences = reduced.repartition(max(1, -(-len(items) * int(words) // BLOCK_WORDS)))
    found = materialize(sequences.mapInArrow(_mined(items, share, shortest, longest), T.StructType([T.StructField("steps", lists)])).distinct(), "candidates")
    counted_as = T.StructType([T.StructField("steps", lists), T.StructField("n", T.LongType())])
    n_found, counts = found.count(), None
    slices = max(1, -(-n_found // CANDIDATES))
    for k in range(slices):
        own = found if slices == 1 else found.filter(F.pmod(F.xxhash64("steps"), F.lit(slices)) == k)
        part = sequences.mapInArrow(_counted(items, spark.sparkContext.broadcast([r[0] for r in own.collect()])), counted_as)
        counts = part if counts is None else counts.unionAll(part)
    total = counts.groupBy("steps").agg(F.sum("n").alias("n")).filter(F.col("n") * share[1] >= n_all * share[0])
    return total.select(
        F.array_join(F.transform("steps", lambda x: x.cast("string")), " ").alias("pattern"), F.size("steps").alias("n_steps"), F.col("n").alias("n_trails"), F.lit(n_all).cast("bigint").alias("n_all")
    )


def _joined(pieces: DataFrame, reduce_, schema: T.StructType) -> DataFrame:
    """Sequences of the pieces: each piece becomes its kernel, and FAN_IN neighbours of an entity at a time
    become one piece, until every entity has one."""
    from pyspark.sql import Window

    now = materialize(pieces.mapInArrow(reduce_, schema), "pieces")
    while True:
        numbered = now.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("t", "id")) - 1)
        joined = numbered.groupBy("key", F.expr(f"at div {FAN_IN}").alias("g")).agg(F.array_sort(F.collect_list(F.struct("t", "id", "items"))).alias("p"), F.max("at").alias("at"))
        merged = joined.select("key", F.col("p")[0]["t"].alias("t"), F.col("p")[0]["id"].alias("id"), F.flatten(F.col("p.items")).alias("items"))
        now = materialize(merged.mapInArrow(reduce_, schema), "pieces")
        if now.groupBy("key").count().filter("count > 1").isEmpty():
            return now.select("items")
