"""Packing of items into containers under several limits at once.

An item takes tokens, one segment and loss-bearing tokens; a container limits all three. Containers are
filled one after the other: of the items that fit, the next is the one with the largest dot product of its
weighted demand and the room that is left. Items of equal demand are one kind with a count, so a step looks
at kinds and not at items.

Items are packed in chunks of bounded size. Of the containers that a chunk leaves below every limit, the least
filled are emptied again and their items packed together with those of other chunks, in rounds of logarithmic
number, so that the half-empty last containers of each chunk don't add up. A chunk passes on a bounded number of
items, so no round has a larger chunk than the first, whatever the items are; the other containers stay as they
are, since items of their chunk that would have fitted were tried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.plans import materialize

#: Items of a chunk on average (they are dealt by hash), chunks that come together in a round, and the share of
#: each limit that may stay unused in a container that is full.
CHUNK_ITEMS, FAN_IN, SLACK = 16_384, 16, 0.002
#: Partitions that chunks are dealt to; beyond as many, a task packs several, one after the other.
MOST_PARTITIONS = 20_000


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item and the tokens in front of it there, by the dot-product heuristic. Items must
    fit an empty container."""
    container, offset = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    if not len(tokens):
        return container, offset
    kinds, of = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    left = np.bincount(of, minlength=len(kinds))
    next_ = np.cumsum(left) - left
    cap = np.array(limits, float)
    demand = np.stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]], axis=1).astype(float)
    weight = (demand * left[:, None]).sum(axis=0) / cap / len(tokens)  # mean share of a container
    scaled = demand * weight / cap**2
    remaining, current = len(tokens), 0
    live = np.arange(len(kinds))
    while remaining:
        live = live[left[live] > 0]
        room, used, fits = cap.copy(), 0, live
        while len(fits):
            fits = fits[(demand[fits] <= room).all(axis=1) & (left[fits] > 0)]
            if not len(fits):
                break
            k = fits[np.argmax(scaled[fits] @ room)]
            i = order[next_[k]]
            container[i], offset[i] = current, used
            next_[k] += 1
            left[k] -= 1
            room -= demand[k]
            used += int(demand[k, 0])
            remaining -= 1
        current += 1
    return container, offset


def left_open(where: np.ndarray, use: np.ndarray, limits: tuple[int, int, int], most: int) -> np.ndarray:
    """Whether each container is to be emptied: the least filled of those that reach no limit, until these hold
    ``most`` items together. ``use`` holds each item's demand in each of the limits' dimensions."""
    used = np.stack([np.bincount(where, weights=u) for u in use.T], axis=1)
    fill = (used / np.array(limits, float)).max(axis=1)
    order = np.argsort(fill, kind="stable")
    ahead = np.cumsum(used[order, 1]) - used[order, 1]  # each item is one segment
    open_ = np.zeros(len(fill), bool)
    open_[order] = (fill[order] < 1 - SLACK) & (ahead < most)
    return open_


def _packed(limits: tuple[int, int, int], round_: int, most: int):
    """The items of a partition's chunks to containers, with ``open``: whether the container is emptied again."""

    def pack_chunk(t: pa.Table, chunk: int) -> pa.RecordBatch:
        t = t.sort_by([("item", "ascending"), ("piece", "ascending")])
        tokens, loss = (t.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "n_loss"))
        where, offset = pack(tokens, loss, limits)
        use = np.stack([tokens, np.ones(len(tokens), np.int64), loss], axis=1)
        ids = (np.int64(round_) << 58) + (np.int64(chunk) << 28) + where
        out = pa.table([*(t.column(c) for c in _PIECE), t.column("chunk"), pa.array(ids), pa.array(offset), pa.array(left_open(where, use, limits, most)[where])], names=[*_PIECE, "chunk", "container_id", "container_offset", "open"])
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        for chunk in pc.unique(t.column("chunk")).to_pylist():
            yield pack_chunk(t.filter(pc.equal(t.column("chunk"), chunk)), chunk)

    return run


_PIECE = ("item", "piece", "token_start", "n_tokens", "n_loss")


def packed_containers(items: DataFrame, item: str = "doc_id", tokens: str = "n_tokens", loss: str | None = None, capacity: int = 2048, max_segments: int = 1024, max_loss: int | None = None, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """(item, piece, token_start, n_tokens, container_id, container_offset): where each item's tokens lie.

    A container holds at most ``capacity`` tokens, ``max_segments`` pieces and ``max_loss`` loss-bearing
    tokens (by default as many as tokens). ``loss`` names the column of loss-bearing tokens; without it all
    tokens bear loss. Only an item over the capacity or with more than ``max_loss`` loss tokens is split: into
    pieces that reach a limit alone, and one rest that is packed like an item. With a loss column, each piece
    bears its share of the item's loss tokens, counted from the front; pieces of ``max_loss`` tokens are cut
    while more loss tokens than that are left, and pieces of ``capacity`` tokens from there on.

    An item without tokens, or with a null number, takes no room: it has one row with n_tokens 0 and null
    container. Items must be unique; an empty input gives no row. Results don't depend on partitioning.

    Runs a job a round while it is built. A task packs one chunk at a time: about ``chunk_items`` items in the
    first round, and no more than that and FAN_IN containers' items in the later ones.
    """
    if item in ("piece", "token_start", "n_tokens", "container_id", "container_offset"):
        raise ValueError(f"{item!r} is a column of the result")
    if max_loss is None:
        max_loss = capacity
    limits = (capacity, max_segments, max_loss)
    borne = F.least(F.col(loss), F.col(tokens)) if loss else F.col(tokens)
    sized = items.select(F.col(item).alias("item"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n"), F.coalesce(borne, F.lit(0)).cast("bigint").alias("l"))
    size, most = F.lit(capacity).cast("bigint"), F.lit(max_loss).cast("bigint")
    # Pieces at the front that loss tokens alone fill; the others are bound by the capacity.
    front = F.greatest(F.ceil(F.col("l") / most) - 1, F.lit(0)).cast("bigint") if max_loss < capacity else F.lit(0).cast("bigint")
    cut = sized.withColumn("front", front)
    at_front, rest = F.col("piece") < F.col("front"), F.col("front") * most
    last = F.col("front") + F.greatest(F.ceil((F.col("n") - rest) / size) - 1, F.lit(0))
    spans = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int")))).withColumn("token_start", F.when(at_front, F.col("piece") * most).otherwise(rest + (F.col("piece") - F.col("front")) * size))
    n_tokens = F.when(at_front, most).otherwise(F.least(size, F.col("n") - F.col("token_start")))
    pieces = spans.select(
        "item",
        "piece",
        "token_start",
        n_tokens.alias("n_tokens"),
        F.greatest(F.lit(0), F.least(n_tokens, F.col("l") - F.col("token_start"))).cast("bigint").alias("n_loss"),
    )
    known = materialize(pieces, "pieces")
    out = ["item", "piece", "token_start", "n_tokens", "container_id", "container_offset"]
    to_pack = known.filter("n_tokens > 0")
    chunks = max(1, -(-to_pack.count() // chunk_items))
    now = to_pack.withColumn("chunk", F.pmod(F.xxhash64("item", "piece"), F.lit(chunks)).cast("bigint"))
    schema = T.StructType([*(known.schema[c] for c in _PIECE), T.StructField("chunk", T.LongType()), T.StructField("container_id", T.LongType()), T.StructField("container_offset", T.LongType()), T.StructField("open", T.BooleanType())])
    done, round_ = known.filter("n_tokens <= 0").select("item", "piece", "token_start", "n_tokens", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("bigint").alias("container_offset")), 0
    while True:
        most = chunk_items // min(chunks, FAN_IN) if chunks > 1 else 0
        dealt = now.repartitionById(min(chunks, MOST_PARTITIONS), F.pmod(F.col("chunk"), F.lit(min(chunks, MOST_PARTITIONS))).cast("int"))
        placed = dealt.mapInArrow(_packed(limits, round_, most), schema)
        if chunks == 1:
            return done.unionByName(placed.select(*out)).withColumnRenamed("item", item)
        placed = materialize(placed, "placed")
        done = done.unionByName(placed.filter("NOT open").select(*out))
        round_, chunks = round_ + 1, -(-chunks // FAN_IN)
        now = placed.filter("open").select(*_PIECE, F.expr(f"chunk div {FAN_IN}").alias("chunk"))
