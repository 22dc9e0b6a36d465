"""Joins, sums and stacks of frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.frame.core import SparseFrame
from cellweave.frame.layout import CELLS, COL, LONG, MAP, VALUE, WIDE, WIDE_LIMIT, empty_map, fresh, map_of, renumbered


def _same_rows(a: SparseFrame, b: SparseFrame) -> bool:
    return a._df is b._df and a._index == b._index and a._layout == b._layout != LONG


def _renamed(f: SparseFrame) -> tuple[DataFrame, list[str], SparseFrame]:
    """The frame under column names that no other frame has, so that it may join itself."""
    f = f._rows()
    keys = [fresh("k") for _ in f._keys]
    refs = [fresh("c") for _ in f._refs] if f._layout == WIDE else [fresh("m")]
    cells = [F.col(r) for r in f._refs] if f._layout == WIDE else [renumbered(F.col(CELLS), f._refs)]
    df = f._df.select(*(F.col(p).alias(k) for p, k in zip(f._keys, keys)), *(c.alias(r) for c, r in zip(cells, refs)))
    return df, keys, f._with(df=df, refs=refs if f._layout == WIDE else range(len(f._labels)))


def _equal(left: DataFrame, x: str, right: DataFrame, y: str) -> Column:
    """Keys are equal where grouping puts them in one group: NaN equals NaN by itself, null by this."""
    nullable = left.schema[x].nullable and right.schema[y].nullable
    return F.col(x).eqNullSafe(F.col(y)) if nullable else F.col(x) == F.col(y)


def joined(a: SparseFrame, b: SparseFrame, how: str, level: int | None) -> SparseFrame:
    if _same_rows(a, b) and level is None:
        if a._layout == WIDE or len(set(a._refs) | set(b._refs)) == len(a._refs) + len(b._refs):
            return a._with(labels=a._labels + b._labels, refs=(*a._refs, *b._refs))
        cells = renumbered(F.col(CELLS), [*a._refs, *b._refs])
        return a._with(df=a._df.withColumn(CELLS, cells), labels=a._labels + b._labels, refs=range(len(a._labels) + len(b._labels)))
    left, l_keys, a2 = _renamed(a)
    right, r_keys, b2 = _renamed(b)
    if level is None and len(l_keys) != len(r_keys):
        raise ValueError("indexes of different depth; give a level")
    on = [(l_keys[level], r_keys[0])] if level is not None else list(zip(l_keys, r_keys))
    both = left.join(right, [_equal(left, x, right, y) for x, y in on], {"outer": "full", "left": "left", "right": "right", "inner": "inner"}[how])
    names = [n for n, _ in a._index]
    keys = [(n, fresh("i")) for n in names]
    paired = {x: y for x, y in on}
    index = [(F.coalesce(F.col(k), F.col(paired[k])) if k in paired else F.col(k)).alias(p) for k, (_, p) in zip(l_keys, keys)]
    labels = a._labels + b._labels
    unique = a._unique and b._unique and level is None
    k = len(a._labels)
    if a2._layout == b2._layout == WIDE and len(labels) <= WIDE_LIMIT:
        refs = [*a2._refs, *b2._refs]
        df = both.select(*index, *(F.coalesce(F.col(r), F.lit(0.0)).alias(r) for r in refs))
        return SparseFrame._made(df, keys, [p for _, p in keys], labels, refs, WIDE, unique)
    sides = []
    for f, df in ((a2, left), (b2, right)):
        own = [c for c in df.columns if c not in (*l_keys, *r_keys)]
        if f._layout == WIDE:
            sides.append(map_of(own) if own else empty_map())  # nulls of a missing row aren't cells
        else:
            sides.append(F.coalesce(F.col(own[0]), empty_map()))
    cells = F.map_concat(sides[0], F.transform_keys(sides[1], lambda key, v: key + F.lit(k)))
    return SparseFrame._made(both.select(*index, cells.alias(CELLS)), keys, [p for _, p in keys], labels, range(len(labels)), MAP, unique)


def added(a: SparseFrame, b: SparseFrame, how: str) -> SparseFrame:
    if len(a._index) != len(b._index):
        raise ValueError("indexes of different depth")
    n = len(a._labels)
    if how == "outer" and a._unique and b._unique:
        # Each key is one row of each side: the sum is a union and one aggregation.
        return stacked([a, b]).groupby_sum()
    wide = n <= WIDE_LIMIT
    left, l_keys, a2 = _renamed(a._as_wide() if wide else a._as_map())
    right, r_keys, b2 = _renamed(b._as_wide() if wide else b._as_map())
    both = left.join(right, [_equal(left, x, right, y) for x, y in zip(l_keys, r_keys)], {"outer": "full"}.get(how, how))
    keys = [(name, fresh("i")) for name, _ in a._index]
    index = [F.coalesce(F.col(x), F.col(y)).alias(p) for x, y, (_, p) in zip(l_keys, r_keys, keys)]
    unique = a._unique and b._unique
    if wide:
        refs = [fresh("c") for _ in range(n)]
        sums = [(F.coalesce(F.col(x), F.lit(0.0)) + F.coalesce(F.col(y), F.lit(0.0))).alias(r) for x, y, r in zip(a2._refs, b2._refs, refs)]
        return SparseFrame._made(both.select(*index, *sums), keys, [p for _, p in keys], a._labels, refs, WIDE, unique)
    x, y = (F.coalesce(F.col(next(c for c in df.columns if c not in (*l_keys, *r_keys))), empty_map()) for df in (left, right))
    cells = F.map_zip_with(x, y, lambda key, v, w: F.coalesce(v, F.lit(0.0)) + F.coalesce(w, F.lit(0.0)))
    return SparseFrame._made(both.select(*index, F.map_filter(cells, lambda key, v: v != 0).alias(CELLS)), keys, [p for _, p in keys], a._labels, range(n), MAP, unique)


def stacked(frames: Sequence[SparseFrame]) -> SparseFrame:
    """A union of all frames. Their order is that of the frames, then each frame's own where its order
    columns have the types of the first frame's."""
    n, names = len(frames[0]._labels), [name for name, _ in frames[0]._index]
    if any(len(f._index) != len(names) for f in frames):
        raise ValueError("indexes of different depth")
    long = all(f._layout == LONG for f in frames)
    frames = [f if long else f._rows() for f in frames]
    wide = n <= WIDE_LIMIT and not long
    kinds = [[f._df.schema[c].dataType for c in f._order] for f in frames]
    ordered = not long and all(k == kinds[0] for k in kinds)
    keys, at = [fresh("i") for _ in names], fresh("o")
    order = [fresh("o") for _ in kinds[0]] if ordered else []
    refs = [fresh("c") for _ in range(n)]
    parts = []
    for i, f in enumerate(frames):
        f = f._as_wide() if wide else f if long else f._as_map()
        own = [F.col(p).alias(k) for p, k in zip(f._keys, keys)]
        if long:
            own += [F.col(COL), F.col(VALUE)]
        else:
            own += [F.lit(i).alias(at), *(F.col(p).alias(o) for p, o in zip(f._order, order))]
            own += [F.col(r).alias(c) for r, c in zip(f._refs, refs)] if wide else [F.col(CELLS)]
        parts.append(f._df.select(*own))
    df = reduce(DataFrame.unionByName, parts)
    return SparseFrame._made(df, list(zip(names, keys)), keys if long else [at, *(order or keys)], frames[0]._labels, refs if wide else range(n), WIDE if wide else LONG if long else MAP, unique=long)
