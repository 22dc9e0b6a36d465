"""Physical layouts of a frame's cells, and their conversions.

WIDE   a double column for each label; up to WIDE_LIMIT labels.
MAP    one map<int, double> column of the non-zero cells.
LONG   rows (index, col, value), a row without cells having a null col; the form of aggregation. Rows are
       the different index keys, and equal (index, col) are summed by the next operation.

A frame refers to its cells: a label's reference is a column name (WIDE) or a map key (MAP, LONG). Selecting,
renaming and repeating columns changes references only, never the plan below.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.frame.labels import in_order

WIDE, MAP, LONG = "wide", "map", "long"
#: Labels up to which cells are columns. Sums of many columns cost more than long rows.
WIDE_LIMIT = 64
CELLS, COL, VALUE = "__cells", "__col", "__value"
_numbers = itertools.count()


def fresh(prefix: str) -> str:
    """A column name that no other frame has."""
    return f"__{prefix}{next(_numbers)}"


def empty_map() -> Column:
    return F.create_map().cast("map<int,double>")


def map_of(columns: Sequence[str]) -> Column:
    """The non-zero cells of wide columns, keyed by position."""
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(i), F.col(c))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v != 0) if pairs else empty_map()


def renumbered(cells: Column, refs: Sequence[int]) -> Column:
    """A map with the cells of refs, keyed by place in refs. A key may be referred to more than once."""
    if in_order(refs):
        return F.map_filter(cells, lambda k, v: k < F.lit(len(refs)))
    if len(set(refs)) == len(refs):
        place = F.create_map(*[x for i, r in enumerate(refs) for x in (F.lit(r), F.lit(i))])
        kept = F.map_filter(cells, lambda k, v: F.map_contains_key(place, k))
        return F.transform_keys(kept, lambda k, v: place[k])
    pairs = F.filter(F.array(*(F.struct(F.lit(i).alias("key"), cells[F.lit(r)].alias("value")) for i, r in enumerate(refs))), lambda x: x["value"].isNotNull())
    return F.map_from_entries(pairs)


def long_rows(df: DataFrame, keep: Sequence[str], layout: str, refs: Sequence, outer: bool) -> DataFrame:
    """(keep, COL, VALUE) with COL the place in refs. With outer, rows without cells have a null COL."""
    if layout == WIDE:
        cells = F.filter(F.array(*(F.struct(F.lit(i).alias(COL), F.col(c).alias(VALUE)) for i, c in enumerate(refs))), lambda x: x[VALUE] != 0)
        return df.select(*keep, (F.inline_outer if outer else F.inline)(cells))
    if layout == MAP:
        cells = renumbered(F.col(CELLS), refs)
        return df.select(*keep, (F.explode_outer if outer else F.explode)(cells).alias(COL, VALUE))
    rows = df
    if not in_order(refs):
        if len(set(refs)) != len(refs):
            raise ValueError("repeated columns of a long frame")
        place = F.create_map(*[x for i, r in enumerate(refs) for x in (F.lit(r), F.lit(i))])
        rows = rows.withColumn(COL, place[F.col(COL)])
    return rows.select(*keep, COL, VALUE) if outer else rows.filter(F.col(COL).isNotNull()).select(*keep, COL, VALUE)
