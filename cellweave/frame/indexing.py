"""Rows by label and by position."""

from __future__ import annotations

import datetime
import re
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.frame.core import SparseFrame
from cellweave.frame.layout import fresh

_DATE = re.compile(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[ T](\d{1,2})(?::(\d{2})(?::(\d{2})(\.\d+)?)?)?)?)?)?$")


def period(text: str) -> tuple[pd.Timestamp, pd.Timestamp]:
    """The start of the period that a partial date names, and the start of the next one."""
    m = _DATE.match(text.strip())
    if not m:
        raise KeyError(text)
    parts = [p for p in m.groups()[:6] if p is not None]
    start = pd.Timestamp(*[int(p) for p in [*parts, *["1"] * max(0, 3 - len(parts))]])
    if m.group(7):
        start = start + pd.Timedelta(seconds=float(m.group(7)))
        return start, start + pd.Timedelta(microseconds=1)
    step = {1: {"years": 1}, 2: {"months": 1}, 3: {"days": 1}, 4: {"hours": 1}, 5: {"minutes": 1}, 6: {"seconds": 1}}[len(parts)]
    return start, start + pd.DateOffset(**step)


class Loc:
    """Rows by label of the first index level: one label, a list of labels, a slice with both ends, partial
    dates on times, a condition (a Column over the index names), or an array of one boolean a row. A tuple
    holds labels of the first levels of several; columns are selected by [] and not here."""

    def __init__(self, frame: SparseFrame):
        self.frame = frame

    def __getitem__(self, key: Any) -> SparseFrame:
        f = self.frame
        col, kind = F.col(f._keys[0]), f._df.schema[f._keys[0]].dataType
        if isinstance(key, Column):
            return f._filtered(key)
        if isinstance(key, tuple):
            if len(key) > len(f._keys):
                raise NotImplementedError("labels are of rows; [] gives columns")
            keep = F.lit(True)
            for label, p in zip(key, f._keys):
                keep = keep & (F.col(p) == self._lit(label, f._df.schema[p].dataType))
            return f._filtered(keep, must_exist=key)
        if isinstance(key, slice):
            if key.step is not None:
                raise ValueError("a label slice has no step")
            keep = F.lit(True)
            if key.start is not None:
                keep = keep & (col >= self._bound(key.start, kind, 0)[0])
            if key.stop is not None:
                stop, open_ = self._bound(key.stop, kind, 1)
                keep = keep & (col < stop if open_ else col <= stop)
            return f._filtered(keep)
        if isinstance(key, (list, np.ndarray, pd.Series)):
            values = np.asarray(key)
            if values.dtype == bool:
                numbered, flag = f._by_position(values)
                return numbered._with(df=numbered._df.filter(flag))
            return self._among(list(key))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(key, str):
            start, end = period(key)
            return f._filtered((col >= F.lit(start.to_pydatetime()).cast(kind)) & (col < F.lit(end.to_pydatetime()).cast(kind)), must_exist=key)
        return f._filtered(col == self._lit(key, kind), must_exist=key)

    @staticmethod
    def _lit(value: Any, kind: T.DataType) -> Column:
        value = value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if isinstance(value, np.generic) else value
        if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime) and not isinstance(kind, T.DateType):
            value = datetime.datetime(value.year, value.month, value.day)
        if isinstance(value, datetime.datetime):
            # A literal's text is free of the session's time zone.
            return F.lit(value.isoformat(sep=" ")).cast(kind)
        return F.lit(value)

    def _bound(self, value: Any, kind: T.DataType, end: int) -> tuple[Column, bool]:
        if isinstance(value, str) and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return self._lit(period(value)[end], kind), bool(end)
        return self._lit(value, kind), False

    def _among(self, labels: list) -> SparseFrame:
        """Rows of the labels, in the labels' order and again for a repeated label."""
        f = self.frame._rows()
        rank, name = fresh("o"), fresh("k")
        kind = f._df.schema[f._keys[0]].dataType
        plain = [x.item() if isinstance(x, np.generic) else x for x in labels]
        wanted = f._df.sparkSession.createDataFrame(list(enumerate(plain)), T.StructType([T.StructField(rank, T.IntegerType()), T.StructField(name, kind)]))
        rows = f._df.filter(F.col(f._keys[0]).isin(plain)) if len(plain) <= 1000 else f._df
        return f._with(df=rows.join(wanted, F.col(f._keys[0]) == F.col(name)).drop(name), order=[rank, *f._order])


class ILoc:
    """Rows by position: one, a list (in its order, with repetitions), or a half-open slice with a step."""

    def __init__(self, frame: SparseFrame):
        self.frame = frame

    def __getitem__(self, key: Any) -> SparseFrame:
        f = self.frame
        if isinstance(key, tuple):
            raise NotImplementedError("positions are of rows; take(axis=1) gives columns")
        if isinstance(key, slice):
            if key.start in (None, 0) and key.step in (None, 1) and key.stop is not None and key.stop >= 0:
                return f.head_frame(key.stop)
            return self._slice(key)
        places = [key] if isinstance(key, (int, np.integer)) else list(key)
        pos, rank, place = fresh("p"), fresh("o"), fresh("k")
        numbered = f.with_positions(pos, below=max(places, default=0) + 1 if all(p >= 0 for p in places) else None)
        if any(p < 0 for p in places):
            n = f.shape[0]
            places = [p + n if p < 0 else p for p in places]
        wanted = f._df.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(places)], f"{rank} int, {place} bigint")
        rows = numbered._df.join(F.broadcast(wanted) if len(places) <= 100_000 else wanted, F.col(pos) == F.col(place)).drop(place)
        return numbered._with(df=rows, order=[rank])

    def _slice(self, key: slice) -> SparseFrame:
        pos = fresh("p")
        ahead = key.stop is not None and key.stop >= 0 and (key.start or 0) >= 0 and (key.step or 1) > 0
        f = self.frame.with_positions(pos, below=key.stop if ahead else None)
        step = 1 if key.step is None else key.step
        if step == 0:
            raise ValueError("slice step cannot be zero")
        if step < 0 or any(x is not None and x < 0 for x in (key.start, key.stop)):
            places = range(*key.indices(self.frame.shape[0]))
            low, high, step, first = (min(places), max(places) + 1, abs(step), places[0]) if len(places) else (0, 0, 1, 0)
            out = f._filtered((F.col(pos) >= low) & (F.col(pos) < high) & (F.pmod(F.col(pos) - first, F.lit(step)) == 0))
            if key.step is not None and key.step < 0:
                back = fresh("o")
                out = out._with(df=out._df.withColumn(back, -F.col(pos)), order=[back])
            return out
        start = key.start or 0
        keep = (F.col(pos) >= start) & (F.pmod(F.col(pos) - start, F.lit(step)) == 0)
        return f._filtered(keep & (F.col(pos) < key.stop) if key.stop is not None else keep)
