"""The labels of a frame's columns, which the driver holds."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa

_BITS = 63


class Labels(Sequence):
    """An unchangeable sequence that equals a tuple of the same labels. Whole numbers take 8 bytes each; if any
    label is of another kind, or doesn't fit, it is a tuple."""

    __slots__ = ("_items",)

    def __init__(self, labels: Iterable = ()):
        if isinstance(labels, Labels):
            self._items: array | tuple = labels._items
            return
        packed, left = array("q"), iter(labels)
        for x in left:
            if type(x) is not int or not -(1 << _BITS) <= x < 1 << _BITS:
                self._items = (*packed, x, *left)
                return
            packed.append(x)
        self._items = packed

    @property
    def whole(self) -> bool:
        """Whether all labels are integers."""
        return isinstance(self._items, array) or all(isinstance(x, (int, np.integer)) and not isinstance(x, bool) for x in self._items)

    def arrow(self) -> pa.Array:
        if isinstance(self._items, array) and self._items:
            return pa.array(np.frombuffer(self._items, np.int64))
        return pa.array(list(self._items)) if self._items else pa.array([], pa.string())

    def __len__(self) -> int:
        return len(self._items)

    def __getitem__(self, i: Any) -> Any:
        return tuple(self._items[i]) if isinstance(i, slice) else self._items[i]

    def __iter__(self):
        return iter(self._items)

    def __contains__(self, label: Any) -> bool:
        return label in self._items

    def index(self, label: Any, *bounds: int) -> int:
        return self._items.index(label, *bounds)

    def __add__(self, other: Iterable) -> Labels:
        return Labels(chain(self, other))

    def __eq__(self, other: Any) -> bool:
        items = other._items if isinstance(other, Labels) else other
        if type(items) is type(self._items):
            return self._items == items
        return isinstance(items, (tuple, array)) and len(items) == len(self) and all(x is y or x == y for x, y in zip(self, items))

    def __hash__(self) -> int:
        return hash(tuple(self))

    def __repr__(self) -> str:
        return repr(tuple(self))


def in_order(refs: Sequence) -> bool:
    """Whether the references are 0, 1, 2, ..."""
    return refs == range(len(refs)) if isinstance(refs, range) else all(r == i for i, r in enumerate(refs))
