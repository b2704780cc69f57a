"""Exact quantiles (interpolated, like ``percentile`` / DuckDB ``quantile_cont``)
without holding a column's values in one task.

Spark's exact ``percentile`` / ``median`` keep a map of every distinct value of
a group in the task that finishes the group: at scale that is one task per
column holding the whole column.  Here one scan makes a mergeable sketch of every
column (levels of at most ``CAPACITY`` items; a full level is sorted and every second
item goes up with twice the weight).  Each such step moves any rank by at most its
weight, so the sum of these weights bounds the error of every rank for certain: the
wanted value lies between two items of the sketch.  The next scan counts what is below
that window and keeps what is inside; if that fits without a step, the answer is exact,
else the sketch of the window narrows it further.  Two scans suffice up to some
CAPACITY**2 / 30 rows, each further one multiplies that by CAPACITY / 30.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from keelson.functions.exprs import qcol
from keelson.functions.states import as_array, fold, matrix

CAPACITY = 1 << 14
STATE_BYTES = 64 << 20     # of all columns' sketches in a task


class Sketch:
    """Items with weights 1, 2, 4, ... of the values inside a window; ``error`` bounds the error of any rank."""

    def __init__(self, capacity: int):
        self.capacity, self.below, self.n, self.error, self.steps = capacity, 0, 0, 0, 0
        self.low, self.high = math.inf, -math.inf
        self.levels: list[np.ndarray] = [np.empty(0)]

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._shrink()

    def merge(self, other: Sketch) -> Sketch:
        self.below, self.n, self.error = self.below + other.below, self.n + other.n, self.error + other.error
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
        for i, items in enumerate(other.levels):
            self.levels[i] = np.concatenate([self.levels[i], items])
        self._shrink()
        return self

    def _shrink(self) -> None:
        i = 0
        while i < len(self.levels):
            items = self.levels[i]
            if len(items) > self.capacity:
                items = np.sort(items)
                odd = len(items) % 2
                self.levels[i], items = items[len(items) - odd:], items[:len(items) - odd]
                if i + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                self.steps += 1
                self.levels[i + 1] = np.concatenate([self.levels[i + 1], items[self.steps % 2::2]])
                self.error += 1 << i
            i += 1

    def window(self, first: int, last: int) -> tuple[float, float]:
        """Values between which the items of the 0-based ranks first..last certainly lie."""
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << i, dtype=np.int64) for i, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        items, upto = items[order], np.cumsum(weights[order])
        upto = upto[np.searchsorted(items, items, side="right") - 1]       # equal items count together
        left = np.flatnonzero(upto + self.error <= first)
        right = np.flatnonzero(upto - self.error >= last + 1)
        return float(items[left[-1]]) if len(left) else self.low, float(items[right[0]]) if len(right) else self.high

    def packed(self) -> dict:
        return dict(self.__dict__)

    @classmethod
    def unpacked(cls, state: dict) -> Sketch:
        own = cls.__new__(cls)
        own.__dict__.update(state)
        return own


@dataclass
class Ranked:
    """An order statistic, how many values are below it, and how many equal it."""

    value: float
    below: int
    equal: int


def _sketches(df: DataFrame, values: list[Column], windows: list[tuple], capacity: int) -> list[Sketch]:
    """One scan: a sketch of each column inside its window, with the count of values below it."""
    width = len(values)

    def start() -> list[dict]:
        return [Sketch(capacity).packed() for _ in range(width)]

    def step(state, b):
        x = matrix(b.column(0), width)
        for i, (lo, hi) in enumerate(windows):
            v, s = x[:, i], Sketch.unpacked(state[i])
            v = v[~np.isnan(v)]
            s.below += int(np.count_nonzero(v < lo))
            s.add(v[(v >= lo) & (v <= hi)])
            state[i] = s.packed()
        return state

    def merge(a, b):
        return [Sketch.unpacked(x).merge(Sketch.unpacked(y)).packed() for x, y in zip(a, b, strict=True)]

    return [Sketch.unpacked(s) for s in fold(df.select(as_array(values).alias("x")), start, step, merge)]


def order_statistics(df: DataFrame, wanted: dict[str, tuple[Column, Callable[[int], list[int]]]],
                     capacity: int = CAPACITY) -> dict[str, list[Ranked]]:
    """name -> the order statistics at the 0-based, neighbouring ranks that the function gives for the number of non-null
    values of a double column (no ranks: an empty list)."""
    capacity = max(2, min(capacity, STATE_BYTES // (8 * 20 * max(1, len(wanted)))))
    open_ = {name: (v, ranks_of, None, (-math.inf, math.inf)) for name, (v, ranks_of) in wanted.items()}
    out: dict[str, list[Ranked]] = {}
    while open_:
        names = list(open_)
        found = _sketches(df, [open_[c][0] for c in names], [open_[c][3] for c in names], capacity)
        stuck = False
        for name, s in zip(names, found, strict=True):
            v, ranks_of, ranks, window = open_.pop(name)
            ranks = ranks_of(s.n) if ranks is None else ranks
            if not ranks:
                out[name] = []
            elif s.error == 0 or s.low == s.high:
                items = np.sort(np.concatenate(s.levels)) if s.error == 0 else None
                out[name] = [_ranked(s, items, r - s.below) for r in ranks]
            else:
                inner = s.window(ranks[0] - s.below, ranks[-1] - s.below)
                stuck |= inner == (s.low, s.high)
                open_[name] = (v, ranks_of, ranks, inner)
        capacity = 2 * capacity if stuck else capacity
    return out


def _ranked(s: Sketch, items: np.ndarray | None, rank: int) -> Ranked:
    if items is None:
        return Ranked(s.low, s.below, s.n)
    value = items[rank]
    left, right = np.searchsorted(items, value, side="left"), np.searchsorted(items, value, side="right")
    return Ranked(float(value), s.below + int(left), int(right - left))


def select_ranks(df: DataFrame, wanted: dict[str, tuple[Column, int]], bins: int = CAPACITY) -> dict[str, float]:
    """name -> the value at a 0-based rank among the non-null values of a double column."""
    got = order_statistics(df, {name: (v, lambda n, rank=rank: [rank]) for name, (v, rank) in wanted.items()}, bins)
    return {name: found[0].value for name, found in got.items()}


def exact_quantile(df: DataFrame, cols: list[str], q: float = 0.5, bins: int = CAPACITY,
                   profile: dict | None = None) -> dict[str, float | None]:
    """Exact q-quantile of each column, nulls ignored (None for an empty column).  ``bins``: items a level of a
    sketch holds; ``profile`` may name columns known to be empty (count 0)."""
    def ranks_of(n: int) -> list[int]:
        place = q * (n - 1)
        return [] if n == 0 else sorted({math.floor(place), math.ceil(place)})

    some = [c for c in cols if profile is None or profile.get(c, {}).get("count", 1)]
    counts: dict[str, int] = {}

    def counted(c: str) -> Callable[[int], list[int]]:
        def of(n: int) -> list[int]:
            counts[c] = n
            return ranks_of(n)
        return of

    got = order_statistics(df, {c: (qcol(c).cast("double"), counted(c)) for c in some}, bins)
    out: dict = dict.fromkeys(cols)
    for c, found in got.items():
        if found:
            place = q * (counts[c] - 1)
            low, high, part = found[0].value, found[-1].value, place - math.floor(place)
            if high == low or part == 0:
                out[c] = low
            else:
                out[c] = low * (1 - part) + high * part if math.isinf(high - low) else low + part * (high - low)
    return out
