"""Small mergeable states of a table, folded over Arrow batches.

For statistics whose buffers are wide (hundreds of columns, d x d products, label counters),
an ``agg`` needs hundreds of expressions and a generated class for each chunk of them.  Here
every task folds its batches into one state with numpy, states of a slot are merged in tasks,
and at most ``SLOTS`` states reach the driver, however many tasks there were.  A state's size
must not depend on the rows.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])

SLOTS = 16


def fold(df: DataFrame, start: Callable, step: Callable, merge: Callable):
    """merge(... step(start(), batch) ...) over all Arrow batches of ``df``; ``start()`` for no rows.

    ``step`` and ``merge`` return the new state and may change their first argument.
    """

    def row(slot: int, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([pickle.dumps(state, protocol=5)])],
                                          names=["slot", "state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = start(), 0
        for b in batches:
            if b.num_rows:
                state, rows = step(state, b), rows + b.num_rows
        if rows:
            yield row(TaskContext.get().partitionId() % SLOTS, state)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for slot, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                state = pickle.loads(blob)
                held[slot] = merge(held[slot], state) if slot in held else state
        for slot, state in held.items():
            yield row(slot, state)

    parts = df.mapInArrow(partial, "slot int, state binary").repartition("slot")
    merged = sorted(parts.mapInArrow(join, "slot int, state binary").collect(), key=lambda r: r["slot"])
    return reduce(merge, [pickle.loads(r["state"]) for r in merged]) if merged else start()


def as_array(exprs: list[Column], kind: str = "double") -> Column:
    """The expressions as one array: a single flat buffer for Arrow."""
    return F.array(*[e.cast(kind) for e in exprs]) if exprs else F.array().cast(f"array<{kind}>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of doubles as a matrix; nulls are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


# ---------------------------------------------------------------------------------------------
BLOCK_VALUES = 1 << 17     # values folded at a time: their copies stay in a core's cache


def _blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of ``x`` in blocks of about BLOCK_VALUES values."""
    rows = max(256, BLOCK_VALUES // max(1, x.shape[1]))
    for i in range(0, len(x), rows):
        yield x[i:i + rows]


# moments of columns: rows of (count, mean, sum of squared differences from it, min, max)
def no_moments(width: int) -> np.ndarray:
    return np.tile(np.array([[0.0], [0.0], [0.0], [np.inf], [-np.inf]]), width)


def moments_of(x: np.ndarray) -> np.ndarray:
    out = no_moments(x.shape[1])
    for block in _blocks(x):
        out = merge_moments(out, _moments_of_block(block))
    return out


def _moments_of_block(x: np.ndarray) -> np.ndarray:
    gone = np.isnan(x)
    n = (len(x) - np.count_nonzero(gone, axis=0)).astype(np.float64)
    some = np.maximum(n, 1)
    with np.errstate(invalid="ignore", over="ignore"):
        mean = np.where(gone, 0.0, x).sum(axis=0) / some
        away = x - mean
        np.copyto(away, 0.0, where=gone)
        rest = away.sum(axis=0) / some               # what rounding left of the mean
        m2 = np.maximum(np.einsum("ij,ij->j", away, away) - n * rest * rest, 0.0)
        return np.array([n, mean + rest, m2, np.fmin.reduce(x, axis=0, initial=np.inf),
                         np.fmax.reduce(x, axis=0, initial=-np.inf)])


def merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    with np.errstate(invalid="ignore", over="ignore"):
        away = b[1] - a[1]
        mean = np.where(a[0] == 0, b[1], np.where(b[0] == 0, a[1], a[1] + away * (b[0] / some)))
        m2 = a[2] + b[2] + np.where((a[0] == 0) | (b[0] == 0), 0.0, away * away * (a[0] * b[0] / some))
    return np.array([n, mean, m2, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])])


# ---------------------------------------------------------------------------------------------
# facts of finished columns: counts, extremes, signatures and products of all pairs
def _mixed(bits: np.ndarray) -> np.ndarray:
    """A hash of every number, in its place."""
    for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        bits ^= bits >> np.uint64(shift)
        bits *= np.uint64(factor)
    bits ^= bits >> np.uint64(33)
    return bits


def _signature(bits: np.ndarray, gone: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Per column two sums of 16 bits of a hash (exact up to 1.4e11 rows): equal for equal columns, in any row order."""
    h = _mixed(bits ^ keys[:, None])
    np.copyto(h, np.uint64(0), where=gone)
    return np.array([(h & np.uint64(0xFFFF)).sum(axis=0), (h >> np.uint64(48)).sum(axis=0)], dtype=np.float64)


class Facts:
    """Of ``width`` double columns and ``labels`` hashed label columns (bigint): rows, counts, extremes, signatures;
    of the double columns also sums and products of pairs about ``centre``."""

    def __init__(self, width: int, labels: int):
        self.n = 0
        self.counts, self.label_counts = np.zeros(width), np.zeros(labels)
        self.low, self.high = np.full(width, np.inf), np.full(width, -np.inf)
        self.label_low, self.label_high = np.full(labels, np.iinfo(np.int64).max), np.full(labels, np.iinfo(np.int64).min)
        self.marks, self.label_marks = np.zeros((2, width)), np.zeros((2, labels))
        self.sums, self.products = np.zeros(width), np.zeros((width, width))

    def add(self, x: np.ndarray, hashes: np.ndarray, present: np.ndarray, keys: np.ndarray) -> Facts:
        """``keys``: a 64-bit hash of each row's ID, so that signatures tell in which rows the values stand."""
        self.n += len(x)
        at = 0
        for block in _blocks(x):
            gone = np.isnan(block)
            self.counts += len(block) - np.count_nonzero(gone, axis=0)
            with np.errstate(invalid="ignore"):
                self.low = np.fmin(self.low, np.fmin.reduce(block, axis=0))
                self.high = np.fmax(self.high, np.fmax.reduce(block, axis=0))
            clean = block + 0.0
            self.marks += _signature(clean.view(np.uint64), gone, keys[at:at + len(block)])
            np.copyto(clean, 0.0, where=gone)
            self.sums += clean.sum(axis=0)
            self.products += clean.T @ clean
            at += len(block)
        self.label_counts += present.sum(axis=0)
        big = np.iinfo(np.int64)
        self.label_low = np.minimum(self.label_low, np.where(present, hashes, big.max).min(axis=0, initial=big.max))
        self.label_high = np.maximum(self.label_high, np.where(present, hashes, big.min).max(axis=0, initial=big.min))
        self.label_marks += _signature(hashes.view(np.uint64), ~present, keys)
        return self

    def packed(self) -> dict:
        return dict(self.__dict__)


def merge_facts(a: dict, b: dict) -> dict:
    low, high = {"low", "label_low"}, {"high", "label_high"}
    return {k: np.minimum(a[k], b[k]) if k in low else np.maximum(a[k], b[k]) if k in high else a[k] + b[k] for k in a}


def column_facts_fold(df: DataFrame, numeric: list[Column], labels: list[Column], row_id: Column | None = None) -> dict:
    """One pass over ``df``: the packed ``Facts`` of the numeric columns and of the labels' 64-bit hashes."""
    width, count = len(numeric), len(labels)
    hashed = [F.when(c.isNotNull(), F.xxhash64(c)) for c in labels]

    def step(state: dict, b: pa.RecordBatch) -> dict:
        own = Facts(width, count)
        own.__dict__.update(state)
        flat = b.column(1).flatten()
        present = (~flat.is_null().to_numpy(zero_copy_only=False)).reshape(-1, count) if count else np.zeros((b.num_rows, 0), bool)
        hashes = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, count) if count else np.zeros((b.num_rows, 0), np.int64)
        x = matrix(b.column(0), width) if width else np.zeros((b.num_rows, 0))
        return own.add(x, hashes, present, b.column(2).to_numpy().view(np.uint64)).packed()

    key = F.lit(0).cast("bigint") if row_id is None else F.xxhash64(row_id)
    return fold(df.select(as_array(numeric).alias("x"), as_array(hashed, "bigint").alias("h"), key.alias("k")),
                lambda: Facts(width, count).packed(), step, merge_facts)


def correlations(facts: dict) -> np.ndarray:
    """Pearson matrix of the numeric columns (NaN where one is constant)."""
    n = facts["n"]
    mean = facts["sums"] / n
    cov = facts["products"] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    # below the rounding of the products a column is constant
    spread[np.diag(cov) <= 1e-13 * np.diag(facts["products"]) / n] = np.nan
    return cov / np.outer(spread, spread)


def sample_variances(facts: dict) -> np.ndarray:
    n = facts["n"]
    mean = facts["sums"] / n
    return np.maximum(np.diag(facts["products"]) / n - mean * mean, 0) * n / max(n - 1, 1)
