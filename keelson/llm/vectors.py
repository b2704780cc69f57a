"""Vectors as rows: which ones count, and sums of outer products over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches


def is_finite(vec: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    inside = F.forall(vec, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vec) > 0) & inside, F.lit(False))


def common_length(vectors: DataFrame, vec_col: str = "vec") -> int | None:
    """The length that most vectors have (of equally frequent ones the greatest); None without rows."""
    top = vectors.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else None


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list array of doubles, each of length ``d``."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def outer_sum(df: DataFrame, d: int, rows_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all rows of (row^T row), d x d: each task adds up its own, Spark adds up the tasks' cells.

    ``rows_of`` makes the (n, d) matrix of a batch.  Only d * d cells reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                m = rows_of(b)
                total += m.T @ m
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())],
                                             names=["cell", "value"])

    cells = map_batches(df, run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(d * d)
    for r in cells.collect():
        out[r["cell"]] = r["value"]
    return out.reshape(d, d)
