"""Embedding whitening by incremental eigendecomposition.

Components become whole numbers x = floor(scale * c) + shift.  Passes over the stored vectors:

1. n and the exact sums S per dimension.
2. Every task keeps a ``Spectrum`` of its rows: each distinct row of a batch is one centred
   rank-one update (a secular equation with deflation), weighted by how often it occurs.
   Spectra are merged by successive rank-one updates, ``FAN`` at a time in tasks, until
   few are left for the driver.
3. Rayleigh-Ritz: the covariance in the merged basis, summed over all rows from the
   exactly centred (n x - S) / n; its d x d eigenproblem rotates the basis to the final one.
4. The covariance of the whitened rows, as a check.
5. The result: one row per vector and component.

Contract for odd input: rows with a null or empty vector or one that holds null or
non-finite components are dropped, and so are vectors of another length than the
commonest.  A component whose eigenvalue is below ``ZERO`` of the trace has no scale: it is
whitened to 0, explains max(e, 0) / trace (0 if the trace is 0) and is left out of
``identity_error``.  ``deviation`` is null where it passes 64 bits.  Components larger
than 2**52 in magnitude are refused.  An empty table gives an empty result.  Repeated rows
count as often as they occur.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .secular import Spectrum
from .vectors import common_length, is_finite, matrix, outer_sum

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
FAN = 16              # spectra that one task or the driver merges
ZERO = 1e-14          # of the trace: an eigenvalue below is rounding


def whole_numbers(vectors: np.ndarray, scale: int, shift: int) -> np.ndarray:
    x = np.floor(vectors * scale)
    if len(x) and np.abs(x).max() >= 2.0 ** 52:
        raise ValueError("components are too large for exact whole numbers")
    return x.astype(np.int64) + shift


def spectra(vectors: DataFrame, d: int, scale: int) -> DataFrame:
    """(part, spectrum): one packed spectrum of floor(scale * vec) per task that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(d)
        for b in batches:
            if b.num_rows:
                rows, times = np.unique(np.floor(matrix(b.column(0), d) * scale), axis=0, return_counts=True)
                for row, t in zip(rows, times.tolist(), strict=True):
                    own.add(row, t)
        if own.n:
            yield pa.RecordBatch.from_arrays([pa.array([own.packed()], pa.list_(pa.float64()))], names=["spectrum"])

    made = stored(map_batches(vectors.select("vec"), run, "spectrum array<double>"), "spectra")
    return made.select(F.monotonically_increasing_id().alias("part"), "spectrum")


def merged(parts: DataFrame, d: int) -> Spectrum:
    """One spectrum of all: tasks merge ``FAN`` at a time, the driver the last few."""
    parts = stored(parts, "spectra")
    count = parts.count()

    def join(table: pa.Table) -> pa.Table:
        own = Spectrum.empty(d)
        part, flat = table.column(0).to_numpy(), matrix(table.column(1).combine_chunks(), 1 + 2 * d + d * d)
        for i in np.argsort(part):                  # the same order in every attempt
            own.merge(Spectrum.unpacked(flat[i], d))
        return pa.table({"part": pa.array([int(part.min())], pa.int64()),
                         "spectrum": pa.array([own.packed()], pa.list_(pa.float64()))})

    while count > FAN:
        groups = -(-count // FAN)                   # of FAN spectra on average: the hash spreads them
        parts = stored(parts.groupBy(F.pmod(F.xxhash64("part", F.lit(count)), F.lit(groups))).applyInArrow(
            join, "part bigint, spectrum array<double>"), "spectra")
        count = parts.count()
    own = Spectrum.empty(d)
    for r in parts.orderBy("part").collect():
        own.merge(Spectrum.unpacked(np.array(r["spectrum"]), d))
    return own


class Whitening:
    """n, sums S, orthonormal components (columns) and eigenvalues of the covariance, all by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], basis: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.basis, self.values, self.trace = n, sums, basis, values, trace

    def scales(self, k: int) -> np.ndarray:
        """1 / sqrt(e) of the first k components, 0 where e is only rounding."""
        e = self.values[:k]
        real = e > ZERO * self.trace
        return np.where(real, 1 / np.sqrt(np.where(real, e, 1)), 0.0)


def _centred(sums: list[int], n: int, scale: int, shift: int, d: int, at: int = 0):
    """A function from a batch to its exact n * x - S (int64, or Python numbers where that could overflow)."""

    def of(b: pa.RecordBatch) -> np.ndarray:
        x = whole_numbers(matrix(b.column(at), d), scale, shift)
        most = max(np.abs(x).max(initial=0), max(map(abs, sums)) // n + 1)
        kind = np.int64 if 2 * n * int(most) < 1 << 62 else object
        return x.astype(kind) * n - np.array(sums, dtype=kind)

    return of


def fit(vectors: DataFrame, d: int, scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """The whitening of the ``vec`` column (finite vectors of length d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                n += b.num_rows
                total += whole_numbers(matrix(b.column(0), d), scale, 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)),
                                          pa.array(np.r_[total, n])], names=["at", "value"])

    # the shift is added to the sums of decimals, so 64 bits hold each task's part
    added = map_batches(vectors.select("vec"), run, "at int, value bigint").groupBy("at").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    got = {r["at"]: int(r["value"]) for r in added.collect()}
    n = got[d]
    sums = [got[i] + shift * n for i in range(d)]
    own = merged(spectra(vectors, d, scale), d)
    basis, _ = np.linalg.qr(own.basis)
    centred = _centred(sums, n, scale, shift, d)

    def projected(b: pa.RecordBatch) -> np.ndarray:
        return ((centred(b) / n).astype(np.float64)) @ basis

    ritz = outer_sum(vectors.select("vec"), d, projected) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-values, kind="stable")
    basis, _ = np.linalg.qr(basis @ turn[:, order])
    return Whitening(n, sums, basis, values[order], float(np.trace(ritz)))


def identity_error(vectors: DataFrame, d: int, model: Whitening, k: int, scale: int, shift: int) -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity), over components with a scale."""
    centred, n, turn = _centred(model.sums, model.n, scale, shift, d), model.n, model.basis[:, :k] * model.scales(k)
    live = model.scales(k) > 0
    cov = outer_sum(vectors.select("vec"), k, lambda b: ((centred(b) / n).astype(np.float64)) @ turn) / n
    off = np.abs(cov - np.eye(k))[np.ix_(live, live)]
    return float(off.max()) if off.size else 0.0


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per kept vector and component."""
    kept = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")) \
        .filter(is_finite(F.col("vec")))
    id_type = kept.schema["id"].dataType.simpleString()
    schema = (f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    d = common_length(kept)
    if d is None:
        return df.sparkSession.createDataFrame([], schema)
    kept = stored(kept.filter(F.size("vec") == d), "whitening-rows")
    model = fit(kept, d, scale, shift)
    k = min(components, d)
    off = identity_error(kept, d, model, k, scale, shift)
    centred, n, turn = _centred(model.sums, model.n, scale, shift, d, at=1), model.n, model.basis[:, :k] * model.scales(k)
    explained = np.maximum(model.values[:k], 0) / model.trace if model.trace > 0 else np.zeros(k)

    def squares(away: np.ndarray) -> pa.Array:
        if away.dtype == object or 2 * away.shape[1] * float(np.abs(away).max()) ** 2 >= 2.0 ** 62:
            exact = [sum(int(v) ** 2 for v in row) for row in away]
            return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
        return pa.array((away * away).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            away = centred(b)
            white = ((away / n).astype(np.float64)) @ turn
            rows = pa.array(np.repeat(np.arange(b.num_rows), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                 pa.array(np.full(len(rows), n, dtype=np.int64)), squares(away).take(rows), pa.array(white.ravel()),
                 pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(len(rows), off))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(kept.select("id", "vec"), run, schema)
