"""Huber regressions fitted by damped Newton steps on aggregated statistics.

Objective (n rows, residual r = x.w + c - y, scale s > 0):
    n s + sum over |r| <= eps s of r^2 / s + sum over the rest of (2 eps |r| - eps^2 s) + alpha |w|^2
It is jointly convex in (w, c, s).  One scan of the rows gives its value, gradient and
Hessian at one point for *every* open fit at once (trials of a search differ only in alpha
and eps), so a fit takes about ten scans, a search no more.  The start is ridge least
squares from one scan of the products.  A step goes at most 4/5 of the way to s = 0 and is
halved until the value falls enough.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keelson.functions.states import fold, matrix

ARMIJO = 1e-4          # share of the predicted decrease that a step must reach
NOISE = 1e-12          # of the value: differences below are rounding
SETTLED = 1e-13        # of the value: a predicted decrease below this ends a fit
SHORTER, SHRINK = 8, 0.25      # step lengths tried besides the first, each a quarter of the one before
LEAST_EPSILON = 1 + 1e-7       # at 1 the scale has no optimum above 0
LEAST_SCALE = 1e-8     # of the start's scale: below it the fit is one of least absolute residuals, and ends
STATE_BYTES = 64 << 20     # statistics of the fits that share a scan, per task


@dataclass
class Fit:
    """One regression: its parameters (w, c, s), the statistics there, and the pending trial step."""

    alpha: float
    epsilon: float
    point: np.ndarray
    value: float = np.inf
    step: np.ndarray | None = None
    slope: float = 0.0
    length: float = 1.0
    scans: int = 0
    done: bool = False
    floor: float = 0.0
    history: list = field(default_factory=list)

    def __post_init__(self):
        self.floor = LEAST_SCALE * float(self.point[-1])

    @property
    def candidates(self) -> np.ndarray:
        """The point to judge next, and below it the shorter steps (for a start that point alone, repeated)."""
        lengths = self.length * SHRINK ** np.arange(SHORTER + 1)
        return np.array([self.point if self.step is None else self.point + t * self.step for t in lengths])

    def take(self, value: float, gradient: np.ndarray, hessian: np.ndarray, shorter: np.ndarray, tol: float) -> None:
        """Judge the candidate by its statistics (of the rows alone) and set the next one."""
        points, self.scans = self.candidates, self.scans + 1
        values = np.r_[value, shorter] + self.alpha * (points[:, :-2] ** 2).sum(axis=1)
        at, w, value = points[0], points[0, :-2], float(values[0])
        if self.step is not None and not self._falls(value, self.length):
            lengths = self.length * SHRINK ** np.arange(SHORTER + 1)
            fine = [k for k in range(1, SHORTER + 1) if self._falls(values[k], lengths[k])]
            self.length = lengths[min(fine, key=lambda k: values[k])] if fine else lengths[-1] * SHRINK
            self.done = self.length * np.abs(self.step).max() <= 1e-3 * tol * (1 + np.abs(self.point).max())
            return
        self.point, self.value = at, value
        self.history.append(value)
        if at[-1] <= self.floor:
            self.done = True
            return
        gradient = gradient.copy()
        gradient[:-2] += 2 * self.alpha * w
        hessian = hessian + np.diag(np.r_[np.full(len(w), 2 * self.alpha), 0.0, 0.0])
        step = _solved(hessian, -gradient)
        self.slope = float(gradient @ step)
        if -self.slope <= SETTLED * abs(value) or np.abs(step).max() <= tol * (1 + np.abs(at).max()):
            self.done = True
            if self.slope < 0 and at[-1] + step[-1] > 0:
                self.point = at + step
            return
        self.step = step
        self.length = min(1.0, -0.8 * at[-1] / step[-1]) if step[-1] < 0 else 1.0

    def _falls(self, value: float, length: float) -> bool:
        return value <= self.value + ARMIJO * length * self.slope + NOISE * abs(self.value)


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a x = b for a positive semidefinite matrix, scaled to a unit diagonal; near-null directions are damped."""
    size = np.sqrt(np.maximum(np.diag(a), np.finfo(float).tiny))
    unit = a / np.outer(size, size)
    damp = 0.0
    while True:
        try:
            low = np.linalg.cholesky(unit + damp * np.eye(len(b)))
            return np.linalg.solve(low.T, np.linalg.solve(low, b / size)) / size
        except np.linalg.LinAlgError:
            damp = max(10 * damp, 1e-12)


def _rows(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = matrix(b.column(0), d), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
    if np.isnan(x).any() or np.isnan(y).any():
        raise ValueError("features and label must not be null for a fit")
    return np.column_stack([x, np.ones(len(x))]), y


def products(vectors: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means of (x, y), sums of all products of their differences from the means)."""

    def merge(a, b):
        if not a[0] or not b[0]:
            return a if a[0] else b
        n, away = a[0] + b[0], b[1] - a[1]
        return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n)

    def step(state, b):
        z, y = _rows(b, d)
        z = np.column_stack([z[:, :-1], y])
        mean = z.mean(axis=0)
        return merge(state, (len(z), mean, (z - mean).T @ (z - mean)))

    return fold(vectors, lambda: (0, np.zeros(d + 1), np.zeros((d + 1, d + 1))), step, merge)


def values_at(z: np.ndarray, y: np.ndarray, points: np.ndarray, eps: float) -> np.ndarray:
    """The value of the rows' part at every point."""
    r = np.abs(z @ points[:, :-1].T - y[:, None])
    s = points[:, -1]
    return len(y) * s + np.where(r <= eps * s, r * r / s, 2 * eps * r - eps * eps * s).sum(axis=0)


def statistics_of(z: np.ndarray, y: np.ndarray, points: np.ndarray, epsilons: np.ndarray) -> np.ndarray:
    """Per fit (its candidates in ``points``) as one row of numbers: value, gradient and Hessian of the rows' part at
    the first candidate, values at the others; z holds (x, 1)."""
    size = z.shape[1] + 1
    out = np.empty((len(points), 1 + size + size * size + SHORTER))
    for t, (own, eps) in enumerate(zip(points, epsilons, strict=True)):
        s, r = own[0, -1], z @ own[0, :-1] - y
        inside = np.abs(r) <= eps * s
        outer = int(len(r) - np.count_nonzero(inside))
        zi, ri = z[inside], r[inside]
        squares = float(ri @ ri)
        pull = np.where(inside, 2 * r / s, 2 * eps * np.sign(r))
        hessian = np.empty((size, size))
        hessian[:-1, :-1] = 2 / s * (zi.T @ zi)
        hessian[-1, :-1] = hessian[:-1, -1] = -2 / (s * s) * (zi.T @ ri)
        hessian[-1, -1] = 2 * squares / s ** 3
        value = len(r) * s + squares / s + 2 * eps * float(np.abs(r[~inside]).sum()) - outer * eps * eps * s
        out[t] = np.r_[value, z.T @ pull, len(r) - squares / (s * s) - outer * eps * eps, hessian.ravel(),
                       values_at(z, y, own[1:], eps)]
    return out


def scan(vectors: DataFrame, d: int, points: np.ndarray, epsilons: np.ndarray, shift: float) -> np.ndarray:
    """``statistics_of`` all rows, for all fits, in one pass; ``shift`` is taken off the label."""

    def step(total, b):
        z, y = _rows(b, d)
        return total + statistics_of(z, y - shift, points, epsilons)

    return fold(vectors, lambda: np.zeros((len(points), 1 + (d + 2) + (d + 2) ** 2 + SHORTER)), step, lambda a, b: a + b)


def newton_fits(vectors: DataFrame, d: int, trials: list[tuple[float, float]], max_scans: int = 100,
                tol: float = 1e-9, together: int | None = None) -> list[Fit]:
    """Fits of (features array<double> of length d, label) rows for every (alpha, epsilon).

    ``together``: fits that share a scan (default: as many as have statistics of ``STATE_BYTES`` in a task).
    """
    n, means, cross = products(vectors, d)
    if not n:
        raise ValueError("no rows to fit")
    shift = float(means[-1])                               # a label far from 0 would lose its small residuals
    together = together or max(1, STATE_BYTES // (8 * (d + 3) ** 2))
    fits = [Fit(alpha, max(eps, LEAST_EPSILON), _start(n, means[:-1], cross, alpha)) for alpha, eps in trials]
    for group in (fits[i:i + together] for i in range(0, len(fits), together)):
        while todo := [f for f in group if not f.done and f.scans < max_scans]:
            got = scan(vectors, d, np.array([f.candidates for f in todo]), np.array([f.epsilon for f in todo]), shift)
            for f, row in zip(todo, got, strict=True):
                f.take(row[0], row[1:d + 3], row[d + 3:-SHORTER].reshape(d + 2, d + 2), row[-SHORTER:], tol)
    for f in fits:
        f.point = f.point + shift * np.eye(d + 2)[d]
    return fits


def _start(n: int, means: np.ndarray, cross: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge least squares of the label less its mean, and the root mean square of the residuals (kept off zero)."""
    w = _solved(cross[:-1, :-1] + alpha * np.eye(len(means)), cross[:-1, -1])
    around = np.r_[w, -1.0]
    floor = 1e-12 * max(cross[-1, -1] / n, np.finfo(float).tiny)
    return np.r_[w, -float(means @ w), np.sqrt(max(float(around @ cross @ around) / n, floor))]
