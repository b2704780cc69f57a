"""Symmetric eigendecompositions kept up to date by rank-one updates.

``Spectrum`` holds n rows' mean and the eigendecomposition Q diag(values) Q^T of their
scatter about it (the sum of centred outer products).  A row, or a whole other spectrum,
is taken in by updates Q diag(values) Q^T + rho v v^T: with z = Q^T v, entries of z that
cannot matter are deflated, eigenvalues that agree are rotated into one, the rest are the
roots of the secular equation 1 + rho sum z_j^2 / (values_j - x) = 0, one between each two
neighbouring eigenvalues; z is then recomputed from the roots, which keeps the new
eigenvectors orthogonal to rounding.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
ITERATIONS = 80        # a step that leaves the bracket halves it instead; a few steps are usual


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots x_i of 1 + sum weights_j / (poles_j - x), poles ascending, weights > 0.

    Returned as (origin, offset): x_i = poles[origin_i] + offset_i with the nearer pole as
    origin, so that differences from poles keep their relative accuracy.
    """
    k = len(poles)
    at = np.arange(k)
    gap = np.r_[poles[1:] - poles[:-1], weights.sum()]
    # the sign in the middle of the gap tells which pole is nearer
    middle = 1 + (weights / (poles - poles[:, None] - gap[:, None] / 2)).sum(axis=1)
    right = (middle < 0) & (at < k - 1)
    origin = at + right
    delta = poles[None, :] - poles[origin][:, None]           # poles seen from the origin
    low = np.where(right, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    high = np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
    x = (low + high) / 2
    own = weights[origin]
    todo = at
    for _ in range(ITERATIONS):
        y = x[todo]
        apart = delta[todo] - y[:, None]
        terms = weights / apart
        value = 1 + terms.sum(axis=1)
        below = value < 0
        low[todo], high[todo] = np.where(below, y, low[todo]), np.where(below, high[todo], y)
        # the origin's own term stays as it is, all others stand as the line a + b y
        o = own[todo]
        b = np.maximum((terms / apart).sum(axis=1) - o / (y * y), 0)
        a = value + o / y - b * y
        root = np.sqrt(a * a + 4 * b * o)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = np.where(y > 0, np.where(a >= 0, 2 * o / (a + root), (root - a) / (2 * b)),
                           np.where(a >= 0, -(a + root) / (2 * b), -2 * o / (root - a)))
        new = np.where((new > low[todo]) & (new < high[todo]), new, (low[todo] + high[todo]) / 2)
        settled = (np.abs(value) <= 16 * EPS * (1 + np.abs(terms).sum(axis=1))) | (np.abs(new - y) <= 4 * EPS * np.abs(y))
        x[todo] = np.where(settled, y, new)
        todo = todo[~settled]
        if not len(todo):
            break
    return origin, x


def rank_one_update(values: np.ndarray, basis: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of basis diag(values) basis^T + rho v v^T, rho > 0."""
    z = v @ basis
    size = float(np.sqrt(rho * (z @ z)))
    if size == 0:
        return values, basis
    z = z * np.sqrt(rho)
    scale = max(abs(values[0]), abs(values[-1]), size * size)
    close = values[1:] - values[:-1] <= 8 * EPS * scale
    if close.any():
        # runs of equal eigenvalues: a reflection leaves one of them with all of the run's weight
        basis = basis.copy()
        edges = np.flatnonzero(np.diff(np.r_[False, close, False].astype(np.int8)))
        for lo, hi in zip(edges[::2], edges[1::2] + 1, strict=True):
            u = z[lo:hi].copy()
            norm = np.sqrt(u @ u)
            if norm == 0:
                continue
            u[-1] += norm if u[-1] >= 0 else -norm
            z[lo:hi] = 0
            z[hi - 1] = -norm if u[-1] >= 0 else norm
            block = basis[:, lo:hi]
            basis[:, lo:hi] = block - np.outer(block @ u, 2 * u / (u @ u))
    live = np.flatnonzero(np.abs(z) * size > 8 * EPS * scale)
    if not len(live):
        return values, basis
    poles, z = values[live], z[live]
    origin, offset = secular_roots(poles, z * z)
    # differences (root_i - pole_j), accurate also where they are small
    apart = (poles[origin][:, None] - poles[None, :]) + offset[:, None]
    # z_j^2 from the roots: the product of (root_i - pole_j) over that of the other poles' differences, paired so
    # that every factor lies between 0 and 1
    beyond = poles[:, None] > poles[None, :]                   # pole_i lies above pole_j
    same = np.eye(len(live), dtype=bool)
    divisor = np.where(beyond | same, np.r_[poles[1:], 0][:, None], poles[:, None]) - poles[None, :]
    divisor[-1] = 1
    exact = np.sqrt(np.abs((apart / divisor).prod(axis=0)))
    vectors = np.where(z < 0, -exact, exact) / -apart          # row i: eigenvector of root i
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    values, basis = values.copy(), basis.copy() if not close.any() else basis
    values[live] = poles[origin] + offset
    basis[:, live] = basis[:, live] @ vectors.T
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """n rows, their mean, and the eigendecomposition of their scatter about it."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, basis: np.ndarray):
        self.n, self.mean, self.values, self.basis = n, mean, values, basis

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, row: np.ndarray, times: int = 1) -> None:
        """Take in ``times`` equal rows."""
        away = row - self.mean
        if self.n:
            self.values, self.basis = rank_one_update(self.values, self.basis, away, self.n * times / (self.n + times))
        self.n += times
        self.mean = self.mean + away * (times / self.n)

    def merge(self, other: Spectrum) -> None:
        """Take in another spectrum: one update per eigenvector, one for the difference of the means."""
        if not self.n or not other.n:
            if other.n:
                self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        for k in np.flatnonzero(other.values > 0):
            self.values, self.basis = rank_one_update(self.values, self.basis, other.basis[:, k], float(other.values[k]))
        away, n = other.mean - self.mean, self.n + other.n
        self.values, self.basis = rank_one_update(self.values, self.basis, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.n = n

    def packed(self) -> list[float]:
        return [float(self.n), *self.mean, *self.values, *self.basis.ravel()]

    @classmethod
    def unpacked(cls, flat: np.ndarray, d: int) -> Spectrum:
        return cls(int(flat[0]), flat[1:d + 1], flat[d + 1:2 * d + 1], flat[2 * d + 1:].reshape(d, d))
