"""A cover tree over the distinct points of one task, cut into contiguous runs with cumulative sums.

Level l holds centres such that (with r_l = r_0 / BASE**l) every point lies
within r_l of one, centres are more than r_l apart, every centre of a level is
also one of the next, and each centre of level l + 1 hangs below one of level l
within r_l.  Points are stored so that those below a node are one run [lo, hi);
sums over a node are differences of cumulative sums.  A node keeps its own radius:
the distance of its centre to the farthest point below it.

``assign`` deals points to their nearest entry: when the two nearest entries of a
node's centre differ by more than twice the node's radius, the triangle
inequality gives the whole run to the nearer one; other nodes descend, and what
is undecided below the last level is compared exactly.
"""

from __future__ import annotations

import numpy as np

BASE = 1.4
LEAF = 32              # levels are added while there are fewer than one centre per LEAF points
EXACT = 1 << 53        # sums of products below this are exact in doubles


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """All squared distances, exact whole numbers (as doubles while these are exact, else as int64)."""
    most = max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0))
    kind = np.float64 if 4 * points.shape[1] * int(most) ** 2 < EXACT else np.int64
    p, c = points.astype(kind), centres.astype(kind)
    return (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]


class CoverTree:
    """Points (distinct rows, int64), how often each occurs, and per level (centre, lo, radius)."""

    def __init__(self, points: np.ndarray, counts: np.ndarray, levels: list[tuple]):
        self.points, self.counts, self.levels = points, counts, levels
        self.total = np.zeros((len(points) + 1, points.shape[1] + 1), dtype=np.int64)
        np.cumsum(np.column_stack([counts, points * counts[:, None]]), axis=0, out=self.total[1:])

    def packed(self) -> tuple:
        return self.points, self.counts, self.levels

    @classmethod
    def build(cls, rows: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree of the rows, and for each row the place of its point."""
        points, place, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        place = place.reshape(-1)
        real = points.astype(np.float64)
        owners = [np.zeros(len(points), dtype=np.int64)]         # per level the centre of each point
        gap = np.sqrt(((real - real[0]) ** 2).sum(1))            # distance to the centre
        r = gap.max()
        while r >= 1 and len(np.unique(owners[-1])) * LEAF < len(points):
            r /= BASE
            owner, gap = _refined(real, owners[-1].copy(), gap, r)
            owners.append(owner)
        for level in range(len(owners) - 2, -1, -1):             # a point hangs where its centre hangs
            owners[level] = owners[level][owners[level + 1]]
        # points in the order of their chains of centres: every node is one run
        order = np.lexsort(owners[::-1])
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        levels = []
        for owner in owners:
            chain = owner[order]
            lo = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
            gaps = np.sqrt(((real[order] - real[chain]) ** 2).sum(1))
            levels.append((at[chain[lo]], lo, np.maximum.reduceat(gaps, lo)))
        return cls(points[order], counts[order], levels), at[place]

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point its nearest entry (ties: the lower index); per entry the sums: count, then components."""
        first = np.sort(np.unique(entries, axis=0, return_index=True)[1])     # equal entries: the first takes all
        entry = entries[first]
        code = np.full(len(self.points), -1, dtype=np.int64)
        sums = np.zeros((len(entries), self.total.shape[1]), dtype=np.int64)
        if len(first) == 1:
            code[:] = first[0]
            sums[first[0]] = self.total[-1]
            return code, sums
        open_runs = np.array([[0, len(self.points)]])
        for centre, lo, radius in self.levels:
            hi = np.r_[lo[1:], len(self.points)]
            inside = np.searchsorted(open_runs[:, 1], lo, side="right")
            inside = np.flatnonzero((inside < len(open_runs)) & (open_runs[np.minimum(inside, len(open_runs) - 1), 0] <= lo))
            near = np.sqrt(np.maximum(_squares(self.points[centre[inside]], entry), 0).astype(np.float64))
            two = np.argpartition(near, 1, axis=1)[:, :2]
            ahead = np.take_along_axis(near, two, axis=1)
            best = two[np.arange(len(two)), ahead.argmin(axis=1)]
            sure = np.abs(ahead[:, 0] - ahead[:, 1]) > 2 * radius[inside] * (1 + 1e-9) + 1e-9 * (1 + ahead.max(axis=1))
            done = inside[sure]
            np.add.at(sums, first[best[sure]], self.total[hi[done]] - self.total[lo[done]])
            code[_spread(lo[done], hi[done])] = np.repeat(first[best[sure]], hi[done] - lo[done])
            open_runs = np.column_stack([lo, hi])[inside[~sure]]
            if not len(open_runs):
                return code, sums
        left = _spread(open_runs[:, 0], open_runs[:, 1])
        for s in range(0, len(left), 16384):
            some = left[s:s + 16384]
            best = first[_squares(self.points[some], entry).argmin(axis=1)]
            code[some] = best
            np.add.at(sums, best, self.total[some + 1] - self.total[some])
        return code, sums


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of the runs [lo, hi)."""
    size = hi - lo
    return np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(lo) else lo


def _refined(real: np.ndarray, owner: np.ndarray, gap: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The next level: the centres of the last one stay, points beyond ``r`` of all of them get new ones."""
    gap = gap.copy()
    far = np.flatnonzero(gap > r)
    old = np.unique(owner)
    for s in range(0, len(old), 512):
        if not len(far):
            break
        c = real[old[s:s + 512]]
        p = real[far]
        square = np.maximum((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :], 0)
        best = square.argmin(axis=1)
        distance = np.sqrt(square[np.arange(len(far)), best])
        near = distance <= r
        owner[far[near]], gap[far[near]] = old[s + best[near]], distance[near]
        far = far[~near]
    p = real[far]
    while len(far):
        distance = np.sqrt(((p - p[0]) ** 2).sum(1))
        near = distance <= r
        owner[far[near]], gap[far[near]] = far[0], distance[near]
        far, p = far[~near], p[~near]
    return owner, gap
