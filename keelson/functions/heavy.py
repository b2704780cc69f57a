"""Frequent labels without a shuffle of all distinct ones.

Every task keeps counters of at most ``slots`` labels a column.  When there are more, the
(slots + 1)-th largest count is taken off all of them and those at zero go (the frequent-items
summary of Misra and Gries in its mergeable form).  Counters of tasks are merged the same way.
What was taken off is known (``bound``), so a label that has no counter occurs at most ``bound``
times, and ``bound`` <= rows / (slots + 1).  If nothing was taken off, the counters are exact and
complete; otherwise a second pass counts the remaining labels exactly.  Callers that need more
than the labels above ``bound`` fall back to the full frequency table of that column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from keelson.functions.exprs import qcol
from keelson.functions.states import fold

SLOTS = 1024          # counters a column, at least


@dataclass
class Heavy:
    """Of one column: rows, nulls, exact counts of its frequent labels, the most that any other label can have,
    and the number of distinct labels (if ``bound`` is not 0 a lower limit, above the counters)."""

    n: int
    nulls: int
    counts: dict[str, int]
    bound: int
    distinct: int

    @property
    def complete(self) -> bool:
        return self.bound == 0

    def top(self, k: int) -> list[str] | None:
        """The k most frequent labels (ties: the smaller label first), or None if another one might be among them."""
        ranked = sorted(self.counts.items(), key=lambda e: (-e[1], e[0]))
        if self.complete or (len(ranked) >= k and ranked[k - 1][1] > self.bound):
            return [label for label, _ in ranked[:k]]
        return None


def reduced(counts: dict, bound: int, slots: int) -> tuple[dict, int]:
    """At most ``slots`` counters: the next largest count is taken off all."""
    if len(counts) <= slots:
        return counts, bound
    values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    off = int(np.partition(values, len(values) - slots - 1)[len(values) - slots - 1])
    return {label: c - off for label, c in counts.items() if c > off}, bound + off


def no_counters(width: int) -> list[tuple]:
    return [(0, 0, {}, 0)] * width


def add_labels(state: list[tuple], columns: list[pa.Array], slots: int) -> list[tuple]:
    out = []
    for (n, nulls, counts, bound), column in zip(state, columns, strict=True):
        found = pc.value_counts(column.drop_null())
        labels, more = found.field(0), found.field(1).to_numpy()
        if len(labels) > 4 * slots:
            # a batch of mostly different labels: only its larger counts can stay, the rest is taken off at once
            off = int(np.partition(more, len(more) - slots - 1)[len(more) - slots - 1])
            keep = more > off
            labels, more, bound = labels.filter(pa.array(keep)), more[keep] - off, bound + off
        counts = dict(counts)
        for label, c in zip(labels.to_pylist(), more.tolist(), strict=True):
            counts[label] = counts.get(label, 0) + c
        counts, bound = reduced(counts, bound, slots)
        out.append((n + len(column), nulls + column.null_count, counts, bound))
    return out


def merge_labels(a: list[tuple], b: list[tuple], slots: int) -> list[tuple]:
    out = []
    for (n, nulls, counts, bound), (m, more, others, other) in zip(a, b, strict=True):
        counts = dict(counts)
        for label, c in others.items():
            counts[label] = counts.get(label, 0) + c
        counts, off = reduced(counts, bound + other, slots)
        out.append((n + m, nulls + more, counts, off))
    return out


def heavy_labels(df: DataFrame, cols: list[str], slots: int = SLOTS) -> dict[str, Heavy]:
    """The frequent labels (as strings) of every column: one pass, and one more if a column has many labels."""
    if not cols:
        return {}
    labels = df.select(*[qcol(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    state = fold(labels, lambda: no_counters(len(cols)), lambda s, b: add_labels(s, b.columns, slots),
                 lambda a, b: merge_labels(a, b, slots))
    return exact_counts(labels, cols, state, slots)


def exact_counts(labels: DataFrame, cols: list[str], state: list[tuple], slots: int, also=()) -> dict[str, Heavy]:
    """``Heavy`` of each column; ``labels`` holds the columns c0, c1, ... as strings.  Labels of ``also`` are
    counted in any case."""
    open_ = [i for i, (_, _, _, bound) in enumerate(state) if bound]
    counts = [dict(s[2]) for s in state]
    if open_:
        wanted = [pa.array(sorted({*state[i][2], *also}), pa.string()) for i in open_]

        def step(total: list[np.ndarray], b: pa.RecordBatch) -> list[np.ndarray]:
            for k, column in enumerate(b.columns):
                at = pc.index_in(column, value_set=wanted[k]).drop_null().to_numpy(zero_copy_only=False)
                total[k] = total[k] + np.bincount(at, minlength=len(wanted[k]))
            return total

        exact = fold(labels.select(*[f"c{i}" for i in open_]), lambda: [np.zeros(len(w), dtype=np.int64) for w in wanted],
                     step, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
        for i, w, total in zip(open_, wanted, exact, strict=True):
            counts[i] = dict(zip(w.to_pylist(), total.tolist(), strict=True))
    return {c: Heavy(state[i][0], state[i][1], {k: v for k, v in counts[i].items() if v}, state[i][3],
                     slots + 1 if state[i][3] else len(counts[i])) for i, c in enumerate(cols)}
