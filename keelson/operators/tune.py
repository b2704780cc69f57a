"""Hyperparameter search: n trials that share the scans of the training vectors.

Every scan returns the statistics of all open trials at once (``newton.py``), one more scan of
the validation vectors the residual sums of all fitted ones.  A trial's parameters come from a
seeded hash of (seed, trial number, parameter name), so they do not depend on the
other trials.  Result: best parameters plus the trials as a DataFrame (number, one
column per parameter, value).
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from keelson.functions.states import fold, matrix, merge_moments, moments_of, no_moments
from keelson.operators.model import DEFAULT_ALPHA, DEFAULT_EPSILON, training_vectors
from keelson.operators.newton import newton_fits

# The reference's search space and trial count.
DEFAULT_SPACE = [
    {"name": "alpha", "type": "real", "search_type": "log-uniform", "range_low": 1e-6, "range_high": 1.0},
    {"name": "epsilon", "type": "real", "search_type": "uniform", "range_low": 1.0, "range_high": 2.0},
]
DEFAULT_TRIALS = 20
BAD_SCORE = 1.0e6


def _u(seed: int, trial: int, name: str) -> float:
    h = hashlib.md5(f"{seed}|{trial}|{name}".encode()).hexdigest()
    return int(h[:13], 16) / float(16 ** 13)


def sample_params(space: list[dict], trial: int, seed: int = 5) -> dict:
    """Parameters of one trial.  Types: int / real (alias float) with search
    type uniform / log-uniform, and categorical; anything else raises."""
    out = {}
    for hp in space:
        typ, st, name = hp["type"], hp.get("search_type"), hp["name"]
        typ = "real" if typ == "float" else typ
        u = _u(seed, trial, name)
        if typ == "categorical":
            cats = hp["categories"]
            out[name] = cats[min(int(u * len(cats)), len(cats) - 1)]
            continue
        lo, hi = hp["range_low"], hp["range_high"]
        if (typ, st) == ("real", "uniform"):
            out[name] = lo + u * (hi - lo)
        elif (typ, st) == ("real", "log-uniform"):
            out[name] = math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))
        elif (typ, st) == ("int", "uniform"):
            out[name] = int(lo + math.floor(u * (hi - lo + 1)))
        elif (typ, st) == ("int", "log-uniform"):
            out[name] = int(round(math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))))
        else:
            raise ValueError(f"search space entry {name!r}: no sampler for type {hp['type']!r} with search type {st!r}")
    return out


@dataclass
class TuneResult:
    best_params: dict
    best_value: float
    trials: DataFrame


def narrowed_space(space: list[dict], best: list[dict]) -> list[dict]:
    """Ranges shrunk to the span of the best trials' values (int / real only)."""
    out = []
    for hp in space:
        vals = [b[hp["name"]] for b in best]
        if hp["type"] in ("int", "real", "float") and len(vals) > 1 and min(vals) < max(vals):
            out.append(dict(hp, range_low=min(vals), range_high=max(vals)))
        else:
            out.append(hp)
    return out


def r2_values(vectors: DataFrame, d: int, points: np.ndarray) -> list[float]:
    """R^2 of every fitted point (w, c, ...) over all rows, in one scan; see ``r2_expr`` for a constant label."""

    def step(state, b):
        x, y = matrix(b.column(0), d), b.column(1).to_numpy(zero_copy_only=False)
        rest = x @ points[:, :d].T + points[:, d] - y[:, None]
        return merge_moments(state[0], moments_of(y[:, None])), state[1] + (rest * rest).sum(axis=0)

    label, rest = fold(vectors, lambda: (no_moments(1), np.zeros(len(points))), step,
                       lambda a, b: (merge_moments(a[0], b[0]), a[1] + b[1]))
    if not label[0, 0]:
        return [float("nan")] * len(points)
    total = label[2, 0]
    return [(1.0 if r == 0 else 0.0) if total == 0 else 1.0 - r / total for r in rest.tolist()]


def tune(spark: SparkSession, train: DataFrame, valid: DataFrame, feature_cols: list[str], label: str,
         space: list[dict] | None = None, num_trials: int = DEFAULT_TRIALS, seed: int = 5,
         parallelism: int | None = None, is_minimize: bool = False, max_iter: int = 100,
         refine_trials: int = 0, refine_top: int = 3, vectors: DataFrame | None = None) -> TuneResult:
    """``refine_trials`` > 0 adds a second round sampled inside the span of the
    ``refine_top`` best first-round trials.  ``parallelism``: trials that share a scan
    (default: as many as their statistics fit); results do not depend on it.  ``vectors``:
    persisted training vectors of the caller (``training_vectors``)."""
    space = space or DEFAULT_SPACE
    assert num_trials >= 2, "Hyperparameter Tuning needs at least 2 trials"
    d = len(feature_cols)
    tr = vectors if vectors is not None else training_vectors(train, feature_cols, label)
    va = training_vectors(valid, feature_cols, label)

    def values_of(trials: list[dict]) -> list[float]:
        fits = newton_fits(tr, d, [(float(p.get("alpha", DEFAULT_ALPHA)), float(p.get("epsilon", DEFAULT_EPSILON)))
                                   for p in trials], max_iter, together=parallelism)
        scores = [round(r, 6) for r in r2_values(va, d, np.array([f.point for f in fits]))]
        bad = BAD_SCORE if is_minimize else -BAD_SCORE
        scores = [s if math.isfinite(s) else bad for s in scores]
        return [s if is_minimize else -s for s in scores]           # the study always minimises

    try:
        params = [sample_params(space, t, seed) for t in range(num_trials)]
        values = values_of(params)
        if refine_trials > 0:
            top = sorted(range(num_trials), key=lambda t: (values[t], t))[:max(2, refine_top)]
            inner = narrowed_space(space, [params[t] for t in top])
            more = [sample_params(inner, num_trials + j, seed) for j in range(refine_trials)]
            params, values = params + more, values + values_of(more)
        num_trials = len(params)
    finally:
        if vectors is None:
            tr.unpersist()
        va.unpersist()
    best = min(range(num_trials), key=lambda t: (values[t], t))
    names = [hp["name"] for hp in space]
    rows = [tuple([t] + [float(params[t][k]) if not isinstance(params[t][k], str) else params[t][k]
                         for k in names] + [float(values[t])]) for t in range(num_trials)]
    trials = spark.createDataFrame(rows, ["number"] + [f"params_{k}" for k in names] + ["value"])
    return TuneResult(params[best], values[best], trials)
