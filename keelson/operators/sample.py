"""Reproducible sampling: train/validation split and null injection.

Both are functions of (row ID, seed, column name) only, through
``hash_uniform``: the same rows are chosen whatever the partitioning, the
executor count or the engine (DuckDB reproduces them), and neither needs a
shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.exprs import qcol
from keelson.functions.hashing import hash_uniform
from keelson.functions.profile import chunked_aggregate
from keelson.functions.quantile import order_statistics, select_ranks

DEFAULT_SPLIT_SEED = 42


def split_key(id_col: str, seed: int = DEFAULT_SPLIT_SEED):
    return hash_uniform(qcol(id_col), seed)


def split_train_val(df: DataFrame, id_col: str, val_pct: float, seed: int = DEFAULT_SPLIT_SEED,
                    exact_size: bool = False) -> tuple[DataFrame, DataFrame]:
    """Disjoint, complete split; validation = rows whose hash is below ``val_pct``.

    ``exact_size=True`` takes the ceil(n * val_pct) rows with the smallest hashes
    (more only where rows equal in every column stand at the boundary: they stay on one
    side): the boundary is found by sketches (no global sort, no single-partition
    window); only it travels to the driver.
    """
    if not 0 <= val_pct < 1:
        raise ValueError("val_pct must be in [0, 1)")
    u = split_key(id_col, seed)                # never NULL: a row without an ID has a number too
    if not exact_size:
        in_val = u < F.lit(val_pct)
        return df.where(~in_val), df.where(in_val)
    # ties of the hash are ordered by a second one, of the whole row
    tie = F.xxhash64(*[qcol(c) for c in df.columns]).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    if val_pct == 0:
        return df, df.where(F.lit(False))
    wanted: list[int] = []

    def last_rank(n: int) -> list[int]:
        wanted.append(math.ceil(n * val_pct))
        return [wanted[0] - 1] if n else []

    found = order_statistics(df, {"u": (u, last_rank)})["u"]
    if not found:
        return df, df.where(F.lit(False))
    edge, rest = found[0], wanted[0] - found[0].below
    in_val = u <= F.lit(edge.value)
    if rest < edge.equal:
        last = select_ranks(df.where(u == F.lit(edge.value)), {"t": (tie, rest - 1)})["t"]
        in_val = (u < F.lit(edge.value)) | ((u == F.lit(edge.value)) & (tie <= F.lit(last)))
    return df.where(~in_val), df.where(in_val)


def inject_nulls(df: DataFrame, id_col: str, columns: list[str], p: float = 0.05,
                 seed: int = 123) -> DataFrame:
    """For each listed column that has no null, null out the rows whose hash of
    (id, seed, column) is below ``p``; if that picks no row, null the row with
    the smallest hash, so every such column gets at least one null.
    Columns that already hold a null are left alone.  Column chunks of one
    aggregate, then one projection."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    h = {c: hash_uniform(qcol(id_col), seed, c) for c in cols}
    aggs = [("__n", F.count(F.lit(1)), 1)]
    for i, c in enumerate(cols):
        aggs += [(f"nn{i}", F.count(qcol(c)), 1), (f"m{i}", F.count_if(h[c] < F.lit(p)), 1),
                 (f"fb{i}", F.min(h[c]), 1)]
    r = chunked_aggregate(df, aggs)
    out = {}
    for i, c in enumerate(cols):
        if r[f"nn{i}"] < r["__n"] or r["__n"] == 0:
            continue  # already has nulls (or empty)
        if r[f"m{i}"] > 0:
            out[c] = F.when(h[c] < F.lit(p), F.lit(None)).otherwise(qcol(c))
        else:
            out[c] = F.when(h[c] == F.lit(r[f"fb{i}"]), F.lit(None)).otherwise(qcol(c))
    if not out:
        return df
    return df.select(*[out[c].alias(c) if c in out else qcol(c) for c in df.columns])
