"""Feature selection by data statistics: constant (A9), duplicate (A10) and
correlated (A12) columns.

None of them compares rows pairwise or columns by collecting them:
constants come from min / max / null counts (codegen-sized column chunks);
duplicates from an order-independent signature per column (a multiset hash),
followed by an exact ``<=>`` check of the candidates only;
correlation from one distributed Gram pass (MLlib ``Correlation``), leaving a
d x d matrix on the driver.
"""

from __future__ import annotations

import math
from collections import OrderedDict

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.exprs import qcol
from keelson.functions.heavy import SLOTS, heavy_labels
from keelson.functions.profile import chunked_aggregate, frequency_table, null_counts
from keelson.operators.base import StageEstimator, StageModel, param, present

# Library messages the reference surfaces.
ALL_CONSTANT_MESSAGE = ("The resulting dataframe will have no columns after dropping all constant or "
                        "quasi-constant features. Try changing the tol value.")
MISSING_VALUES_MESSAGE = "Some of the variables contain missing values"

MAX_SLOTS = 1 << 16      # counters a column; smaller tolerances count every distinct value

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def type_group(dt: T.DataType) -> str:
    if isinstance(dt, _INTEGRAL):
        return "i"
    if isinstance(dt, _FRACTIONAL):
        return "d"
    return "s"


def column_facts(df: DataFrame, cols: list[str], id_col: str | None = None) -> dict:
    """Per column: n, non-null count, min, max and, when ``id_col`` is given, a
    duplicate-candidate signature.

    Codegen-sized column chunks (``chunked_aggregate``).  Strings are not
    min/max-aggregated (a string buffer turns the hash aggregate into a sort
    aggregate): the extremes of ``xxhash64(value)`` decide "one distinct
    value", confirmed exactly for the few string columns that look constant.

    The signature is a multiset hash, ``sum(xxhash64(value) & 0xFFFF)`` (no
    overflow below ~1.4e14 rows), so no chunk has to read the ID column; columns
    that share (type, counts, extremes, signature) are only candidates, settled
    by the exact ``<=>`` check.
    """
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = [("__n", F.count(F.lit(1)), 1)]
    for i, c in enumerate(cols):
        x = qcol(c)
        probe = F.xxhash64(x) if type_group(types[c]) == "s" else x
        exprs += [(f"nn{i}", F.count(x), 1), (f"lo{i}", F.min(F.when(x.isNotNull(), probe)), 1),
                  (f"hi{i}", F.max(F.when(x.isNotNull(), probe)), 1)]
        if id_col:
            exprs.append((f"fp{i}", F.sum(F.when(x.isNotNull(), F.xxhash64(x).bitwiseAND(F.lit(65535)))), 1))
    r = chunked_aggregate(df, exprs)
    out = {}
    for i, c in enumerate(cols):
        out[c] = dict(n=r["__n"], nn=r[f"nn{i}"], min=r[f"lo{i}"], max=r[f"hi{i}"],
                      fp=r[f"fp{i}"] if id_col else None, group=type_group(types[c]), type=types[c].simpleString())
    suspects = [c for c in cols if out[c]["group"] == "s" and out[c]["nn"] and out[c]["min"] == out[c]["max"]]
    if suspects:
        rr = chunked_aggregate(df, [(f"e{k}", F.min(qcol(c)) == F.max(qcol(c)), 2) for k, c in enumerate(suspects)])
        for k, c in enumerate(suspects):
            if not rr[f"e{k}"]:
                out[c]["max"] = None  # hash tie between different strings: not constant
    return out


def candidate_cols(df: DataFrame, input_cols, exclude) -> list[str]:
    if input_cols:
        return present(input_cols, df.columns)
    ex = set(exclude or [])
    return [c for c in df.columns if c not in ex]


class DropColumnsModel(StageModel):
    """Drop a fitted list of columns (absent ones are ignored)."""

    dropCols = param("dropCols")
    groups = param("groups", "column groups found at fit (informative)")
    _defaults = dict(dropCols=[], groups=[])

    def apply(self, cols, types=None):
        drop = set(self.v("dropCols"))
        return OrderedDict((n, e) for n, e in cols.items() if n not in drop)

    apply_sql = apply


# --------------------------------------------------------------------------
# A9 drop_constant
def constant_from_facts(f: dict, missing_values: str) -> bool:
    if missing_values == "include":
        # null counts as a value: constant if all null, or no null and one value
        return f["nn"] == 0 or (f["nn"] == f["n"] and f["min"] == f["max"])
    return f["nn"] > 0 and f["min"] == f["max"]


def top_counts(df: DataFrame, cols: list[str], nulls: bool) -> dict[str, int]:
    """Count of the most frequent value of each column (at least of any value held by half the rows).

    ``mode`` of a bounded hash would need every distinct value; instead a majority
    candidate is found bit by bit: bit b of the majority value's hash is the bit that
    more than half of the rows have.  64 sums a column decide the only hash that can hold a
    majority, a second aggregate counts it.  Where no value holds half the rows the
    count is of some value or zero, which is below half: exact for tolerances above one half.
    """
    keys = {c: F.xxhash64(F.coalesce(qcol(c).cast("string"), F.lit("\u0000null")) if nulls else qcol(c).cast("string"))
            for c in cols}
    counted = {c: F.lit(True) if nulls else qcol(c).isNotNull() for c in cols}
    bits = chunked_aggregate(df, [(f"b{i}_{k}", F.sum(F.when(counted[c], F.lit(1) - F.lit(2) * F.getbit(keys[c], F.lit(k)))), 1)
                                  for i, c in enumerate(cols) for k in range(64)])
    major = {}
    for i, c in enumerate(cols):
        value = sum(1 << k for k in range(64) if (bits[f"b{i}_{k}"] or 0) < 0)
        major[c] = value - (1 << 64) if value >> 63 else value
    counts = chunked_aggregate(df, [(f"m{i}", F.count_if(counted[c] & (keys[c] == F.lit(major[c]))), 1)
                                    for i, c in enumerate(cols)])
    return {c: counts[f"m{i}"] for i, c in enumerate(cols)}


def frequent_counts(df: DataFrame, cols: list[str], nulls: bool, tol: float) -> dict[str, int]:
    """The same for smaller tolerances: exact for every value that reaches ``tol`` (else of some value below it)."""
    slots = math.ceil(1 / tol) + 1 if tol > 0 else 0
    if 0 < slots <= MAX_SLOTS:
        heavy = heavy_labels(df, cols, max(SLOTS, slots))
        return {c: max([*h.counts.values(), h.nulls if nulls else 0], default=0) for c, h in heavy.items()}
    freq = frequency_table(df, cols)
    rows = (freq if nulls else freq.where(F.col("value").isNotNull())).groupBy("col").agg(F.max("cnt").alias("m")).collect()
    return dict.fromkeys(cols, 0) | {r["col"]: r["m"] for r in rows}


class DropConstant(StageEstimator):
    """Drop columns with one distinct value (``tol`` = 1) or whose top value
    has a share >= ``tol`` (``tol`` < 1).  ``missingValues``: 'include' counts
    NULL as a value, 'ignore' skips it, 'raise' fails on NULL."""

    inputCols = param("inputCols")
    excludeCols = param("excludeCols")
    tol = param("tol")
    missingValues = param("missingValues")
    _defaults = dict(inputCols=[], excludeCols=[], tol=1.0, missingValues="include")

    def _fit(self, df):
        cols = candidate_cols(df, self.v("inputCols"), self.v("excludeCols"))
        mv, tol = self.v("missingValues"), float(self.v("tol"))
        drop = []
        if cols and tol >= 1:
            facts = column_facts(df, cols)
            if mv == "raise" and any(facts[c]["nn"] < facts[c]["n"] for c in cols):
                raise ValueError(MISSING_VALUES_MESSAGE)
            drop = [c for c in cols if constant_from_facts(facts[c], mv)]
        elif cols:
            n, present_ = null_counts(df, cols)
            if mv == "raise" and any(present_[c] < n for c in cols):
                raise ValueError(MISSING_VALUES_MESSAGE)
            top = top_counts(df, cols, nulls=mv == "include") if tol > 0.5 else frequent_counts(df, cols, mv == "include", tol)
            rows = {c: n if mv == "include" else present_[c] for c in cols}
            drop = [c for c in cols if rows[c] and top[c] / rows[c] >= tol]
        if cols and len(drop) == len(cols):
            raise ValueError(ALL_CONSTANT_MESSAGE)
        return DropColumnsModel(dropCols=drop)


# --------------------------------------------------------------------------
# A10 drop_duplicate
def duplicate_groups(df: DataFrame, cols: list[str], facts: dict) -> list[list[str]]:
    """Exact classes of identical columns, from signature candidates.

    Columns are bucketed by (type, signature, counts, extremes).  Every column of a
    bucket is compared with the bucket's first one only (``count_if(NOT a <=> b)``, in
    codegen-sized chunks); those that differ form buckets for the next round.  So the
    comparisons are as many as the columns, unless different columns share a signature.
    """
    buckets: dict = {}
    for c in sorted(cols):
        f = facts[c]
        buckets.setdefault((f["type"], f["fp"], f["n"], f["nn"], f["min"], f["max"]), []).append(c)
    open_, classes = [g for g in buckets.values() if len(g) > 1], []
    while open_:
        pairs = [(g[0], c) for g in open_ for c in g[1:]]
        unequal = chunked_aggregate(df, [(f"p{k}", F.count_if(~qcol(a).eqNullSafe(qcol(b))), 1)
                                         for k, (a, b) in enumerate(pairs)])
        differs = {pair for k, pair in enumerate(pairs) if unequal[f"p{k}"]}
        rest = []
        for g in open_:
            classes.append([g[0]] + [c for c in g[1:] if (g[0], c) not in differs])
            rest.append([c for c in g[1:] if (g[0], c) in differs])
        open_ = [g for g in rest if len(g) > 1]
    return sorted(g for g in classes if len(g) > 1)


class DropDuplicate(StageEstimator):
    """Among identical columns keep the first by name; a NULL raises."""

    inputCols = param("inputCols")
    excludeCols = param("excludeCols")
    idCol = param("idCol")
    _defaults = dict(inputCols=[], excludeCols=[], idCol=None)

    def _fit(self, df):
        cols = candidate_cols(df, self.v("inputCols"), self.v("excludeCols"))
        id_col = self.v("idCol")
        if not id_col:
            raise ValueError("DropDuplicate needs idCol: fingerprints pair values with row ids")
        cols = [c for c in cols if c != id_col]
        facts = column_facts(df, cols, id_col)
        nulls = [c for c in cols if facts[c]["nn"] < facts[c]["n"]]
        if nulls:
            raise ValueError(f"{MISSING_VALUES_MESSAGE}: {nulls}")
        groups = duplicate_groups(df, cols, facts)
        return DropColumnsModel(dropCols=[c for g in groups for c in g[1:]], groups=groups)


# --------------------------------------------------------------------------
# A12 drop_correlated
def correlation_matrix(df: DataFrame, cols: list[str]) -> list[list[float]]:
    """Pearson matrix of ``cols`` (one distributed pass; d x d on the driver).
    A NULL raises (VectorAssembler handleInvalid='error')."""
    slots = [f"__x{i}" for i in range(len(cols))]  # positional aliases: names may hold dots
    vec = VectorAssembler(inputCols=slots, outputCol="__features", handleInvalid="error")
    m = Correlation.corr(vec.transform(df.select(*[qcol(c).cast("double").alias(a) for c, a in zip(cols, slots)])),
                         "__features", "pearson").first()[0]
    return m.toArray().tolist()


def correlated_groups(cols: list[str], corr: list[list[float]], threshold: float) -> list[list[str]]:
    """Greedy grouping in name order: a column not yet grouped opens a group with
    every later ungrouped column whose |r| > threshold.  NaN (constant column)
    counts as uncorrelated."""
    idx = {c: i for i, c in enumerate(cols)}
    order = sorted(cols)
    seen: set = set()
    groups = []
    for i, a in enumerate(order):
        if a in seen:
            continue
        seen.add(a)
        grp = [a]
        for b in order[i + 1:]:
            if b in seen:
                continue
            r = corr[idx[a]][idx[b]]
            if r == r and abs(r) > threshold:
                grp.append(b)
                seen.add(b)
        if len(grp) > 1:
            groups.append(grp)
    return groups


def pick_by_variance(df: DataFrame, groups: list[list[str]], variances: dict | None = None) -> list[str]:
    """Columns to drop: all but the highest sample variance of each group
    (ties: smaller name)."""
    if not groups:
        return []
    need = sorted({c for g in groups for c in g})
    if variances is None:
        r = chunked_aggregate(df, [(f"v{k}", F.var_samp(qcol(c).cast("double")), 3) for k, c in enumerate(need)])
        variances = {c: r[f"v{k}"] for k, c in enumerate(need)}
    drop = []
    for g in groups:
        best = sorted(g, key=lambda c: (-(variances[c] if variances[c] is not None else float("-inf")), c))[0]
        drop += [c for c in g if c != best]
    return drop


class DropCorrelated(StageEstimator):
    """Keep the highest-variance column of each group of columns correlated
    above ``threshold`` (Pearson); a NULL raises."""

    inputCols = param("inputCols")
    excludeCols = param("excludeCols")
    threshold = param("threshold")
    _defaults = dict(inputCols=[], excludeCols=[], threshold=0.8)

    def _fit(self, df):
        if self.v("inputCols"):
            cols = present(self.v("inputCols"), df.columns)
        else:
            ex = set(self.v("excludeCols"))
            cols = [f.name for f in df.schema.fields
                    if f.name not in ex and isinstance(f.dataType, _INTEGRAL + _FRACTIONAL)
                    and not isinstance(f.dataType, T.BooleanType)]
        if len(cols) < 2:
            return DropColumnsModel(dropCols=[])
        groups = correlated_groups(cols, correlation_matrix(df, cols), float(self.v("threshold")))
        return DropColumnsModel(dropCols=pick_by_variance(df, groups), groups=groups)


__all__ = ["DropConstant", "DropDuplicate", "DropCorrelated", "DropColumnsModel", "column_facts",
           "constant_from_facts", "duplicate_groups", "correlation_matrix", "correlated_groups",
           "pick_by_variance"]
