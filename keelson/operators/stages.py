"""Column stages: projections, casts, imputers, scalers, encoders.

Each fit is one distributed aggregate that yields a small state (a few
numbers or labels per column); each transform is a row-wise projection with
literals.  Selection stages (constant / duplicate / correlated) live in
``selection.py``.
"""

from __future__ import annotations

import math
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.exprs import (
    JAVA_ONLY_NUMBER,
    NULL_LABEL,
    WHOLE_PATTERN,
    clip_expr,
    one_hot_name,
    qcol,
    to_double,
    to_label,
    to_whole,
)
from keelson.functions.heavy import SLOTS, Heavy, heavy_labels
from keelson.functions.profile import chunked_aggregate, frequency_table, null_counts, numeric_profile
from keelson.functions.quantile import exact_quantile
from keelson.functions.topk import top_k_per_group
from keelson.functions.sqltext import lit as sql_lit
from keelson.operators.base import StageEstimator, StageModel, StageTransformer, param, present

# Fixed values (defaults of the reference's configuration and libraries).
MISSING_TAG = "missing"
RARE_LABEL = "Rare"
ALL_NULL_MESSAGE = "All features in the input dataframe are NaN. Dropping all yields empty dataframe"
ONE_HOT_MISSING_MESSAGE = "one-hot: column {c} was seen at fit but is not in the data"
TARGET_MISSING_MESSAGE = ("Target field not present in data. Expecting target field: {t}. "
                          "Cannot encode target.")


# --------------------------------------------------------------------------
# col_select
class ColumnSelector(StageTransformer):
    """Keep the listed columns that exist (in data order) or drop them.

    ``passthrough`` columns (ID, target) are never removed by ``keep``.
    """

    columns = param("columns")
    selectorType = param("selectorType", "keep | drop")
    passthrough = param("passthrough")
    _defaults = dict(columns=[], selectorType="keep", passthrough=[])

    def apply(self, cols, types=None):
        mode = self.v("selectorType")
        if mode not in ("keep", "drop"):
            raise AssertionError(f"selectorType must be 'keep' or 'drop', not {mode!r}")
        listed = set(self.v("columns"))
        keep_always = set(self.v("passthrough"))
        if mode == "keep":
            return OrderedDict((n, e) for n, e in cols.items() if n in listed or n in keep_always)
        return OrderedDict((n, e) for n, e in cols.items() if n not in listed or n in keep_always)

    apply_sql = apply


# --------------------------------------------------------------------------
# cast_str / cast_float / cast_int
class TypeCaster(StageTransformer):
    """Cast listed columns to 'string', 'double', 'float', 'bigint' or 'int'.

    Doubles: NaN becomes NULL.  Strings: booleans spelled 'True'/'False';
    ``nullsAsLabel`` turns NULL into the label 'nan' (see README, "nulls").
    A string that is not a number raises under ANSI mode, as in the reference.
    """

    inputCols = param("inputCols")
    castType = param("castType")
    nullsAsLabel = param("nullsAsLabel")
    _defaults = dict(inputCols=[], castType="string", nullsAsLabel=False)

    def apply(self, cols, types=None):
        types = types or {}
        kind = self.v("castType")
        out = OrderedDict(cols)
        for c in present(self.v("inputCols"), cols):
            e, t = cols[c], types.get(c)
            if kind in ("string", "str"):
                out[c] = to_label(e, t, self.v("nullsAsLabel"))
            elif kind in ("double", "float"):
                out[c] = to_double(e, t)
            elif kind in ("bigint", "long", "int"):
                out[c] = to_whole(e, t)
            else:
                raise ValueError(f"unknown castType {kind}")
        return out

    def apply_sql(self, cols, types=None):
        types = types or {}
        kind = self.v("castType")
        out = OrderedDict(cols)
        for c in present(self.v("inputCols"), cols):
            e, t = cols[c], types.get(c)
            if kind in ("string", "str"):
                out[c] = label_sql(e, t, self.v("nullsAsLabel"))
            elif kind in ("double", "float"):
                out[c] = double_sql(e, t)
            elif kind in ("bigint", "long", "int"):
                out[c] = whole_sql(e, t)
            else:
                raise ValueError(f"unknown castType {kind}")
        return out


def text_number_sql(e: str) -> str:
    """SQL twin of ``text_number``."""
    return f"CASE WHEN NOT {e} RLIKE {sql_lit(JAVA_ONLY_NUMBER)} THEN TRY_CAST({e} AS DOUBLE) END"


def double_sql(e: str, t) -> str:
    """SQL twin of ``to_double``."""
    if isinstance(t, T.BooleanType):
        e = f"CAST({e} AS INT)"
    if isinstance(t, T.StringType):
        number = text_number_sql(e)
        e = (f"CASE WHEN {e} IS NOT NULL AND ({number}) IS NULL THEN "
             f"CAST(raise_error(concat('not a number: ', {e})) AS DOUBLE) ELSE {number} END")
    return f"nanvl(CAST({e} AS DOUBLE), CAST(NULL AS DOUBLE))"


def whole_sql(e: str, t) -> str:
    """SQL twin of ``to_whole``."""
    if isinstance(t, T.StringType):
        return (f"CASE WHEN {e} RLIKE {sql_lit(WHOLE_PATTERN)} THEN CAST(trim({e}) AS BIGINT) "
                f"ELSE CAST({double_sql(e, t)} AS BIGINT) END")
    return f"CAST({e} AS BIGINT)"


def double_text_sql(d: str) -> str:
    """SQL twin of ``double_text``."""
    s = f"CAST({d} AS STRING)"
    body = f"ltrim('-', {s})"
    whole_text = f"substring_index({body}, 'E', 1)"
    x = f"CASE WHEN contains({body}, 'E') THEN CAST(substring_index({body}, 'E', -1) AS INT) ELSE 0 END"
    whole = f"substring_index({whole_text}, '.', 1)"
    part = f"CASE WHEN substring_index({whole_text}, '.', -1) = '0' THEN '' ELSE substring_index({whole_text}, '.', -1) END"
    digits = f"concat({whole}, {part})"
    big = (f"CASE WHEN length({digits}) - 1 <= ({x}) THEN concat(rpad({digits}, ({x}) + 1, '0'), '.0') "
           f"ELSE concat(substring({digits}, 1, ({x}) + 1), '.', substring({digits}, ({x}) + 2, length({digits}))) END")
    small = f"concat('0.', repeat('0', -({x}) - 1), {digits})"
    scientific = (f"concat({whole}, CASE WHEN ({part}) <> '' THEN concat('.', {part}) ELSE '' END, "
                  f"CASE WHEN ({x}) < 0 THEN 'e-' ELSE 'e+' END, CASE WHEN abs({x}) < 10 THEN '0' ELSE '' END, "
                  f"CAST(abs({x}) AS STRING))")
    return (f"CASE WHEN isnan({d}) THEN {sql_lit(NULL_LABEL)} "
            f"WHEN abs({d}) = CAST('Infinity' AS DOUBLE) THEN CASE WHEN {d} < 0 THEN '-inf' ELSE 'inf' END "
            f"ELSE concat(CASE WHEN startswith({s}, '-') THEN '-' ELSE '' END, "
            f"CASE WHEN NOT contains({body}, 'E') THEN {body} WHEN ({x}) BETWEEN 1 AND 15 THEN {big} "
            f"WHEN ({x}) BETWEEN -4 AND -1 THEN {small} ELSE {scientific} END) END")


def label_sql(e: str, t, nulls_as_label: bool) -> str:
    """SQL twin of ``to_label``."""
    if isinstance(t, T.BooleanType):
        s = f"initcap(CAST({e} AS STRING))"
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        s = double_text_sql(f"CAST({e} AS DOUBLE)")
    else:
        s = f"CAST({e} AS STRING)"
    if nulls_as_label:
        s = f"coalesce({s}, {sql_lit(NULL_LABEL)})"
    return s


def clip_sql(e: str, lower, upper) -> str:
    """SQL twin of ``clip_expr``."""
    if lower is None and upper is None:
        return e
    out = e
    if upper is not None:
        out = f"least({out}, {sql_lit(float(upper))})"
    if lower is not None:
        out = f"greatest({out}, {sql_lit(float(lower))})"
    return f"CASE WHEN {e} IS NOT NULL THEN {out} END"


# --------------------------------------------------------------------------
# clip
class ValueClipper(StageTransformer):
    inputCols = param("inputCols")
    lower = param("lower")
    upper = param("upper")
    _defaults = dict(inputCols=[], lower=None, upper=None)

    def apply(self, cols, types=None):
        out = OrderedDict(cols)
        for c in present(self.v("inputCols"), cols):
            out[c] = clip_expr(cols[c], self.v("lower"), self.v("upper"))
        return out

    def apply_sql(self, cols, types=None):
        out = OrderedDict(cols)
        for c in present(self.v("inputCols"), cols):
            out[c] = clip_sql(cols[c], self.v("lower"), self.v("upper"))
        return out


# --------------------------------------------------------------------------
# A1 drop_all_null
class DropAllNullModel(StageModel):
    inputCols = param("inputCols")
    dropCols = param("dropCols")
    _defaults = dict(inputCols=[], dropCols=[])

    def apply(self, cols, types=None):
        drop = set(self.v("dropCols"))
        if not drop:
            return cols
        feats = present(self.v("inputCols"), cols)
        if feats and all(c in drop for c in feats):
            raise ValueError(ALL_NULL_MESSAGE)
        return OrderedDict((n, e) for n, e in cols.items() if n not in drop)

    apply_sql = apply


class DropAllNull(StageEstimator):
    inputCols = param("inputCols")
    _defaults = dict(inputCols=[])

    def _fit(self, df: DataFrame) -> DropAllNullModel:
        cols = present(self.v("inputCols"), df.columns)
        drop = []
        if cols:
            _, nn = null_counts(df, cols)
            drop = [c for c in cols if nn[c] == 0]
        return DropAllNullModel(inputCols=cols, dropCols=drop)


# --------------------------------------------------------------------------
# A2 missing_indicator
class MissingIndicatorModel(StageModel):
    indicatorCols = param("indicatorCols")
    suffix = param("suffix")
    _defaults = dict(indicatorCols=[], suffix="_na")

    def apply(self, cols, types=None):
        out = OrderedDict(cols)
        for c in present(self.v("indicatorCols"), cols):
            out[c + self.v("suffix")] = cols[c].isNull().cast("int")
        return out

    def apply_sql(self, cols, types=None):
        out = OrderedDict(cols)
        for c in present(self.v("indicatorCols"), cols):
            out[c + self.v("suffix")] = f"CAST({cols[c]} IS NULL AS INT)"
        return out


class MissingIndicator(StageEstimator):
    """Add ``<col>_na`` (0/1) for the columns that had a null at fit time."""

    inputCols = param("inputCols")
    suffix = param("suffix")
    _defaults = dict(inputCols=[], suffix="_na")

    def _fit(self, df):
        cols = present(self.v("inputCols"), df.columns)
        prof = numeric_null_counts(df, cols)
        return MissingIndicatorModel(indicatorCols=[c for c in cols if prof[c] > 0], suffix=self.v("suffix"))


def numeric_null_counts(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    n, nn = null_counts(df, cols)
    return {c: n - nn[c] for c in cols}


# --------------------------------------------------------------------------
# A3 mean_impute / A4 median_impute / A7 missing_tag / A6 mode_impute (models)
class FillModel(StageModel):
    """Fill NULLs of each column with a literal (number or label)."""

    fillCols = param("fillCols")
    fillValues = param("fillValues")
    _defaults = dict(fillCols=[], fillValues=[])

    def apply(self, cols, types=None):
        out = OrderedDict(cols)
        for c, v in zip(self.v("fillCols"), self.v("fillValues")):
            if c in cols and v is not None:
                out[c] = F.coalesce(cols[c], F.lit(v))
        return out

    def apply_sql(self, cols, types=None):
        out = OrderedDict(cols)
        for c, v in zip(self.v("fillCols"), self.v("fillValues")):
            if c in cols and v is not None:
                out[c] = f"coalesce({cols[c]}, {sql_lit(v)})"
        return out

    def fills(self) -> dict:
        return dict(zip(self.v("fillCols"), self.v("fillValues")))


class MeanMedianImputer(StageEstimator):
    """Fill numeric NULLs with the training mean or median.

    ``exact=True`` (default) computes the exact interpolated median by
    histogram narrowing (bounded memory); ``exact=False`` uses
    ``percentile_approx`` with ``accuracy``.
    """

    inputCols = param("inputCols")
    method = param("method", "mean | median")
    exact = param("exact")
    accuracy = param("accuracy")
    _defaults = dict(inputCols=[], method="mean", exact=True, accuracy=100000)

    def _fit(self, df):
        cols = present(self.v("inputCols"), df.columns)
        return FillModel(fillCols=cols, fillValues=fit_numeric_fill(
            df, cols, self.v("method"), self.v("exact"), self.v("accuracy")))


def fit_numeric_fill(df, cols, method, exact=True, accuracy=100000, profile=None) -> list:
    if not cols:
        return []
    if method == "mean":
        profile = profile or numeric_profile(df, cols)
        return [profile[c]["mean"] for c in cols]
    if method != "median":
        raise ValueError(f"unknown imputation method {method}")
    if exact:
        med = exact_quantile(df, cols, 0.5, profile=profile)
        return [med[c] for c in cols]
    r = chunked_aggregate(df, [(f"m{i}", F.percentile_approx(qcol(c).cast("double"), 0.5, accuracy), 8)
                               for i, c in enumerate(cols)])
    return [r[f"m{i}"] for i in range(len(cols))]


# --------------------------------------------------------------------------
# A5 standard_scale / A13 target_scale
class StandardScalerModel(StageModel):
    """(x - mean) / population std; a zero std divides by 1."""

    scaleCols = param("scaleCols")
    means = param("means")
    stds = param("stds")
    _defaults = dict(scaleCols=[], means=[], stds=[])

    def apply(self, cols, types=None):
        out = OrderedDict(cols)
        for c, m, s in zip(self.v("scaleCols"), self.v("means"), self.v("stds")):
            if c in cols:
                out[c] = (cols[c].cast("double") - F.lit(m)) / F.lit(s)
        return out

    def apply_sql(self, cols, types=None):
        out = OrderedDict(cols)
        for c, m, s in zip(self.v("scaleCols"), self.v("means"), self.v("stds")):
            if c in cols:
                out[c] = f"((CAST({cols[c]} AS DOUBLE) - {sql_lit(m)}) / {sql_lit(s)})"
        return out

    def inverse(self, name: str, c):
        for n, m, s in zip(self.v("scaleCols"), self.v("means"), self.v("stds")):
            if n == name:
                return c * F.lit(s) + F.lit(m)
        raise KeyError(name)


def safe_std(s) -> float:
    return 1.0 if s is None or s == 0 or s != s else float(s)


class StandardScaler(StageEstimator):
    inputCols = param("inputCols")
    _defaults = dict(inputCols=[])

    def _fit(self, df):
        cols = present(self.v("inputCols"), df.columns)
        prof = numeric_profile(df, cols)
        return StandardScalerModel(scaleCols=cols, means=[prof[c]["mean"] or 0.0 for c in cols],
                                   stds=[safe_std(prof[c]["std_pop"]) for c in cols])


class TargetScaler(StageEstimator):
    """Standard-scale the target; fitting without the target raises."""

    targetCol = param("targetCol")
    _defaults = dict(targetCol="target")

    def _fit(self, df):
        t = self.v("targetCol")
        if t not in df.columns:
            raise ValueError(TARGET_MISSING_MESSAGE.format(t=t))
        return StandardScaler(inputCols=[t]).fit(df)


# --------------------------------------------------------------------------
# categorical helpers on the long frequency table
def category_summary(freq: DataFrame) -> dict:
    """Per column: n (rows), nulls, distinct non-null values, mode (count desc,
    value asc) and its count.  One small aggregate over the frequency table."""
    nn = F.col("value").isNotNull()
    rows = (freq.groupBy("col")
            .agg(F.sum("cnt").alias("n"),
                 F.sum(F.when(~nn, F.col("cnt")).otherwise(0)).alias("nulls"),
                 F.count_if(nn).alias("distinct"),
                 F.min(F.when(nn, F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("value"))))
                 .alias("mode"))
            .collect())
    out = {}
    for r in rows:
        m = r["mode"]
        out[r["col"]] = dict(n=r["n"], nulls=r["nulls"], distinct=r["distinct"],
                             mode=m["value"] if m else None, mode_count=-m["neg"] if m else 0)
    return out


MAX_SLOTS = 1 << 16


def label_slots(tol: float = 1.0, n_categories: int = 0) -> int:
    """Counters a column so that every label with a share of ``tol`` has one, and small columns are complete."""
    return min(MAX_SLOTS, max(SLOTS, math.ceil(1 / tol) + 1 if tol > 0 else MAX_SLOTS, n_categories + 1))


def modes(df: DataFrame, heavy: dict[str, Heavy]) -> dict[str, str | None]:
    """The most frequent label of each column (ties: the smaller one).  Columns in which no label stands out
    from those without a counter are counted in full."""
    tops = {c: h.top(1) for c, h in heavy.items()}
    unsure = [c for c, top in tops.items() if top is None]
    full = category_summary(frequency_table(df, unsure)) if unsure else {}
    return {c: full[c]["mode"] if top is None else (top[0] if top else None) for c, top in tops.items()}


class MostFrequentImputer(StageEstimator):
    """Fill NULLs with the mode where the training null share is below ``threshold``."""

    inputCols = param("inputCols")
    threshold = param("threshold")
    _defaults = dict(inputCols=[], threshold=0.1)

    def _fit(self, df):
        cols = present(self.v("inputCols"), df.columns)
        heavy = heavy_labels(df, cols)
        fitted = {c: h for c, h in heavy.items() if h.n and h.nulls / h.n < self.v("threshold")}
        top = {c: v for c, v in modes(df, fitted).items() if v is not None}
        return FillModel(fillCols=list(top), fillValues=list(top.values()))


class CategoricalImputer(StageEstimator):
    """Remaining categorical NULLs -> ``fillValue`` (method 'missing') or the mode ('frequent')."""

    inputCols = param("inputCols")
    method = param("method")
    fillValue = param("fillValue")
    _defaults = dict(inputCols=[], method="missing", fillValue=MISSING_TAG)

    def _fit(self, df):
        cols = present(self.v("inputCols"), df.columns)
        if self.v("method") == "frequent":
            top = modes(df, heavy_labels(df, cols))
            return FillModel(fillCols=cols, fillValues=[top[c] for c in cols])
        return FillModel(fillCols=cols, fillValues=[self.v("fillValue")] * len(cols))


# --------------------------------------------------------------------------
# A8 rare_label
class RareLabelModel(StageModel):
    encodeCols = param("encodeCols")
    keep = param("keep", "list of kept labels per column")
    replaceWith = param("replaceWith")
    _defaults = dict(encodeCols=[], keep=[], replaceWith=RARE_LABEL)

    def apply(self, cols, types=None):
        out = OrderedDict(cols)
        rep = F.lit(self.v("replaceWith"))
        for c, labels in zip(self.v("encodeCols"), self.v("keep")):
            if c in cols:
                e = cols[c]
                out[c] = F.when(e.isNull(), e).when(e.isin(labels), e).otherwise(rep) if labels else \
                    F.when(e.isNull(), e).otherwise(rep)
        return out

    def apply_sql(self, cols, types=None):
        out = OrderedDict(cols)
        rep = sql_lit(self.v("replaceWith"))
        for c, labels in zip(self.v("encodeCols"), self.v("keep")):
            if c in cols:
                e = cols[c]
                keep = f"WHEN {e} IN ({', '.join(sql_lit(v) for v in labels)}) THEN {e} " if labels else ""
                out[c] = f"CASE WHEN {e} IS NULL THEN {e} {keep}ELSE {rep} END"
        return out


MAX_KEPT_LABELS = 100_000


def share_reaches(cnt, n: int, tol: float):
    """The one test of a label's share, in SQL as in Python: ``cnt / n >= tol``."""
    return cnt / n >= tol if isinstance(cnt, int) else cnt / F.lit(n) >= F.lit(float(tol))


def rare_keep(counts: dict, n: int, distinct: int, tol: float, n_categories: int) -> list:
    """Kept labels of one column, given label -> count (all labels that pass
    ``share_reaches`` must be present; all labels when distinct <= n_categories)."""
    if distinct > n_categories:
        return sorted(v for v, k in counts.items() if share_reaches(k, n, tol))
    return sorted(counts)


def collect_counts(freq: DataFrame, cond, cols: list[str]) -> dict:
    """column -> label -> count of the rows that meet ``cond``: at most 1 / tol labels a column.

    A tolerance so small that more than ``MAX_KEPT_LABELS`` would be kept is refused: the kept
    labels become literals of the fitted stage.
    """
    rows = freq.where(cond).limit(MAX_KEPT_LABELS + 1).collect()
    if len(rows) > MAX_KEPT_LABELS:
        raise ValueError(f"more than {MAX_KEPT_LABELS} labels would be kept: raise the rare-label tolerance")
    counts: dict = {c: {} for c in cols}
    for r in rows:
        counts[r["col"]][r["value"]] = r["cnt"]
    return counts


def full_label_counts(df: DataFrame, cols: list[str], n: int, tol: float, n_categories: int) -> dict:
    """The same from the full frequency table: shuffles every distinct label of ``cols``."""
    full = frequency_table(df, cols).where(F.col("value").isNotNull())
    distinct = {r["col"]: r["d"] for r in full.groupBy("col").agg(F.count(F.lit(1)).alias("d")).collect()}
    small = [c for c in cols if distinct.get(c, 0) <= n_categories]
    return collect_counts(full, share_reaches(F.col("cnt"), n or 1, tol) | F.col("col").isin(small), cols)


class RareLabelEncoder(StageEstimator):
    """Labels with share < ``tol`` -> ``replaceWith`` when a column has more than
    ``nCategories`` labels; unseen labels at scoring -> ``replaceWith``."""

    inputCols = param("inputCols")
    tol = param("tol")
    nCategories = param("nCategories")
    replaceWith = param("replaceWith")
    _defaults = dict(inputCols=[], tol=0.05, nCategories=10, replaceWith=RARE_LABEL)

    def _fit(self, df):
        cols = present(self.v("inputCols"), df.columns)
        if not cols:
            return RareLabelModel(replaceWith=self.v("replaceWith"))
        tol, ncat = float(self.v("tol")), int(self.v("nCategories"))
        heavy = heavy_labels(df, cols, label_slots(tol, ncat))
        n = heavy[cols[0]].n
        # only tolerances below 1 / MAX_SLOTS can leave labels of the tolerated share without a counter
        unsure = [c for c in cols if not heavy[c].complete
                  and (share_reaches(heavy[c].bound, n, tol) or heavy[c].distinct <= ncat)]
        counts = {c: heavy[c].counts for c in cols} | (full_label_counts(df, unsure, n, tol, ncat) if unsure else {})
        distinct = {c: ncat + 1 if c in unsure and len(counts[c]) <= ncat else max(heavy[c].distinct, len(counts[c]))
                    for c in cols}
        kept = sum(share_reaches(k, n, tol) for c in cols for k in counts[c].values()) if n else 0
        if kept > MAX_KEPT_LABELS:
            raise ValueError(f"more than {MAX_KEPT_LABELS} labels would be kept: raise the rare-label tolerance")
        keep = [rare_keep(counts[c], n, distinct[c], tol, ncat) for c in cols]
        return RareLabelModel(encodeCols=cols, keep=keep, replaceWith=self.v("replaceWith"))


# --------------------------------------------------------------------------
# A11 one_hot
class OneHotModel(StageModel):
    encodeCols = param("encodeCols")
    categories = param("categories")
    dropOriginal = param("dropOriginal")
    _defaults = dict(encodeCols=[], categories=[], dropOriginal=True)

    def output_names(self) -> list[str]:
        return [one_hot_name(c, k) for c, cats in zip(self.v("encodeCols"), self.v("categories")) for k in cats]

    def apply(self, cols, types=None):
        enc = self.v("encodeCols")
        if not enc:
            return cols
        for c in enc:
            if c not in cols:
                raise ValueError(ONE_HOT_MISSING_MESSAGE.format(c=c))
        out = OrderedDict(cols)
        for c, cats in zip(enc, self.v("categories")):
            for k in cats:
                out[one_hot_name(c, k)] = F.when(cols[c] == F.lit(k), F.lit(1)).otherwise(F.lit(0))
        if self.v("dropOriginal"):
            for c in enc:
                out.pop(c, None)
        return out

    def apply_sql(self, cols, types=None):
        enc = self.v("encodeCols")
        if not enc:
            return cols
        for c in enc:
            if c not in cols:
                raise ValueError(ONE_HOT_MISSING_MESSAGE.format(c=c))
        out = OrderedDict(cols)
        for c, cats in zip(enc, self.v("categories")):
            for k in cats:
                out[one_hot_name(c, k)] = f"CASE WHEN {cols[c]} = {sql_lit(k)} THEN 1 ELSE 0 END"
        if self.v("dropOriginal"):
            for c in enc:
                out.pop(c, None)
        return out


def one_hot_k(distinct: int, max_categories: int) -> int:
    """Least frequent label is always left out; at most ``max_categories``."""
    return max(1, min(max_categories, distinct - 1))


class OneHotEncoder(StageEstimator):
    """Named 0/1 columns ``<col>_<label>`` for the top-k labels by count
    (ties: smaller label first); NULL and unseen labels give all zeros."""

    inputCols = param("inputCols")
    maxCategories = param("maxCategories")
    dropOriginal = param("dropOriginal")
    _defaults = dict(inputCols=[], maxCategories=10, dropOriginal=True)

    def _fit(self, df):
        cols = present(self.v("inputCols"), df.columns)
        if not cols:
            return OneHotModel(dropOriginal=self.v("dropOriginal"))
        kmax = int(self.v("maxCategories"))
        heavy = heavy_labels(df, cols, max(SLOTS, kmax + 1))
        tops = {c: heavy[c].top(one_hot_k(heavy[c].distinct, kmax)) for c in cols}
        unsure = [c for c in cols if tops[c] is None]
        if unsure:          # no clear top: every distinct label of these columns is counted
            freq = frequency_table(df, unsure).where(F.col("value").isNotNull())
            ranked: dict = {c: [] for c in unsure}
            for r in top_k_per_group(freq, ["col"], [F.desc("cnt"), F.asc("value")], kmax, salt_cols=["value"]).collect():
                ranked[r["col"]].append((r["rank"], r["value"]))
            tops |= {c: [v for _, v in sorted(labels)] for c, labels in ranked.items()}
        cats = [tops[c] for c in cols]
        return OneHotModel(encodeCols=cols, categories=cats, dropOriginal=self.v("dropOriginal"))


# --------------------------------------------------------------------------
# col_order
class ColumnOrderModel(StageModel):
    order = param("order")
    passthrough = param("passthrough")
    _defaults = dict(order=[], passthrough=[])

    def apply(self, cols, types=None):
        missing = [c for c in self.v("order") if c not in cols]
        if missing:
            raise KeyError(f"columns missing at transform: {missing}")
        out = OrderedDict((c, cols[c]) for c in self.v("passthrough") if c in cols)
        for c in self.v("order"):
            out[c] = cols[c]
        return out

    apply_sql = apply


class ColumnOrder(StageEstimator):
    """Fix the output to the column names seen at fit, sorted by code point."""

    passthrough = param("passthrough")
    _defaults = dict(passthrough=[])

    def _fit(self, df):
        keep = set(self.v("passthrough"))
        return ColumnOrderModel(order=sorted(c for c in df.columns if c not in keep),
                                passthrough=list(self.v("passthrough")))


__all__ = [
    "ColumnSelector", "TypeCaster", "ValueClipper", "DropAllNull", "DropAllNullModel",
    "MissingIndicator", "MissingIndicatorModel", "FillModel", "MeanMedianImputer",
    "StandardScaler", "StandardScalerModel", "TargetScaler", "MostFrequentImputer",
    "CategoricalImputer", "RareLabelEncoder", "RareLabelModel", "OneHotEncoder", "OneHotModel",
    "ColumnOrder", "ColumnOrderModel", "category_summary", "rare_keep", "collect_counts", "share_reaches", "one_hot_k",
    "fit_numeric_fill", "safe_std", "NULL_LABEL", "MISSING_TAG", "RARE_LABEL",
]
