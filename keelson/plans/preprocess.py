"""The whole preprocessing pipeline (A15), fitted in a handful of jobs.

``ml.Pipeline.fit`` would fit the 16 steps one after the other, each with its
own pass over the data.  ``Preprocessor.fit`` instead makes a few scans:

  stage  the input's columns are written once as Parquet; every scan below reads
         only the columns it needs from there, so the input (CSV, a join, ...)
         is read and parsed once.  The fitted result hands that table on.
         Rows that are cheap to derive from a stored table need no copy, which can
         be many times as large as that table (``rederive``).
  1      a mergeable state per task: moments of every numeric column (the target
         too) and frequent-label counters of every categorical one.  Columns with
         more labels than counters get a second scan that counts the candidates
         exactly; the exact median, if asked for, adds histogram rounds.
  2      one state over the transformed rows: counts, extremes and signatures of all
         columns, and the products of all pairs of numeric ones (one-hot columns too,
         whose labels follow from 1).  Constant, duplicate and correlated columns and
         their variances all follow from it; duplicate candidates get an exact
         ``<=>`` scan.

The same jobs run at every width and size.
Mean imputation followed by scaling needs no second pass: with c non-null
values out of n, filled with m, the new mean and population variance follow
in closed form from (c, mean, std) of scan 1.  Rare-label and one-hot states
follow from its label counts on the driver.  The fitted result is an ordinary
``PipelineModel`` of the single-stage models, usable and savable as such;
``fused_transform`` applies it as one ``select``.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.exprs import NULL_LABEL, one_hot_name, qcol
from keelson.functions.heavy import add_labels, exact_counts, merge_labels, no_counters
from keelson.functions.profile import chunked_aggregate
from keelson.functions.quantile import exact_quantile
from keelson.functions.states import (
    as_array,
    column_facts_fold,
    correlations,
    fold,
    matrix,
    merge_moments,
    moments_of,
    no_moments,
    sample_variances,
)
from keelson.operators.base import (
    StageEstimator,
    apply_stages,
    apply_stages_sql_map,
    column_map,
    param,
    schema_types,
    select_map,
    select_sql,
    select_stages,
    sql_map,
)
from keelson.operators.selection import (
    ALL_CONSTANT_MESSAGE,
    MISSING_VALUES_MESSAGE,
    DropColumnsModel,
    constant_from_facts,
    correlated_groups,
    duplicate_groups,
    pick_by_variance,
    type_group,
)
from keelson.operators.stages import (
    MISSING_TAG,
    RARE_LABEL,
    ColumnOrderModel,
    ColumnSelector,
    DropAllNullModel,
    FillModel,
    MissingIndicatorModel,
    OneHotModel,
    RareLabelModel,
    StandardScalerModel,
    TypeCaster,
    ValueClipper,
    full_label_counts,
    label_slots,
    modes,
    one_hot_k,
    rare_keep,
    safe_std,
    share_reaches,
)
from keelson.session import staged
from keelson.spec import DatasetSpec


@dataclass
class PreprocessConfig:
    """Pipeline parameters.  Defaults: the reference's configuration, with its
    unread keys resolved as the reference behaves (rare label 'Rare', one-hot
    cap 10), and categorical nulls kept as the label 'nan'."""

    imputation_method: str = "mean"
    exact_median: bool = True
    clip_min: float | None = -4.0
    clip_max: float | None = 4.0
    mode_threshold: float = 0.1
    missing_method: str = "missing"
    missing_fill: str = MISSING_TAG
    rare_tol: float = 0.03
    rare_n_categories: int = 1
    rare_replace: str = RARE_LABEL
    one_hot_max: int = 10
    constant_tol: float = 1.0
    constant_missing: str = "include"
    corr_threshold: float = 0.98
    nulls_as_label: bool = True
    perc_inserted_nulls: float = 0.05
    extra: dict = field(default_factory=dict)

    @staticmethod
    def from_dict(d: dict) -> "PreprocessConfig":
        """Read the reference's preprocessing JSON layout."""
        num = d.get("numeric_transformers", {})
        cat = d.get("categorical_transformers", {})
        sel = d.get("feature_selection_preprocessing", {})
        c = PreprocessConfig()
        c.imputation_method = num.get("mean_median_imputer", {}).get("imputation_method", c.imputation_method)
        clip = num.get("outlier_clipper", {})
        c.clip_min, c.clip_max = clip.get("min_val", c.clip_min), clip.get("max_val", c.clip_max)
        c.mode_threshold = cat.get("cat_most_frequent_imputer", {}).get("threshold", c.mode_threshold)
        tag = cat.get("missing_tag_imputer", {})
        c.missing_method = tag.get("imputation_method", c.missing_method)
        c.missing_fill = tag.get("fill_value", c.missing_fill)
        rare = cat.get("rare_label_encoder", {})
        c.rare_tol, c.rare_n_categories = rare.get("tol", c.rare_tol), rare.get("n_categories", c.rare_n_categories)
        const = sel.get("constant_feature_dropper", {})
        c.constant_tol = const.get("tol", c.constant_tol)
        c.constant_missing = const.get("missing_values", c.constant_missing)
        c.corr_threshold = sel.get("correlated_feature_dropper", {}).get("threshold", c.corr_threshold)
        c.perc_inserted_nulls = d.get("perc_inserted_nulls", c.perc_inserted_nulls)
        return c


@dataclass
class FittedPreprocess:
    pipeline: PipelineModel
    target_scaler: StandardScalerModel | None
    feature_cols: list
    n_rows: int
    report: dict
    source: DataFrame | None = None      # what the scans read, the staged input if there is one: transform this


def fused_transform(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply every stage as one projection (built as SQL text when possible)."""
    return select_stages(df, pipeline.stages)


def fused_transform_columns(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    """The same through the Column API (reference path, used by tests)."""
    return select_map(df, apply_stages(pipeline.stages, column_map(df), schema_types(df)))


class Preprocessor:
    def __init__(self, spec: DatasetSpec, config: PreprocessConfig | None = None):
        self.spec = spec
        self.config = config or PreprocessConfig()

    # ------------------------------------------------------------------
    def fit(self, df: DataFrame, is_staged: bool = False, rederive: bool = False) -> FittedPreprocess:
        """One read of ``df``: its columns are staged as Parquet, which every job below reads
        (``is_staged``: ``df`` is a Parquet scan already).

        ``rederive``: nothing is written, every job derives the rows of ``df`` anew.  Only for deterministic
        expressions on the rows of a stored table.
        """
        if not isinstance(df, DataFrame):
            raise TypeError("train_data must be a Spark DataFrame")
        names = [c for c in dict.fromkeys([self.spec.id, self.spec.target, *self.spec.feature_names]) if c in df.columns]
        if is_staged:
            return self._fit(df)
        df = df.select(*[qcol(c) for c in names])
        return self._fit(df if rederive else staged(df, "fit-input"))

    def _fit(self, df: DataFrame) -> FittedPreprocess:
        spec, cfg = self.spec, self.config
        pass_cols = [c for c in (spec.id, spec.target) if c in df.columns]
        num = [c for c in spec.numeric_features if c in df.columns]
        cat = [c for c in spec.categorical_features if c in df.columns]
        types = schema_types(df)

        select = ColumnSelector(columns=spec.feature_names, passthrough=pass_cols)
        cast_num = TypeCaster(inputCols=spec.numeric_features, castType="double")
        raw_labels = TypeCaster(inputCols=spec.categorical_features, castType="string", nullsAsLabel=False)
        casted = select_sql(df, apply_stages_sql_map([select, cast_num, raw_labels], sql_map(df), types))

        # scan 1: moments (+ target) and label counts
        target_numeric = spec.target in df.columns and isinstance(types[spec.target], T.NumericType)
        prof_cols = num + ([spec.target] if target_numeric else [])
        n, prof, heavy = self._input_statistics(casted, prof_cols, cat)
        if not n:
            raise ValueError("train_data cannot be empty")
        cat_summary, cat_counts = self._label_counts(casted, heavy, n)

        # A1 drop all-null
        all_null = [c for c in num if prof[c]["count"] == 0] + \
                   [c for c in cat if cat_summary[c]["nulls"] == cat_summary[c]["n"]]
        drop_all_null = DropAllNullModel(inputCols=num + cat, dropCols=all_null)
        if num + cat and len(all_null) == len(num + cat):
            drop_all_null.apply(OrderedDict((c, None) for c in num + cat))  # raises the reference's error
        num = [c for c in num if c not in all_null]
        cat = [c for c in cat if c not in all_null]

        cast_cat = TypeCaster(inputCols=spec.categorical_features, castType="string",
                              nullsAsLabel=cfg.nulls_as_label)
        # A2 indicators, A3/A4 fill, A5 scaler (closed form), clip
        indicator = MissingIndicatorModel(indicatorCols=[c for c in num if prof[c]["count"] < n])
        fills = self._numeric_fills(casted, num, prof)
        imputer = FillModel(fillCols=num, fillValues=[fills[c] for c in num])
        means, stds = [], []
        for c in num:
            p, m = prof[c], fills[c]
            cnt, mu, sd = p["count"], p["mean"], p["std_pop"] or 0.0
            mean2 = (cnt * mu + (n - cnt) * m) / n
            var2 = (cnt * (sd * sd + (mu - mean2) ** 2) + (n - cnt) * (m - mean2) ** 2) / n
            means.append(mean2)
            stds.append(safe_std(math.sqrt(max(var2, 0.0))))
        scaler = StandardScalerModel(scaleCols=num, means=means, stds=stds)
        clipper = ValueClipper(inputCols=spec.numeric_features, lower=cfg.clip_min, upper=cfg.clip_max)

        # A6 mode, A7 tag, A8 rare: from the label counts
        mode_model, tag_model, rare_model, post_rare = self._categorical_models(cat, cat_summary, cat_counts, n)

        stages = [select, drop_all_null, cast_cat, cast_num, indicator, imputer, scaler, clipper,
                  mode_model, tag_model, rare_model]
        mid_cols = apply_stages_sql_map(stages, sql_map(df), types)   # SQL text: one parse per frame
        mid = select_sql(df, mid_cols)
        feat_cols = [c for c in mid.columns if c not in pass_cols]

        # one-hot labels of every categorical follow from the post-rare counts (driver)
        all_ohe = {}
        for c in cat:
            ranked = sorted(post_rare[c].items(), key=lambda kv: (-kv[1], kv[0]))
            all_ohe[c] = [v for v, _ in ranked[:one_hot_k(len(post_rare[c]), cfg.one_hot_max)]]
        # scan 2: facts of all transformed columns and products of the numeric ones, one-hot columns among them
        hot = [(one_hot_name(c, k), F.when(qcol(c) == F.lit(k), F.lit(1)).otherwise(F.lit(0))) for c in cat for k in all_ohe[c]]
        plain = [c for c in feat_cols if c not in cat]
        facts = column_facts_fold(mid, [qcol(c) for c in plain] + [e for _, e in hot], [qcol(c) for c in cat],
                                  qcol(spec.id) if spec.id in mid.columns else None)
        place = {name: i for i, name in enumerate([*plain, *[name for name, _ in hot]])}
        drop_const, dup_groups = self._selection_from_facts(mid, feat_cols, self._facts_by_column(mid, facts, plain, cat, post_rare))
        const_model = DropColumnsModel(dropCols=drop_const)
        dup_model = DropColumnsModel(dropCols=[c for g in dup_groups for c in g[1:]], groups=dup_groups)
        remaining = [c for c in feat_cols if c not in set(const_model.v("dropCols")) | set(dup_model.v("dropCols"))]

        # A11 one-hot of the remaining categoricals
        ohe_cols = [c for c in cat if c in remaining]
        ohe_cats = [all_ohe[c] for c in ohe_cols]
        ohe = OneHotModel(encodeCols=ohe_cols, categories=ohe_cats, dropOriginal=True)

        # A12: correlation among numeric outputs after one-hot
        stages += [const_model, dup_model, ohe]
        after_cols = apply_stages_sql_map([const_model, dup_model, ohe], mid_cols, types)  # reuse the built map
        numeric_out = [c for c in after_cols if c not in pass_cols and c not in cat]
        corr_groups, corr_drop = [], []
        if len(numeric_out) >= 2:
            at = [place[c] for c in numeric_out]
            corr_groups = correlated_groups(numeric_out, correlations(facts)[np.ix_(at, at)].tolist(), cfg.corr_threshold)
            # rounded: equal up to the order of summation is a tie
            spread_of = {c: float(f"{v:.10g}") for c, v in zip(numeric_out, sample_variances(facts)[at], strict=True)}
            corr_drop = pick_by_variance(mid, corr_groups, spread_of)
        corr_model = DropColumnsModel(dropCols=corr_drop, groups=corr_groups)
        final_feats = sorted(c for c in after_cols if c not in pass_cols and c not in set(corr_drop))
        order = ColumnOrderModel(order=final_feats, passthrough=pass_cols)
        stages += [corr_model, order]

        target_scaler = None
        if spec.target in prof:
            t = prof[spec.target]
            target_scaler = StandardScalerModel(scaleCols=[spec.target], means=[t["mean"]],
                                                stds=[safe_std(t["std_pop"])])
        report = dict(all_null=all_null, indicators=indicator.v("indicatorCols"), constant=drop_const,
                      duplicate_groups=dup_groups, correlated_groups=corr_groups, correlated_dropped=corr_drop,
                      one_hot={c: k for c, k in zip(ohe_cols, ohe_cats)})
        return FittedPreprocess(PipelineModel(stages), target_scaler, final_feats, n, report, df)

    # ------------------------------------------------------------------
    def _numeric_fills(self, casted, num, prof) -> dict:
        method = self.config.imputation_method
        if method == "mean":
            return {c: prof[c]["mean"] for c in num}
        if method != "median":
            raise ValueError(f"unknown imputation method {method}")
        if self.config.exact_median:
            return exact_quantile(casted, num, 0.5, profile=prof)
        r = chunked_aggregate(casted, [(f"m{i}", F.percentile_approx(qcol(c), 0.5, 100000), 8) for i, c in enumerate(num)])
        return {c: r[f"m{i}"] for i, c in enumerate(num)}

    def _input_statistics(self, casted: DataFrame, numeric: list[str], cat: list[str]):
        """(rows, per numeric column count / mean / std_pop / extremes, per categorical column its frequent labels)."""
        width, slots = len(numeric), label_slots(self.config.rare_tol, self.config.rare_n_categories)

        def step(state, b):
            rows, moments, labels = state
            if width:
                moments = merge_moments(moments, moments_of(matrix(b.column(0), width)))
            return rows + b.num_rows, moments, add_labels(labels, b.columns[1:], slots)

        rows, m, labels = fold(
            casted.select(as_array([qcol(c) for c in numeric]).alias("x"), *[qcol(c).alias(f"c{i}") for i, c in enumerate(cat)]),
            lambda: (0, no_moments(width), no_counters(len(cat))), step,
            lambda a, b: (a[0] + b[0], merge_moments(a[1], b[1]), merge_labels(a[2], b[2], slots)))
        prof = {}
        for i, c in enumerate(numeric):
            count = int(m[0, i])
            prof[c] = dict(n=rows, count=count, mean=float(m[1, i]) if count else None,
                           std_pop=math.sqrt(max(m[2, i], 0.0) / count) if count else None,
                           min=float(m[3, i]) if count else None, max=float(m[4, i]) if count else None)
        cfg = self.config
        heavy = exact_counts(casted.select(*[qcol(c).alias(f"c{i}") for i, c in enumerate(cat)]), cat, labels, slots,
                             also=[NULL_LABEL, cfg.missing_fill, cfg.rare_replace])
        return rows, prof, heavy

    def _label_counts(self, casted: DataFrame, heavy: dict, n: int):
        """Per-column summary and the exact counts of the labels that can matter."""
        cfg = self.config
        counts = {c: dict(h.counts) for c, h in heavy.items()}
        # a tolerance too small for the counters, or a mode that does not stand out, needs the full table
        unsure = [c for c, h in heavy.items() if not h.complete and share_reaches(h.bound, n, cfg.rare_tol)]
        if unsure:
            full = full_label_counts(casted, unsure, n, cfg.rare_tol, cfg.rare_n_categories)
            for c in unsure:
                counts[c] |= full[c]
        top = modes(casted, heavy)
        for c in heavy:
            if top[c] is not None and top[c] not in counts[c]:
                counts[c][top[c]] = casted.where(qcol(c) == F.lit(top[c])).count()
        summary = {c: dict(n=h.n, nulls=h.nulls, distinct=max(h.distinct, len(counts[c])), mode=top[c])
                   for c, h in heavy.items()}
        return summary, counts

    def _categorical_models(self, cat, summary, counts, n):
        """Derive A6/A7/A8 states and the post-rare label counts of each column."""
        cfg = self.config
        mode_c, mode_v, tag_c, tag_v, rare_c, rare_keep_l = [], [], [], [], [], []
        post = {}
        for c in cat:
            s = summary[c]
            cnt = dict(counts[c])
            distinct = s["distinct"]
            z = s["nulls"]
            if cfg.nulls_as_label and z:
                if cnt.get(NULL_LABEL, 0) == 0:
                    distinct += 1
                cnt[NULL_LABEL] = cnt.get(NULL_LABEL, 0) + z
                z = 0
            # A6: fitted when the null share is below the threshold
            if z / n < cfg.mode_threshold:
                top = min(cnt.items(), key=lambda kv: (-kv[1], kv[0])) if cnt else None
                if top is not None:
                    mode_c.append(c)
                    mode_v.append(top[0])
                    if z:
                        cnt[top[0]] += z
                        z = 0
            # A7: remaining nulls -> tag (or the mode for method 'frequent')
            fill = cfg.missing_fill
            if cfg.missing_method == "frequent":
                fill = min(cnt.items(), key=lambda kv: (-kv[1], kv[0]))[0] if cnt else cfg.missing_fill
            tag_c.append(c)
            tag_v.append(fill)
            if z:
                if cnt.get(fill, 0) == 0:
                    distinct += 1
                cnt[fill] = cnt.get(fill, 0) + z
            # A8
            keep = rare_keep(cnt, n, distinct, cfg.rare_tol, cfg.rare_n_categories)
            rare_c.append(c)
            rare_keep_l.append(keep)
            kept_total = sum(cnt[v] for v in keep)
            after = {v: cnt[v] for v in keep}
            if kept_total < n:
                after[cfg.rare_replace] = after.get(cfg.rare_replace, 0) + (n - kept_total)
            post[c] = after
        return (FillModel(fillCols=mode_c, fillValues=mode_v), FillModel(fillCols=tag_c, fillValues=tag_v),
                RareLabelModel(encodeCols=rare_c, keep=rare_keep_l, replaceWith=cfg.rare_replace), post)

    @staticmethod
    def _facts_by_column(mid: DataFrame, facts: dict, plain: list[str], cat: list[str], labels: dict) -> dict:
        """The folded facts in the form of ``column_facts``."""
        types, out = schema_types(mid), {}
        for i, c in enumerate(plain):
            out[c] = dict(n=facts["n"], nn=int(facts["counts"][i]), min=facts["low"][i], max=facts["high"][i],
                          fp=tuple(facts["marks"][:, i]), group=type_group(types[c]), type=types[c].simpleString())
        for i, c in enumerate(cat):
            # one hash may be two labels; one label may not
            high = facts["label_high"][i] if len(labels[c]) == 1 else None
            out[c] = dict(n=facts["n"], nn=int(facts["label_counts"][i]), min=facts["label_low"][i], max=high,
                          fp=(*facts["label_marks"][:, i], facts["label_high"][i]), group="s", type="string")
        return out

    def _selection_from_facts(self, mid: DataFrame, cols: list[str], facts: dict):
        cfg = self.config
        if not cols:
            return [], []
        if cfg.constant_tol >= 1:
            drop_const = [c for c in cols if constant_from_facts(facts[c], cfg.constant_missing)]
        else:
            from keelson.operators.selection import DropConstant
            drop_const = DropConstant(inputCols=cols, tol=cfg.constant_tol,
                                      missingValues=cfg.constant_missing).fit(mid).v("dropCols")
        if len(drop_const) == len(cols):
            raise ValueError(ALL_CONSTANT_MESSAGE)
        rest = [c for c in cols if c not in drop_const]
        nulls = [c for c in rest if facts[c]["nn"] < facts[c]["n"]]
        if nulls:
            raise ValueError(f"{MISSING_VALUES_MESSAGE}: {nulls}")
        return drop_const, duplicate_groups(mid, rest, facts)


class PreprocessEstimator(StageEstimator):
    """The fused fit as a ``pyspark.ml`` Estimator (usable inside ``ml.Pipeline``):
    ``spec`` and ``config`` are JSON-able dicts; ``fit`` returns the fitted
    ``PipelineModel`` of column stages (features only; the target scaler is
    available from ``Preprocessor`` directly)."""

    spec = param("spec", "dataset description (reference JSON layout)")
    config = param("config", "preprocessing config (reference JSON layout)")
    _defaults = dict(config={})

    def _fit(self, df: DataFrame) -> PipelineModel:
        spec = DatasetSpec.from_dict(self.v("spec"), id_type=schema_types(df).get(self.v("spec")["id"]["name"]))
        cfg = PreprocessConfig.from_dict(self.v("config")) if self.v("config") else PreprocessConfig()
        return Preprocessor(spec, cfg).fit(df).pipeline
