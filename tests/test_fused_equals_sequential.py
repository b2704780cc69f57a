"""The fused fit equals fitting the stages one after another (ml.Pipeline)."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from conftest import SF_SMALL
from keelson.operators.selection import DropConstant, DropCorrelated, DropDuplicate
from keelson.operators.stages import (
    CategoricalImputer, ColumnOrder, ColumnSelector, DropAllNull, MeanMedianImputer, MissingIndicator,
    MostFrequentImputer, OneHotEncoder, RareLabelEncoder, StandardScaler, TypeCaster, ValueClipper,
)
from keelson.plans import catalog as C
from keelson.plans.preprocess import PreprocessConfig, Preprocessor, fused_transform


def sequential(spec, cfg):
    num, cat = spec.numeric_features, spec.categorical_features
    keep = [spec.id]
    return Pipeline(stages=[
        ColumnSelector(columns=spec.feature_names, passthrough=keep),
        DropAllNull(inputCols=num + cat),
        TypeCaster(inputCols=cat, castType="string", nullsAsLabel=cfg.nulls_as_label),
        TypeCaster(inputCols=num, castType="double"),
        MissingIndicator(inputCols=num),
        MeanMedianImputer(inputCols=num, method=cfg.imputation_method),
        StandardScaler(inputCols=num),
        ValueClipper(inputCols=num, lower=cfg.clip_min, upper=cfg.clip_max),
        MostFrequentImputer(inputCols=cat, threshold=cfg.mode_threshold),
        CategoricalImputer(inputCols=cat, fillValue=cfg.missing_fill),
        RareLabelEncoder(inputCols=cat, tol=cfg.rare_tol, nCategories=cfg.rare_n_categories),
        DropConstant(excludeCols=keep, tol=cfg.constant_tol, missingValues=cfg.constant_missing),
        DropDuplicate(excludeCols=keep, idCol=spec.id),
        OneHotEncoder(inputCols=cat, maxCategories=cfg.one_hot_max),
        DropCorrelated(excludeCols=keep, threshold=cfg.corr_threshold),
        ColumnOrder(passthrough=keep),
    ])


def frame(spark):
    df = C.events_frame(spark, SF_SMALL).drop("target")
    eid = F.col("event_id")
    # more categorical situations: a mostly-null label column, a rare label, a label that ties
    return df.select("*",
                     F.when(eid % 3 == 0, F.lit(None)).when(eid % 5 == 0, F.lit("u")).otherwise(F.lit("w")).alias("sparse"),
                     F.when(eid % 40 == 0, F.lit("r")).when(eid % 2 == 0, F.lit("t1")).otherwise(F.lit("t2")).alias("ties"))


def spec_with_extras():
    from keelson.spec import DatasetSpec, Feature
    s = C.events_spec()
    return DatasetSpec(s.id, s.target, s.features + (Feature("sparse", "CATEGORICAL", True, ("u", "w")),
                                                     Feature("ties", "CATEGORICAL", False, ("r", "t1", "t2"))),
                       id_type=s.id_type)


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("nulls_as_label,method", [(True, "mean"), (False, "mean"), (False, "median")])
def test_fused_fit_equals_stage_by_stage_fit(spark, nulls_as_label, method):
    df, spec = frame(spark), spec_with_extras()
    cfg = PreprocessConfig(nulls_as_label=nulls_as_label, imputation_method=method)
    fused = fused_transform(Preprocessor(spec, cfg).fit(df).pipeline, df)
    seq = sequential(spec, cfg).fit(df).transform(df)
    assert fused.columns == seq.columns
    assert rows(fused) == rows(seq)
