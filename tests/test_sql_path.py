"""The SQL-text rendering of fitted stages gives exactly the Column-API results."""

import pytest
from pyspark.ml import PipelineModel

from conftest import SF_SMALL
from keelson.operators.stages import TypeCaster, ValueClipper
from keelson.plans import catalog as C
from keelson.plans.preprocess import PreprocessConfig, Preprocessor, fused_transform, fused_transform_columns


def rows(df):
    def norm(v):
        return "NaN" if isinstance(v, float) and v != v else v
    return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("nulls_as_label,method", [(True, "mean"), (False, "median")])
def test_sql_equals_columns_flagship(spark, nulls_as_label, method):
    df = C.events_frame(spark, SF_SMALL)
    fp = Preprocessor(C.events_spec(), PreprocessConfig(nulls_as_label=nulls_as_label, imputation_method=method)).fit(df)
    a, b = fused_transform(fp.pipeline, df), fused_transform_columns(fp.pipeline, df)
    assert a.columns == b.columns and a.schema == b.schema
    assert rows(a) == rows(b)


def test_sql_equals_columns_bundle_and_awkward_labels(spark):
    df, bundle = C._literal_bundle(spark, SF_SMALL)
    assert rows(fused_transform(bundle, df)) == rows(fused_transform_columns(bundle, df))
    odd = spark.createDataFrame([(1, "it's", 1.5, True, 1e7, "a\\\\b"), (2, "a.b `c`", None, False, -0.5, None),
                                 (3, "it's", float("nan"), None, 12345678.0, "x")],
                                "i int, s string, x double, b boolean, big double, t string")
    stages = [TypeCaster(inputCols=["s", "b", "big", "t"], castType="string", nullsAsLabel=True),
              TypeCaster(inputCols=["x"], castType="double"), ValueClipper(inputCols=["x"], lower=-1.0, upper=1.2)]
    pm = PipelineModel(stages)
    assert rows(fused_transform(pm, odd)) == rows(fused_transform_columns(pm, odd))
    from keelson.operators.stages import OneHotEncoder, RareLabelEncoder
    labels = PipelineModel([RareLabelEncoder(inputCols=["s"], tol=0.5, nCategories=1).fit(odd),
                            OneHotEncoder(inputCols=["s"], maxCategories=3).fit(odd)])
    assert rows(fused_transform(labels, odd)) == rows(fused_transform_columns(labels, odd))
