"""Properties of the whole pipeline, null injection and splits."""

import pytest
from pyspark.sql import functions as F

from keelson.operators.sample import inject_nulls, split_train_val
from keelson.plans.preprocess import PreprocessConfig, Preprocessor, fused_transform
from keelson.spec import DatasetSpec, Feature

SPEC = DatasetSpec("id", "yield_t", (
    Feature("rain", "NUMERIC", True, example=50),
    Feature("sun", "NUMERIC", False, example=0.5),
    Feature("crop", "CATEGORICAL", True, ("rye", "oats", "flax")),
    Feature("slope", "CATEGORICAL", False, ("N", "E", "S", "W", "flat"))))
SCHEMA = "id int, rain double, sun double, crop string, slope string, yield_t double"


def farm(n: int, rain=lambda i: 7.0 * (i % 13), crop=lambda i: ("rye", "oats", "flax")[i % 3]):
    """n rows with the given rain and crop; the other columns vary by rule."""
    return [(i, rain(i), ((i * 5) % 17) / 4, crop(i), "NESW"[(i // 2) % 4], float(i % 23)) for i in range(n)]


def fit_transform(df, cfg=None):
    fp = Preprocessor(SPEC, cfg or PreprocessConfig()).fit(df)
    return fp, fused_transform(fp.pipeline, df)


def test_missing_values_filled(spark):
    df = spark.createDataFrame(farm(40, rain=lambda i: None if i % 4 == 1 else float(i),
                                    crop=lambda i: None if i % 5 == 2 else "rye" if i % 2 else "oats"), SCHEMA)
    for nulls_as_label in (True, False):
        fp, out = fit_transform(df, PreprocessConfig(nulls_as_label=nulls_as_label))
        assert out.count() == 40 and "rain_na" in fp.report["indicators"] or fp.report["indicators"] == ["rain"]
        assert out.where(" OR ".join(f"`{c}` IS NULL" for c in fp.feature_cols)).count() == 0


def test_outliers_clipped(spark):
    """One value far out; after scaling nothing passes the bounds and the far value sits on one."""
    df = spark.createDataFrame(farm(30, rain=lambda i: 9000.0 if i == 11 else float(i % 6)), SCHEMA)
    for bound in (0.5, 2.5):
        _, out = fit_transform(df, PreprocessConfig(clip_min=-bound, clip_max=bound))
        low, high = out.agg(F.min("rain"), F.max("rain")).first()
        assert -bound <= low < high == bound


def test_rare_labels_grouped(spark):
    """30 rows: rye 24, oats 3, flax 3; at 0.15 both small ones go into the common label."""
    df = spark.createDataFrame(farm(30, crop=lambda i: "oats" if i % 10 == 3 else "flax" if i % 10 == 7 else "rye"), SCHEMA)
    fp, out = fit_transform(df, PreprocessConfig(rare_tol=0.15))
    assert [c for c in fp.feature_cols if c.startswith("crop_")] == ["crop_rye"]
    assert out.agg(F.sum("crop_rye")).first()[0] == 24


@pytest.mark.parametrize("labels", [2, 60])
def test_label_at_the_tolerance_is_kept_in_narrow_and_wide_columns(spark, labels):
    """7 of 100 rows at 0.07."""
    rows = [(i, float(i % 9), float(i % 7), "edge" if i < 7 else f"o{i % (labels - 1)}", "N", 1.0 * i) for i in range(100)]
    fp, _ = fit_transform(spark.createDataFrame(rows, SCHEMA), PreprocessConfig(rare_tol=0.07))
    assert "edge" in fp.pipeline.stages[10].v("keep")[0]


def test_numeric_only_and_categorical_only(spark):
    df = spark.createDataFrame(farm(26), SCHEMA)
    for kept in (["rain", "sun"], ["crop", "slope"]):
        fp, out = fit_transform(df.select("id", *kept, "yield_t"))
        assert out.count() == 26 and fp.feature_cols
        assert all(c.split("_")[0] in kept for c in fp.feature_cols)


def test_all_null_column_dropped_and_all_null_error(spark):
    df = spark.createDataFrame([(i, None, float(i), None, "P" if i % 2 else "Q", 1.0) for i in range(6)], SCHEMA)
    fp, out = fit_transform(df)
    assert "rain" not in out.columns and not any(c.startswith("crop") for c in out.columns)
    allnull = spark.createDataFrame([(i, None, None, None, None, 1.0) for i in range(4)], SCHEMA)
    with pytest.raises(ValueError, match="All features in the input dataframe are NaN"):
        fit_transform(allnull)


def test_empty_and_not_a_table(spark):
    with pytest.raises(ValueError):
        fit_transform(spark.createDataFrame([], SCHEMA))
    with pytest.raises(TypeError):
        Preprocessor(SPEC).fit([1, 2, 3])


def test_string_target_is_tolerated(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), "A", "X", "A") for i in range(5)],
                               SCHEMA.replace("yield_t double", "yield_t string"))
    fp, out = fit_transform(df)
    assert fp.target_scaler is None and out.count() == 5


def test_inject_nulls_only_nullable_without_nulls(spark):
    df = spark.createDataFrame([(i, float(i), float(i), "A", "P", 1.0) for i in range(5)], SCHEMA)
    out = inject_nulls(df, "id", SPEC.nullable_features, p=0.05, seed=123)
    nulls = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    assert nulls["rain"] >= 1 and nulls["crop"] >= 1
    assert nulls["sun"] == 0 and nulls["slope"] == 0
    with_nulls = spark.createDataFrame([(1, None, 1.0, None, "P", 1.0), (2, 2.0, 2.0, "A", "P", 1.0)], SCHEMA)
    same = inject_nulls(with_nulls, "id", SPEC.nullable_features)
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, with_nulls.collect()), key=str)


def test_split_exact_size_and_reproducible(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS a", "id * 3 AS b", "id % 7 AS c")
    tr, va = split_train_val(df, "id", 0.2, exact_size=True)
    assert tr.count() == 80 and va.count() == 20 and tr.columns == df.columns
    assert tr.join(va, "id").count() == 0
    tr2, va2 = split_train_val(df.repartition(7), "id", 0.2, exact_size=True)
    assert sorted(r.id for r in va.collect()) == sorted(r.id for r in va2.collect())
    tr3, va3 = split_train_val(df, "id", 0.2)
    assert tr3.count() + va3.count() == 100


def test_bundle_round_trip_and_plain_pipeline_fallback(spark, tmp_dir):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import Binarizer
    from conftest import SF_SMALL
    from keelson.plans import catalog as C
    from keelson.plans.workflow import BundleModel, load_bundle, save_bundle
    df, bundle = C._literal_bundle(spark, SF_SMALL)
    save_bundle(bundle, tmp_dir + "/b")
    again = load_bundle(tmp_dir + "/b")
    a = fused_transform(bundle, df).select("event_id", "prediction").collect()
    b = fused_transform(again, df).select("event_id", "prediction").collect()
    assert sorted(a) == sorted(b) and len(again.stages) == len(bundle.stages)
    # a pipeline with a non-keelson stage is saved in the plain PipelineModel layout
    plain = PipelineModel([Binarizer(inputCol="k", outputCol="kb", threshold=10.0)])
    save_bundle(plain, tmp_dir + "/p")
    assert isinstance(load_bundle(tmp_dir + "/p").stages[0], Binarizer)
    with pytest.raises(ValueError):
        BundleModel(stageSpecs=[["os.path.join", {}]]).stage_list()


def test_labels_with_dots_spaces_backticks(spark, tmp_dir):
    from keelson.operators.model import huber_fit
    from keelson.plans.workflow import load_bundle, save_bundle
    labels = ["a.b c", "x`y", "a.b c", "x`y", "plain"]  # 'plain' is the least frequent: left out
    rows = [(i, float(i % 17), float((i * 7) % 11), labels[i % 5], "P" if i % 2 else "Q", float(i % 17) * 2 + (i % 3))
            for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    fp = Preprocessor(SPEC).fit(df)
    assert any("a.b c" in c for c in fp.feature_cols) and any("x`y" in c for c in fp.feature_cols)
    out = fused_transform(fp.pipeline, df)
    m = huber_fit(out, fp.feature_cols, "yield_t")
    assert len(m.v("coefficients")) == len(fp.feature_cols)
    save_bundle(fp.pipeline, tmp_dir + "/b")
    again = fused_transform(load_bundle(tmp_dir + "/b"), df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_preprocess_estimator_in_ml_pipeline(spark, tmp_dir):
    from pyspark.ml import Pipeline, PipelineModel
    from conftest import SF_SMALL
    from keelson.plans import catalog as C
    from keelson.plans.preprocess import PreprocessEstimator
    spec_dict = {"modelCategory": "regression", "schemaVersion": 1.0, "id": {"name": "event_id"},
                 "target": {"name": "target", "example": 1.0},
                 "features": [{"name": "value", "dataType": "NUMERIC", "example": 1.0, "nullable": True},
                              {"name": "k", "dataType": "NUMERIC", "example": 1.0, "nullable": False},
                              {"name": "event_type", "dataType": "CATEGORICAL", "categories": C.EVENT_TYPES,
                               "nullable": True}]}
    df = C.events_frame(spark, SF_SMALL)
    model = Pipeline(stages=[PreprocessEstimator(spec=spec_dict)]).fit(df)
    out = model.transform(df)
    assert "event_type_click" in out.columns or "event_type_view" in out.columns
    model.write().overwrite().save(tmp_dir + "/pm")
    again = PipelineModel.load(tmp_dir + "/pm").transform(df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
