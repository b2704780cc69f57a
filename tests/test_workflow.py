"""End to end in the reference's terms: CSV directory + JSON spec -> artifacts -> predictions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from keelson.operators.validate import ValidationError
from keelson.plans import catalog as C
from keelson.plans.workflow import run_batch_predictions, run_training

SPEC = {
    "title": "events", "modelCategory": "regression", "schemaVersion": 1.0, "inputDataFormat": "CSV",
    "id": {"name": "event_id", "description": "id"},
    "target": {"name": "target", "description": "a target", "example": 1.0},
    "features": [
        {"name": "value", "dataType": "NUMERIC", "example": 1.0, "nullable": True},
        {"name": "k", "dataType": "NUMERIC", "example": 1.0, "nullable": False},
        {"name": "event_type", "dataType": "CATEGORICAL", "categories": C.EVENT_TYPES, "nullable": True},
    ],
}


def _write(spark, tmp_dir):
    spec_path = os.path.join(tmp_dir, "schema.json")
    with open(spec_path, "w") as fh:
        json.dump(SPEC, fh)
    df = C.events_frame(spark, SF_SMALL).select("event_id", "value", "k", "event_type", "target")
    df.write.option("header", True).csv(os.path.join(tmp_dir, "train"))
    df.drop("target").write.option("header", True).csv(os.path.join(tmp_dir, "test"))
    return spec_path


def test_train_then_score(spark, tmp_dir):
    spec_path = _write(spark, tmp_dir)
    res = run_training(spark, os.path.join(tmp_dir, "train"), spec_path, os.path.join(tmp_dir, "artifacts"))
    # 10% of the rows carry a +400 outlier, which a robust fit ignores: overall R^2 stays
    # low, while on the clean validation rows the fit is near perfect
    from keelson.operators.model import r2_score
    assert res.r2_validation is not None and 0.1 < res.r2_validation < 0.4
    clean = res.model.transform(res.validation).where("event_id % 10 != 0")
    assert r2_score(clean, "target") > 0.95
    preds = run_batch_predictions(spark, os.path.join(tmp_dir, "test"), spec_path, os.path.join(tmp_dir, "artifacts"),
                                  os.path.join(tmp_dir, "out"))
    out = spark.read.option("header", True).csv(os.path.join(tmp_dir, "out"))
    assert out.count() == preds.count() == 1000 and out.columns == ["event_id", "prediction"]
    # 4 decimals in the file
    assert out.where(F.length(F.split("prediction", r"\.")[1]) != 4).count() == 0


def test_training_rejects_non_numeric_text(spark, tmp_dir):
    spec_path = _write(spark, tmp_dir)
    bad = C.events_frame(spark, SF_SMALL).select(
        "event_id", F.when(F.col("event_id") == 5, F.lit("oops")).otherwise(F.col("value").cast("string")).alias("value"),
        "k", "event_type", "target")
    bad.write.option("header", True).csv(os.path.join(tmp_dir, "bad"))
    with pytest.raises(ValidationError, match="Numeric feature 'value' contains non-numeric data"):
        run_training(spark, os.path.join(tmp_dir, "bad"), spec_path, os.path.join(tmp_dir, "a2"))


def test_missing_directory(spark, tmp_dir):
    spec_path = _write(spark, tmp_dir)
    with pytest.raises(FileNotFoundError):
        run_training(spark, os.path.join(tmp_dir, "nope"), spec_path, os.path.join(tmp_dir, "a3"))


def test_train_exact_split_size(spark):
    from keelson.plans.workflow import train
    res = train(C.events_frame(spark, SF_SMALL), C.events_spec(), val_pct=0.1, exact_split=True, max_iter=20)
    assert res.validation.count() == 100 and res.train.count() == 900


def test_reference_layout_configs_and_tuning(spark, tmp_dir):
    """Config files in the reference's layout: preprocessing, default hyperparameters and a
    search space typed 'float' (accepted as 'real'); the trials land next to the artifacts."""
    from keelson.plans.preprocess import PreprocessConfig
    spec_path = _write(spark, tmp_dir)
    pre = {"numeric_transformers": {"mean_median_imputer": {"imputation_method": "median"},
                                    "outlier_clipper": {"min_val": -3.0, "max_val": 3.0}},
           "categorical_transformers": {"cat_most_frequent_imputer": {"threshold": 0.2},
                                        "missing_tag_imputer": {"imputation_method": "missing", "fill_value": "missing"},
                                        "rare_label_encoder": {"tol": 0.05, "n_categories": 1}},
           "feature_selection_preprocessing": {"constant_feature_dropper": {"tol": 1, "missing_values": "include"},
                                               "correlated_feature_dropper": {"threshold": 0.95}},
           "perc_inserted_nulls": 0.1}
    cfg = PreprocessConfig.from_dict(pre)
    assert (cfg.imputation_method, cfg.clip_min, cfg.clip_max, cfg.mode_threshold, cfg.rare_tol,
            cfg.corr_threshold, cfg.perc_inserted_nulls) == ("median", -3.0, 3.0, 0.2, 0.05, 0.95, 0.1)
    hpt = {"num_trials": 3, "hyperparameters": [
        {"name": "alpha", "type": "float", "search_type": "log-uniform", "range_low": 1e-6, "range_high": 1.0},
        {"name": "epsilon", "type": "float", "search_type": "uniform", "range_low": 1.0, "range_high": 2.0}]}
    paths = {}
    for name, doc in (("pre", pre), ("hp", {"alpha": 0.0001, "epsilon": 1.35}), ("hpt", hpt)):
        paths[name] = os.path.join(tmp_dir, f"{name}.json")
        with open(paths[name], "w") as fh:
            json.dump(doc, fh)
    art = os.path.join(tmp_dir, "artifacts_t")
    res = run_training(spark, os.path.join(tmp_dir, "train"), spec_path, art, run_tuning=True,
                       preprocessing_config_path=paths["pre"], hyperparameters_path=paths["hp"],
                       hpt_path=paths["hpt"])
    assert res.tuning is not None and res.tuning.trials.count() == 3
    trials = spark.read.option("header", True).csv(art + "_hpt_results")
    assert trials.count() == 3 and "params_alpha" in trials.columns


def test_single_csv_rule(spark, tmp_dir):
    from keelson.sources.files import src_csv
    from keelson.spec import DatasetSpec as DS
    spec = DS.from_dict(SPEC)
    one, two, none = (os.path.join(tmp_dir, d) for d in ("one", "two", "none"))
    for d in (one, two, none):
        os.makedirs(d)
    header = "event_id,value,k,event_type,target\n"
    with open(os.path.join(one, "data.csv"), "w") as fh:
        fh.write(header + "1,2.5,3,click,4.0\n2,,5,,6.0\n")
    for name in ("a.csv", "b.csv"):
        with open(os.path.join(two, name), "w") as fh:
            fh.write(header + "1,2.5,3,click,4.0\n")
    with open(os.path.join(none, "notes.txt"), "w") as fh:
        fh.write("x\n")
    df = src_csv(spark, one, spec, single_file=True)
    assert sorted((r.event_id, r.value, r.event_type) for r in df.collect()) == [("1", 2.5, "click"), ("2", None, None)]
    with pytest.raises(ValueError, match="Multiple CSV files"):
        src_csv(spark, two, spec, single_file=True)
    with pytest.raises(ValueError, match="No CSV file"):
        src_csv(spark, none, spec, single_file=True)
    assert src_csv(spark, two, spec).count() == 2  # Spark's usual multi-file directory
