"""User-level jobs: ``train`` and ``score_batch``.

train:  validate -> split (hash of ID) -> inject nulls (train only) -> fused
        preprocessing fit -> (tune) -> Huber fit -> validation R^2 -> save
score:  load -> one projection (preprocess + predict + unscale) whose write counts
        the violated rules -> IDs checked on the written table -> output
Scoring has no shuffle at all unless the unique-ID rule is on.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.exprs import is_not_number, qcol
from keelson.functions.sqltext import lit as sql_lit
from keelson.operators.base import StageModel, param, schema_types
from keelson.operators.model import (
    DEFAULT_ALPHA,
    DEFAULT_EPSILON,
    HuberPredictorModel,
    huber_fit,
    r2_score,
    training_vectors,
)
from keelson.operators.sample import inject_nulls, split_train_val
from keelson.operators.tune import TuneResult, tune
from keelson.operators.validate import (
    ValidationError,
    check_columns,
    raise_first,
    repeated_ids,
    rule_aggregates,
    validate,
)
from keelson.plans.preprocess import FittedPreprocess, PreprocessConfig, Preprocessor, fused_transform
from keelson.session import scratch_dir, staged
from keelson.sources.files import sink_csv
from keelson.spec import DatasetSpec

PREDICTION = "prediction"


class TargetUnscaleModel(StageModel):
    """A14: prediction * std + mean (inverse of the target scaler)."""

    col = param("col")
    mean = param("mean")
    std = param("std")
    _defaults = dict(col=PREDICTION, mean=0.0, std=1.0)

    def apply(self, cols, types=None):
        out = OrderedDict(cols)
        c = self.v("col")
        if c in cols:
            out[c] = cols[c] * float(self.v("std")) + float(self.v("mean"))
        return out

    def apply_sql(self, cols, types=None):
        out = OrderedDict(cols)
        c = self.v("col")
        if c in cols:
            out[c] = f"(({cols[c]} * {sql_lit(float(self.v('std')))}) + {sql_lit(float(self.v('mean')))})"
        return out


@dataclass
class TrainResult:
    bundle: PipelineModel
    preprocess: FittedPreprocess
    model: HuberPredictorModel
    r2_validation: float | None
    tuning: TuneResult | None
    train: DataFrame
    validation: DataFrame


def scaled(fp: FittedPreprocess, df: DataFrame) -> DataFrame:
    """Transformed features plus the scaled target (when present), one select."""
    stages = list(fp.pipeline.stages) + ([fp.target_scaler] if fp.target_scaler is not None else [])
    return fused_transform(PipelineModel(stages), df)


def check_target(df: DataFrame, spec: DatasetSpec) -> None:
    """The target must be numeric: its type, or every non-null text in it."""
    kind = schema_types(df)[spec.target]
    if isinstance(kind, T.NumericType):
        return
    if not isinstance(kind, T.StringType) or not df.where(is_not_number(qcol(spec.target))).isEmpty():
        raise ValidationError(f"target field '{spec.target}' holds values that are not numbers")


def train(df: DataFrame, spec: DatasetSpec, config: PreprocessConfig | None = None, val_pct: float = 0.1,
          split_seed: int = 42, null_seed: int = 123, hyperparameters: dict | None = None,
          run_tuning: bool = False, tune_kwargs: dict | None = None, artifacts_dir: str | None = None,
          validate_data: bool = True, max_iter: int = 100, exact_split: bool = False,
          prediction_field: str = PREDICTION) -> TrainResult:
    """``exact_split=True`` makes the validation split exactly ceil(n * val_pct) rows
    (the reference's size; a few extra aggregate passes over the IDs)."""
    cfg = config or PreprocessConfig()
    names = [c for c in dict.fromkeys([spec.id, spec.target, *spec.feature_names]) if c in df.columns]
    df = staged(df.select(*[qcol(c) for c in names]), "train-input")        # the one read of the input
    if validate_data:
        validate(df, spec, is_train=True)
    check_target(df, spec)
    tr_raw, va_raw = split_train_val(df, spec.id, val_pct, split_seed, exact_size=exact_split)
    tr_raw = staged(inject_nulls(tr_raw, spec.id, spec.nullable_features, cfg.perc_inserted_nulls, null_seed),
                    "train-rows")
    fp = Preprocessor(spec, cfg).fit(tr_raw, is_staged=True)
    tr, va = scaled(fp, tr_raw), scaled(fp, va_raw)
    hp = dict(alpha=DEFAULT_ALPHA, epsilon=DEFAULT_EPSILON)
    hp.update(hyperparameters or {})
    tuning = None
    vectors = training_vectors(tr, fp.feature_cols, spec.target)            # shared by all fits
    try:
        if run_tuning:
            tuning = tune(df.sparkSession, tr, va, fp.feature_cols, spec.target, vectors=vectors, **(tune_kwargs or {}))
            hp.update(tuning.best_params)
        model = huber_fit(tr, fp.feature_cols, spec.target, hp["alpha"], hp["epsilon"], max_iter=max_iter,
                          vectors=vectors)
    finally:
        vectors.unpersist()
    model.set(model.predictionCol, prediction_field)
    r2 = r2_score(model.transform(va), spec.target, prediction_field) if val_pct > 0 else None
    ts = fp.target_scaler
    unscale = TargetUnscaleModel(col=prediction_field, mean=ts.v("means")[0], std=ts.v("stds")[0])
    bundle = PipelineModel(list(fp.pipeline.stages) + [model, unscale])
    if artifacts_dir:
        save_bundle(bundle, artifacts_dir)
        if tuning is not None:
            sink_csv(tuning.trials, artifacts_dir.rstrip("/") + "_hpt_results")
    return TrainResult(bundle, fp, model, r2, tuning, tr, va)


class BundleModel(StageModel):
    """All fitted column-map stages of a bundle as one model: the stage list is a
    single JSON param, so saving or loading is one small metadata file instead
    of one directory (and one write job) per stage."""

    stageSpecs = param("stageSpecs", "list of [class path, params]")
    _defaults = dict(stageSpecs=[])

    @staticmethod
    def from_stages(stages) -> "BundleModel":
        specs = []
        for st in stages:
            cls = type(st)
            if not cls.__module__.startswith("keelson.") or not hasattr(st, "apply"):
                raise TypeError(f"stage {cls.__name__} is not a keelson column stage")
            specs.append([f"{cls.__module__}.{cls.__name__}", {p.name: v for p, v in st._paramMap.items()}])
        return BundleModel(stageSpecs=specs)

    def stage_list(self) -> list:
        import importlib
        out = []
        for path, params in self.v("stageSpecs"):
            mod, name = path.rsplit(".", 1)
            if not mod.startswith("keelson."):
                raise ValueError(f"refusing to load stage class {path}")
            out.append(getattr(importlib.import_module(mod), name)(**params))
        return out

    def apply(self, cols, types=None):
        for st in self.stage_list():
            cols = st.apply(cols, types)
        return cols

    def apply_sql(self, cols, types=None):
        for st in self.stage_list():
            cols = st.apply_sql(cols, types)
        return cols


def save_bundle(bundle: PipelineModel, path: str) -> None:
    """artifact_pipeline: fitted preprocessing + model + target inverse in one
    directory (compact form when every stage is a keelson column stage)."""
    try:
        compact = BundleModel.from_stages(bundle.stages)
    except TypeError:
        bundle.write().overwrite().save(path)
        return
    compact.write().overwrite().save(path)


def load_bundle(path: str) -> PipelineModel:
    """Load either form (told by the saved class); always returns a ``PipelineModel`` of the stages."""
    import json

    from pyspark.sql import SparkSession
    saved = json.loads(SparkSession.active().read.text(f"{path.rstrip('/')}/metadata").first()["value"])["class"]
    if saved.rsplit(".", 1)[-1] == BundleModel.__name__:
        return PipelineModel(BundleModel.load(path).stage_list())
    return PipelineModel.load(path)


def predict(bundle: PipelineModel, df: DataFrame, spec: DatasetSpec, prediction_field: str = PREDICTION) -> DataFrame:
    """(id, prediction): predict + rescale in one projection; the ID is carried,
    never re-attached by position."""
    out = fused_transform(bundle, df.drop(spec.target) if spec.target in df.columns else df)
    return out.select(qcol(spec.id), qcol(prediction_field))


def score_batch(df: DataFrame, spec: DatasetSpec, bundle: PipelineModel, output_dir: str | None = None,
                validate_data: bool = True, check_unique_id: bool = True,
                check_output: bool = True, prediction_field: str = PREDICTION) -> DataFrame:
    """Validate, predict and write in one read of ``df``.

    The rules are counted by an ``Observation`` on the plan that writes (id, prediction) as Parquet under
    the shared folder; the ID rule reads that table's ID column.  Only if no rule is violated is the table
    written to ``output_dir``.  It is returned, so later actions do not score again.
    """
    missing = check_columns(df, spec, is_train=False) if validate_data else []
    raise_first([dict(rule=rule, column=c) for rule, c, _ in missing])
    rules = rule_aggregates(df, spec, is_train=False) if validate_data else []
    seen = Observation("score_batch")
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"), *[e.alias(f"a{i}") for i, (_, _, e) in enumerate(rules)])
    preds = predict(bundle, watched, spec, prediction_field)
    path = scratch_dir(df.sparkSession, "predictions")
    try:
        preds.write.parquet(path)
    except Exception:
        if validate_data:       # a value that no cast accepts ends the job before its counts: name the rule
            validate(df, spec, is_train=False, check_unique_id=check_unique_id)
        raise
    preds = df.sparkSession.read.schema(preds.schema).parquet(path)
    found = [dict(rule=rule, column=c) for i, (rule, c, _) in enumerate(rules) if seen.get[f"a{i}"]]
    if validate_data and check_unique_id and repeated_ids(preds, spec.id):
        found.append(dict(rule="unique_id", column=spec.id))
    raise_first(found)
    if check_output and not seen.get["n"]:
        raise ValidationError("The provided predictions DataFrame is empty.")
    if output_dir:
        sink_csv(preds, output_dir)
    return preds


# ----------------------------------------------------------------------------
# entry points in the reference's terms: a data directory + a JSON spec
def read_json_document(spark, path: str) -> dict:
    """A small JSON document (spec, config) from any file system Spark can read."""
    import json
    rows = spark.read.text(path, wholetext=True).collect()
    if not rows:
        raise FileNotFoundError(path)
    return json.loads(rows[0].value)


def run_training(spark, train_dir: str, spec_path: str, artifacts_dir: str, run_tuning: bool = False,
                 preprocessing_config_path: str | None = None, hyperparameters_path: str | None = None,
                 hpt_path: str | None = None, val_pct: float = 0.1, single_file: bool = False,
                 model_config_path: str | None = None, split_seed: int = 42, null_seed: int = 123) -> TrainResult:
    """load -> validate -> split -> inject nulls -> fit -> (tune) -> fit model -> save -> R^2.

    Numerics are read as text so that a non-numeric value is reported by the
    validation rule instead of failing the scan."""
    from keelson.operators.tune import DEFAULT_SPACE, DEFAULT_TRIALS
    from keelson.sources.files import src_csv
    spec = DatasetSpec.from_dict(read_json_document(spark, spec_path))
    cfg = PreprocessConfig.from_dict(read_json_document(spark, preprocessing_config_path)) \
        if preprocessing_config_path else PreprocessConfig()
    hp = read_json_document(spark, hyperparameters_path) if hyperparameters_path else None
    tune_kwargs = None
    if run_tuning and hpt_path:
        hpt = read_json_document(spark, hpt_path)
        tune_kwargs = dict(space=hpt.get("hyperparameters", DEFAULT_SPACE),
                           num_trials=hpt.get("num_trials", DEFAULT_TRIALS))
    settings = read_json_document(spark, model_config_path) if model_config_path else {}
    df = src_csv(spark, train_dir, spec, is_train=True, numeric_as_string=True, single_file=single_file)
    return train(df, spec, cfg, val_pct=settings.get("validation_split", val_pct), split_seed=split_seed,
                 null_seed=settings.get("seed_value", null_seed), hyperparameters=hp, run_tuning=run_tuning,
                 tune_kwargs=tune_kwargs, artifacts_dir=artifacts_dir,
                 prediction_field=settings.get("prediction_field_name", PREDICTION))


def run_batch_predictions(spark, test_dir: str, spec_path: str, artifacts_dir: str, output_dir: str,
                          single_file: bool = False, model_config_path: str | None = None) -> DataFrame:
    """load artifacts -> read -> validate -> one projection -> (id, prediction) -> CSV."""
    from keelson.sources.files import src_csv
    spec = DatasetSpec.from_dict(read_json_document(spark, spec_path))
    df = src_csv(spark, test_dir, spec, is_train=False, numeric_as_string=True, single_file=single_file)
    settings = read_json_document(spark, model_config_path) if model_config_path else {}
    return score_batch(df, spec, load_bundle(artifacts_dir), output_dir=output_dir,
                       prediction_field=settings.get("prediction_field_name", PREDICTION))
