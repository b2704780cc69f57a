"""Robust linear regression (Huber loss) and its scoring.

Objective of the reference (sum over n rows, concomitant scale sigma):
    sum_i [sigma + H_eps((x_i w + c - y_i) / sigma) * sigma] + alpha * |w|^2
``huber_fit`` minimises it by damped Newton steps on aggregated statistics
(``newton.py``: about ten scans).  ``huber_estimator`` is MLlib's form of the
same problem (its objective is divided by 2n, so lambda = alpha / n, without
standardization), for pipelines of MLlib stages.  Scoring is a plain SQL
expression ``intercept + sum(coef_i * x_i)`` that stays in whole-stage codegen.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from keelson.functions.exprs import qcol
from keelson.functions.sqltext import lit as sql_lit
from keelson.functions.states import as_array
from keelson.operators.base import StageModel, param
from keelson.operators.newton import newton_fits

# The reference's default hyperparameters and limit of steps.
DEFAULT_ALPHA = 0.0001
DEFAULT_EPSILON = 1.35
MAX_ITER = 100
EPS_FLOOR = 1.0 + 1e-7   # MLlib requires epsilon > 1


class NotFittedError(ValueError):
    pass


def assemble(df: DataFrame, feature_cols: list[str], out: str = "features", keep: list[str] | None = None) -> DataFrame:
    """Vector of ``feature_cols`` (in that order) plus the ``keep`` columns.

    Columns are renamed to positional aliases first: one-hot names carry data
    labels (dots, spaces, backticks), which VectorAssembler would read as
    nested field paths."""
    keep = [c for c in (keep or []) if c not in feature_cols]
    slots = [f"__x{i}" for i in range(len(feature_cols))]
    narrow = df.select(*[qcol(c).alias(a) for c, a in zip(feature_cols, slots)], *[qcol(c) for c in keep])
    vec = VectorAssembler(inputCols=slots, outputCol=out, handleInvalid="error").transform(narrow)
    return vec.select(out, *[qcol(c) for c in keep])


def huber_estimator(alpha: float, epsilon: float, n: int, label: str = "label",
                    features: str = "features", max_iter: int = MAX_ITER, tol: float = 1e-6) -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol=label, predictionCol="prediction",
                            loss="huber", epsilon=max(float(epsilon), EPS_FLOOR),
                            regParam=float(alpha) / max(n, 1), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, maxIter=max_iter, tol=tol)


class HuberPredictorModel(StageModel):
    """Fitted coefficients as plain params; ``apply`` adds the prediction column."""

    featureCols = param("featureCols")
    coefficients = param("coefficients")
    intercept = param("intercept")
    scale = param("scale")
    alpha = param("alpha")
    epsilon = param("epsilon")
    predictionCol = param("predictionCol")
    _defaults = dict(featureCols=[], coefficients=[], intercept=0.0, scale=1.0, alpha=DEFAULT_ALPHA,
                     epsilon=DEFAULT_EPSILON, predictionCol="prediction")

    def predict_expr(self, cols) -> Column:
        e = F.lit(float(self.v("intercept")))
        for c, w in zip(self.v("featureCols"), self.v("coefficients")):
            e = e + cols[c].cast("double") * F.lit(float(w))
        return e

    def apply(self, cols, types=None):
        out = OrderedDict(cols)
        out[self.v("predictionCol")] = self.predict_expr(cols)
        return out

    def apply_sql(self, cols, types=None):
        e = sql_lit(float(self.v("intercept")))
        for c, w in zip(self.v("featureCols"), self.v("coefficients")):
            e = f"({e} + (CAST({cols[c]} AS DOUBLE) * {sql_lit(float(w))}))"
        out = OrderedDict(cols)
        out[self.v("predictionCol")] = e
        return out

    @staticmethod
    def from_mllib(m: LinearRegressionModel, feature_cols, alpha, epsilon) -> "HuberPredictorModel":
        return HuberPredictorModel(featureCols=list(feature_cols), coefficients=[float(x) for x in m.coefficients],
                                   intercept=float(m.intercept), scale=float(m.scale), alpha=float(alpha),
                                   epsilon=float(epsilon))

    def __str__(self):
        return f"Model name: Huber Regressor (alpha: {self.v('alpha')}, epsilon: {self.v('epsilon')})"


def training_vectors(df: DataFrame, feature_cols: list[str], label: str) -> DataFrame:
    """Persisted (features array<double>, __label) rows; the caller unpersists them."""
    return df.select(as_array([qcol(c) for c in feature_cols]).alias("features"),
                     qcol(label).cast("double").alias("__label")).persist(StorageLevel.MEMORY_AND_DISK)


def huber_fit(df: DataFrame, feature_cols: list[str], label: str, alpha: float = DEFAULT_ALPHA,
              epsilon: float = DEFAULT_EPSILON, max_iter: int = MAX_ITER, tol: float = 1e-9,
              vectors: DataFrame | None = None) -> HuberPredictorModel:
    """Fit on ``df`` (features as columns).  The feature arrays are persisted (memory and
    disk) for the scans and released afterwards; ``vectors`` are such ones, kept by the caller."""
    data = vectors if vectors is not None else training_vectors(df, feature_cols, label)
    try:
        fit = newton_fits(data, len(feature_cols), [(float(alpha), float(epsilon))], max_iter, tol)[0]
    finally:
        if vectors is None:
            data.unpersist()
    return HuberPredictorModel(featureCols=list(feature_cols), coefficients=[float(v) for v in fit.point[:-2]],
                               intercept=float(fit.point[-2]), scale=float(fit.point[-1]), alpha=float(alpha),
                               epsilon=float(epsilon))


def r2_expr(y: Column, p: Column) -> Column:
    """Aggregate expression for R^2 in one pass; zero denominator -> 1.0 when
    the residuals are 0, else 0.0."""
    ss_res = F.sum((y - p) * (y - p))
    ss_tot = F.var_pop(y) * F.count(y)
    return (F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - ss_res / ss_tot))


def r2_score(df: DataFrame, label: str, prediction: str = "prediction") -> float:
    return df.agg(r2_expr(qcol(label).cast("double"), qcol(prediction).cast("double")).alias("r2")).first()["r2"]


def evaluate(model, df: DataFrame, label: str) -> float:
    if not isinstance(model, HuberPredictorModel) or not model.v("featureCols"):
        raise NotFittedError("Model is not fitted yet.")
    return r2_score(model.transform(df), label)


def save_model(model, path: str) -> None:
    """artifact_model: only a fitted model can be saved."""
    if not isinstance(model, (HuberPredictorModel, LinearRegressionModel)):
        raise TypeError("Model is not fitted yet: expected a fitted HuberPredictorModel")
    model.write().overwrite().save(path)


def load_model(path: str) -> HuberPredictorModel:
    return HuberPredictorModel.load(path)
