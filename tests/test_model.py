"""Huber regression: optimality of the solution for the reference's objective,
robustness to outliers, persistence, R^2, tuning."""

import numpy as np
import pandas as pd
import pytest


from keelson.operators.model import (HuberPredictorModel, evaluate, huber_fit, load_model, r2_score, save_model,
                                     training_vectors)
from keelson.operators.tune import sample_params, tune


def make(spark, n=2000, outlier_share=0.1, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 1.0 + x @ np.array([2.0, -3.0, 0.5]) + rng.normal(scale=0.3, size=n)
    bad = rng.random(n) < outlier_share
    y[bad] += rng.standard_cauchy(bad.sum()) * 50 + 40
    pdf = pd.DataFrame({"id": np.arange(n), "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": y})
    return pdf, spark.createDataFrame(pdf)


def gradient(pdf, w, c, sigma, alpha, eps):
    X = pdf[["x1", "x2", "x3"]].to_numpy()
    z = (X @ w + c - pdf["y"].to_numpy()) / sigma
    inner = np.abs(z) <= eps
    dh = np.where(inner, 2 * z, 2 * eps * np.sign(z))
    h = np.where(inner, z * z, 2 * eps * np.abs(z) - eps * eps)
    gw = X.T @ dh + 2 * alpha * w
    gc = dh.sum()
    gs = (1 + h - dh * z).sum()
    return np.concatenate([gw, [gc, gs]]) / len(pdf)


@pytest.mark.parametrize("alpha,eps", [(1e-4, 1.35), (200.0, 1.35), (200.0, 1.9)])
def test_solution_is_stationary_for_reference_objective(spark, alpha, eps):
    pdf, df = make(spark)
    m = huber_fit(df, ["x1", "x2", "x3"], "y", alpha=alpha, epsilon=eps, max_iter=300, tol=1e-10)
    g = gradient(pdf, np.array(m.v("coefficients")), m.v("intercept"), m.v("scale"), alpha, eps)
    assert np.abs(g).max() < 1e-4, g


def test_recovers_coefficients_under_outliers(spark):
    pdf, df = make(spark, outlier_share=0.1, seed=4)
    m = huber_fit(df, ["x1", "x2", "x3"], "y")
    assert np.allclose(m.v("coefficients"), [2.0, -3.0, 0.5], atol=0.1)
    assert abs(m.v("intercept") - 1.0) < 0.15


def test_predict_expression_matches_and_persists(spark, tmp_dir):
    pdf, df = make(spark, n=300)
    m = huber_fit(df, ["x1", "x2", "x3"], "y")
    p = m.transform(df).select("id", "prediction").toPandas().sort_values("id")
    exp = pdf[["x1", "x2", "x3"]].to_numpy() @ np.array(m.v("coefficients")) + m.v("intercept")
    assert np.allclose(p["prediction"].to_numpy(), exp)
    save_model(m, tmp_dir + "/m")
    again = load_model(tmp_dir + "/m")
    p2 = again.transform(df).select("id", "prediction").toPandas().sort_values("id")
    assert np.allclose(p["prediction"], p2["prediction"])
    assert str(again).startswith("Model name: Huber Regressor")


def test_unfitted_model_cannot_be_saved_or_scored(spark, tmp_dir):
    from keelson.operators.model import NotFittedError, huber_estimator
    with pytest.raises(TypeError):
        save_model(huber_estimator(1e-4, 1.35, 10), tmp_dir + "/x")
    with pytest.raises(NotFittedError):
        evaluate(HuberPredictorModel(), spark.range(3), "id")


def test_r2_matches_formula(spark):
    rng = np.random.default_rng(9)
    y, p = rng.normal(size=500), rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "prediction": p}))
    exp = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(r2_score(df, "y") - exp) < 1e-12
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, prediction double")
    assert r2_score(const, "y") == 1.0
    off = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "y double, prediction double")
    assert r2_score(off, "y") == 0.0


def test_search_space_rules():
    space = [{"name": "alpha", "type": "float", "search_type": "log-uniform", "range_low": 1e-6, "range_high": 1.0},
             {"name": "epsilon", "type": "real", "search_type": "uniform", "range_low": 1.0, "range_high": 2.0},
             {"name": "k", "type": "int", "search_type": "uniform", "range_low": 1, "range_high": 3},
             {"name": "m", "type": "categorical", "categories": ["a", "b"]}]
    for t in range(50):
        p = sample_params(space, t)
        assert 1e-6 <= p["alpha"] <= 1.0 and 1.0 <= p["epsilon"] <= 2.0 and p["k"] in (1, 2, 3) and p["m"] in "ab"
    assert sample_params(space, 3) == sample_params(space, 3)
    with pytest.raises(ValueError):
        sample_params([{"name": "x", "type": "complex", "search_type": "uniform", "range_low": 0, "range_high": 1}], 0)


def test_tune_returns_trials(spark):
    pdf, df = make(spark, n=600)
    tr, va = df.where("id % 5 != 0"), df.where("id % 5 = 0")
    res = tune(spark, tr, va, ["x1", "x2", "x3"], "y", num_trials=4, parallelism=2)
    t = res.trials.toPandas()
    assert len(t) == 4 and list(t.columns) == ["number", "params_alpha", "params_epsilon", "value"]
    assert res.best_value == t["value"].min()
    with pytest.raises(AssertionError):
        tune(spark, tr, va, ["x1"], "y", num_trials=1)
    res2 = tune(spark, tr, va, ["x1", "x2", "x3"], "y", num_trials=4, parallelism=2, refine_trials=2, refine_top=2)
    t2 = res2.trials.toPandas()
    assert len(t2) == 6 and res2.best_value <= res.best_value
    top = t2.iloc[:4].sort_values(["value", "number"]).iloc[:2]
    for col in ("params_alpha", "params_epsilon"):
        assert t2[col].iloc[4:].between(top[col].min(), top[col].max()).all()


def test_newton_fits_share_scans_and_stay_few(spark):
    """Twenty trials take about as many scans as one; alone or together they give the same optimum."""
    from keelson.operators import newton
    pdf, df = make(spark, n=1500, seed=6)
    vectors = training_vectors(df, ["x1", "x2", "x3"], "y")
    trials = [(1e-4 * 4 ** t, 1.002 + t / 20) for t in range(20)]
    fits = newton.newton_fits(vectors, 3, trials)
    assert max(f.scans for f in fits) <= 40 and np.median([f.scans for f in fits]) <= 10 and all(f.done for f in fits)
    for f in fits:
        assert all(b <= a + 1e-9 * abs(a) for a, b in zip(f.history, f.history[1:]))
        g = gradient(pdf, f.point[:3], f.point[3], f.point[4], f.alpha, f.epsilon)
        assert np.abs(g).max() < 1e-6
    alone = newton.newton_fits(vectors, 3, trials[4:5], together=1)[0]
    assert np.allclose(alone.point, fits[4].point, rtol=1e-8)


@pytest.mark.parametrize("case", ["collinear", "constant feature", "exact line", "far from zero", "few rows", "hot row"])
def test_newton_on_awkward_data(spark, case):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([1.0, 2.0, -1.0]) + rng.normal(scale=0.1, size=400)
    if case == "collinear":
        x[:, 2] = 2 * x[:, 0]
    elif case == "constant feature":
        x[:, 1] = 3.0
    elif case == "exact line":
        y = x @ np.array([1.0, 2.0, -1.0]) + 5
    elif case == "far from zero":
        y = y * 0.1 + 1e6
    elif case == "few rows":
        x, y = x[:3], y[:3]
    elif case == "hot row":
        x[::3], y[::3] = x[0], y[0]
    pdf = pd.DataFrame({"x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": y})
    m = huber_fit(spark.createDataFrame(pdf), ["x1", "x2", "x3"], "y", alpha=1e-3)
    assert np.isfinite(m.v("coefficients")).all() and m.v("scale") > 0
    if case == "exact line":
        assert np.allclose(m.v("coefficients"), [1.0, 2.0, -1.0], atol=1e-3) and abs(m.v("intercept") - 5) < 1e-3
    elif case != "few rows":
        g = gradient(pdf, np.array(m.v("coefficients")), m.v("intercept"), m.v("scale"), 1e-3, 1.35)
        assert np.abs(g).max() < 1e-5, g


def test_newton_refuses_nulls_and_empty_input(spark):
    _, df = make(spark, n=10)
    with pytest.raises(ValueError):
        huber_fit(df.limit(0), ["x1"], "y")
    with pytest.raises(Exception, match="must not be null"):
        huber_fit(df.selectExpr("IF(id = 3, NULL, x1) AS x1", "y"), ["x1"], "y")
