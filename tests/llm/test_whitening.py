import duckdb
import numpy as np
import pytest
from cases import odd_vectors
from conftest import SF_SMALL
from keelson.llm import queries, whitening
from keelson.llm.secular import Spectrum, rank_one_update, secular_roots


def brute(vectors: np.ndarray):
    """Whole numbers, exact deviations, eigenvalues and components by falling eigenvalue."""
    x = np.floor(vectors * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    centred = away / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return (away.astype(object) ** 2).sum(axis=1), e[::-1], centred @ q[:, ::-1], np.trace(centred.T @ centred / n)


def test_query_equals_a_direct_eigendecomposition(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_SMALL}/embeddings.parquet' ORDER BY vec_id").fetchall()
    deviation, e, projected, trace = brute(np.array([r[1] for r in rows], dtype=np.float64))
    got = queries.op12_whitening(spark, SF_SMALL).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == len(rows) * 32 and set(got["n"]) == {len(rows)}
    assert got["deviation"].tolist() == np.repeat(deviation, 32).tolist()
    assert np.allclose(got["explained"][:32], e[:32] / trace, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    mine = got["whitened"].to_numpy().reshape(len(rows), 32)
    want = projected[:, :32] / np.sqrt(e[:32])
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-8


@pytest.mark.parametrize("kind", ["even", "repeated", "low rank", "axes", "constant", "many scales"])
def test_spectrum_follows_the_scatter(kind):
    rnd = np.random.default_rng(5)
    x = {"even": lambda: rnd.normal(size=(300, 12)) * 8, "repeated": lambda: np.repeat(rnd.normal(size=(9, 12)), 20, axis=0),
         "low rank": lambda: rnd.normal(size=(200, 3)) @ rnd.normal(size=(3, 12)), "axes": lambda: np.eye(12)[rnd.integers(0, 12, 150)],
         "constant": lambda: np.ones((30, 12)), "many scales": lambda: rnd.normal(size=(200, 12)) * 10.0 ** np.linspace(-6, 6, 12)}[kind]()
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    whole, left, right, weighted = (Spectrum.empty(12) for _ in range(4))
    for i, row in enumerate(x):
        whole.add(row)
        (left if i < len(x) // 3 else right).add(row)
    left.merge(right)
    rows, times = np.unique(x, axis=0, return_counts=True)
    for row, t in zip(rows, times, strict=True):
        weighted.add(row, int(t))
    for s in (whole, left, weighted):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0), rtol=1e-9)
        assert np.abs(s.basis.T @ s.basis - np.eye(12)).max() < 1e-12
        assert np.abs(s.basis * s.values @ s.basis.T - scatter).max() <= 1e-12 * max(np.abs(scatter).max(), 1)


def test_roots_lie_between_the_poles():
    poles, weights = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-12, 2.0, 0.5, 1e-20])
    origin, offset = secular_roots(poles, weights)
    roots = poles[origin] + offset
    assert (roots[:-1] >= poles[:-1]).all() and (roots[:-1] <= poles[1:]).all() and roots[-1] >= poles[-1]
    dense = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
    assert np.allclose(roots, dense, atol=1e-12)
    values, basis = rank_one_update(np.zeros(3), np.eye(3), np.array([3.0, 0.0, 4.0]), 2.0)
    assert np.allclose(values, [0, 0, 50]) and np.allclose(np.abs(basis[:, 2]), [0.6, 0, 0.8])


def test_odd_rows(spark):
    df = odd_vectors(spark, 8)
    out = whitening.whiten(df).toPandas()
    kept = [(r["vec_id"], r["embedding"]) for r in df.collect()
            if r["embedding"] and len(r["embedding"]) == 8 and all(v is not None and np.isfinite(v) for v in r["embedding"])]
    deviation, e, _, trace = brute(np.array([v for _, v in kept]))
    assert len(out) == 8 * len(kept) and sorted(set(out["component"])) == list(range(1, 9))
    assert sorted(out["deviation"]) == sorted(np.repeat(deviation, 8).tolist())
    assert np.allclose(sorted(set(out["explained"]), reverse=True), e / trace, rtol=1e-9)
    assert whitening.whiten(df.limit(0)).count() == 0
    same = whitening.whiten(df.filter("vec_id = 58")).toPandas()
    assert len(same) == 16 and not same["whitened"].any() and not same["explained"].any() and not same["deviation"].any()


def test_many_tasks_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    x = np.random.default_rng(9).normal(size=(200, 6))
    x[::3] = x[0]                                            # a third of all rows are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = whitening.whiten(df.repartition(20)).toPandas().sort_values(["id", "component"])
    _, e, projected, trace = brute(x)
    assert np.allclose(out["explained"][:6], e / trace, rtol=1e-10)
    assert np.allclose(np.abs(out["whitened"].to_numpy().reshape(200, 6)), np.abs(projected / np.sqrt(e)), atol=1e-9)
