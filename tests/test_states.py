"""Folded states and frequent labels against brute force; the plans they avoid."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from keelson.functions import heavy, states
from keelson.operators.selection import DropConstant
from keelson.operators.stages import MostFrequentImputer, OneHotEncoder, RareLabelEncoder
from keelson.plans import catalog as C


def numbers(n: int = 700) -> list:
    rng = np.random.default_rng(4)
    return [(float(rng.normal(1e6, 3)), None if i % 3 == 0 else float(i % 5), None, float(rng.standard_cauchy()),
             "abc"[i % 3] if i % 7 else None) for i in range(n)]


def test_moments_equal_a_direct_computation(spark):
    rows = numbers()
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, s string").repartition(7)
    cols = ["a", "b", "c", "d"]
    m = states.fold(df.select(states.as_array([F.col(c) for c in cols]).alias("x")), lambda: states.no_moments(4),
                    lambda s, b: states.merge_moments(s, states.moments_of(states.matrix(b.column(0), 4))), states.merge_moments)
    for i in range(4):
        v = np.array([r[i] for r in rows if r[i] is not None])
        assert m[0, i] == len(v)
        if len(v):
            assert np.isclose(m[1, i], v.mean(), rtol=1e-12) and np.isclose(m[2, i], ((v - v.mean()) ** 2).sum(), rtol=1e-9)
            assert (m[3, i], m[4, i]) == (v.min(), v.max())


def test_facts_tell_equal_columns_and_correlations(spark):
    rows = numbers()
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, s string").repartition(5) \
        .fillna(0.5, ["b", "c"]).select("*", (F.col("a") + 0).alias("a2"), (-F.col("d")).alias("e"), F.col("s").alias("t"))
    cols = ["a", "b", "c", "d", "a2", "e"]
    f = states.column_facts_fold(df, [F.col(c) for c in cols], [F.col("s"), F.col("t")])
    assert f["n"] == 700 and list(f["label_counts"]) == [600, 600]
    assert (f["marks"][:, 0] == f["marks"][:, 4]).all() and (f["marks"][:, 0] != f["marks"][:, 1]).any()
    assert (f["label_marks"][:, 0] == f["label_marks"][:, 1]).all()
    x = df.select(*cols).toPandas().to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x.T)
    got = states.correlations(f)
    assert np.isnan(got[2]).all() and np.isclose(got[0, 4], 1) and np.isclose(got[3, 5], -1)
    assert np.allclose(got[[1, 3]][:, [1, 3, 5]], want[[1, 3]][:, [1, 3, 5]], atol=1e-9)
    assert np.allclose(states.sample_variances(f)[[1, 3]], x.var(axis=0, ddof=1)[[1, 3]])


def test_fold_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, s string")
    assert states.column_facts_fold(df, [F.col("a")], [F.col("s")])["n"] == 0
    assert heavy.heavy_labels(df, ["s"]) == {"s": heavy.Heavy(0, 0, {}, 0, 0)}


@pytest.mark.parametrize("slots", [3, 10, 60, 1000])
def test_heavy_labels_are_exact_and_bounded(spark, slots):
    rng = np.random.default_rng(slots)
    values = [None if v % 13 == 0 else f"l{v}" for v in np.minimum(rng.zipf(1.4, 4000), 500).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "s string").repartition(9)
    got, want = heavy.heavy_labels(df, ["s"], slots)["s"], Counter(v for v in values if v is not None)
    assert (got.n, got.nulls) == (4000, sum(v is None for v in values))
    assert all(want[k] == v for k, v in got.counts.items())
    rest = max((c for k, c in want.items() if k not in got.counts), default=0)
    assert rest <= got.bound <= got.n / (slots + 1)
    assert got.complete == (len(want) <= slots) and (not got.complete or got.counts == dict(want))
    top = got.top(2)
    if top is not None:
        assert top == [k for k, _ in sorted(want.items(), key=lambda e: (-e[1], e[0]))[:2]]


def test_encoders_with_few_counters_equal_full_counts(spark, monkeypatch):
    """Columns with more labels than counters: clear winners by the summary, unclear ones by the full table."""
    import keelson.operators.selection as selection
    import keelson.operators.stages as stages
    rng = np.random.default_rng(8)
    rows = [("big" if i % 4 == 0 else f"x{rng.integers(300)}", f"u{i}", "abcdef"[i % 6], None if i % 50 == 0 else f"y{i % 40}")
            for i in range(1200)]
    df = spark.createDataFrame(rows, "clear string, unique string, small string, even string").repartition(6)
    cols = df.columns
    fits = [lambda: RareLabelEncoder(inputCols=cols, tol=0.02, nCategories=2).fit(df).v("keep"),
            lambda: OneHotEncoder(inputCols=cols, maxCategories=3).fit(df).v("categories"),
            lambda: MostFrequentImputer(inputCols=cols, threshold=0.5).fit(df).fills(),
            lambda: DropConstant(inputCols=cols, tol=0.2).fit(df).v("dropCols")]
    exact = [f() for f in fits]
    for module in (stages, selection):
        monkeypatch.setattr(module, "SLOTS", 5)
    assert [f() for f in fits] == exact
    counts = {c: Counter(r[i] for r in rows if r[i] is not None) for i, c in enumerate(cols)}
    assert exact[0] == [sorted(v for v, k in counts[c].items() if k / 1200 >= 0.02) for c in cols]
    assert exact[1] == [[v for v, _ in sorted(counts[c].items(), key=lambda e: (-e[1], e[0]))[:3]] for c in cols]
    assert exact[2] == {c: min(counts[c].items(), key=lambda e: (-e[1], e[0]))[0] for c in cols}
    assert exact[3] == ["clear"]


def test_ten_million_distinct_labels(spark):
    """No exchange is keyed by label, and the two frequent labels of ten million are found with their counts."""
    n = 10_000_000
    df = spark.range(n).select(F.when(F.col("id") % 20 == 0, F.lit("often")).when(F.col("id") % 30 == 1, F.lit("some"))
                               .otherwise(F.col("id").cast("string")).alias("s"))
    model = RareLabelEncoder(inputCols=["s"], tol=0.03, nCategories=1).fit(df)
    assert model.v("keep") == [["often", "some"]]
    h = heavy.heavy_labels(df, ["s"])["s"]
    assert h.counts["often"] == n // 20 and h.counts["some"] == math.ceil((n - 1) / 30) and h.bound <= n / 1025


def test_label_fits_shuffle_states_only(spark, monkeypatch):
    """No fit of labels with clear winners makes a frequency table, and a fold's only exchange is keyed by its slot."""
    import keelson.operators.stages as stages
    import keelson.plans.preprocess as preprocess
    monkeypatch.setattr(stages, "frequency_table", None)
    df = C.events_frame(spark, SF_SMALL)
    RareLabelEncoder(inputCols=["event_type", "parity"], tol=0.05).fit(df)
    OneHotEncoder(inputCols=["event_type", "parity"]).fit(df)
    MostFrequentImputer(inputCols=["event_type", "parity"]).fit(df)
    preprocess.Preprocessor(C.events_spec()).fit(df)
    plans = [p for p in _plans(spark)[-2:]]
    assert all(p.count("hashpartitioning(") == p.count("hashpartitioning(slot") for p in plans)


def _plans(spark) -> list[str]:
    store = spark._jsparkSession.sharedState().statusStore()
    executions = store.executionsList()
    return [executions.apply(i).physicalPlanDescription() for i in range(executions.size())]


def test_wide_fit_scans_its_input_a_few_times(spark):
    """A fit of 200 + 2 columns reads the staged table at most five times."""
    from keelson.plans.preprocess import Preprocessor
    df, spec = C.wide_orders_frame(spark, SF_SMALL)
    before = _executions(spark)
    fp = Preprocessor(spec).fit(df)
    assert _executions(spark) - before <= 6                       # the staging write and at most five scans
    assert len([c for c in fp.feature_cols if c.startswith("f")]) == 300


def _executions(spark) -> int:
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


@pytest.mark.parametrize("capacity", [2, 16, 200, 1 << 14])
def test_ranks_are_exact_whatever_the_sketch_holds(spark, capacity):
    """Ties, hot values, infinities and nulls; the counts below and at the value are exact too."""
    from keelson.functions.quantile import order_statistics
    rng = np.random.default_rng(capacity)
    columns = {"u": rng.normal(size=3000), "ties": rng.integers(0, 7, 3000).astype(float),
               "hot": np.where(rng.random(3000) < 0.4, 5.0, rng.standard_cauchy(3000)),
               "ends": np.r_[[np.inf, -np.inf] * 3, rng.random(2994) * 1e300], "none": np.full(3000, np.nan)}
    rows = [tuple(None if np.isnan(columns[c][i]) else float(columns[c][i]) for c in columns) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(6)
    for rank in (0, 1, 1499, 2998):
        got = order_statistics(df, {c: (F.col(c), lambda n: [rank, rank + 1] if n else []) for c in columns}, capacity)
        assert got.pop("none") == []
        for c, found in got.items():
            v = np.sort(columns[c])
            for k, r in zip((rank, rank + 1), found, strict=True):
                assert (r.value, r.below, r.equal) == (v[k], (v < v[k]).sum(), (v == v[k]).sum()), (c, k, capacity)


def test_median_takes_two_scans(spark):
    from keelson.functions.quantile import exact_quantile
    df = spark.range(0, 300_000, 1, 4).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    before = _executions(spark)
    got = exact_quantile(df, ["x"])["x"]
    assert _executions(spark) - before == 2
    assert got == df.selectExpr("median(x)").first()[0]


@pytest.mark.parametrize("n,pct", [(1000, 0.1), (999, 0.25), (7, 0.1), (50_000, 0.013), (0, 0.2), (10, 0.0)])
def test_exact_split_has_the_exact_size(spark, n, pct):
    from keelson.operators.sample import split_train_val
    df = spark.range(n).select("id", (F.col("id") % 10).alias("v"))
    train, val = split_train_val(df, "id", pct, exact_size=True)
    assert val.count() == math.ceil(n * pct) and train.count() == n - math.ceil(n * pct)
    assert train.join(val, "id").count() == 0
