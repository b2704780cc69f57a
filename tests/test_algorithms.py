"""The scalable algorithms against brute force on small inputs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from keelson.functions.quantile import exact_quantile
from keelson.functions.topk import top_k_per_group
from keelson.operators.selection import DropConstant, DropCorrelated, DropDuplicate, correlated_groups


def test_exact_quantile_matches_numpy_with_many_rounds(spark):
    rng = np.random.default_rng(3)
    n = 3001
    a = rng.standard_cauchy(n)                        # heavy tails: many narrowing rounds
    b = np.round(rng.normal(size=n), 1)               # many ties
    c = np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n))
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf).select(*[F.nanvl(x, F.lit(None).cast("double")).alias(x) for x in "abc"])
    for q in (0.5, 0.1, 0.9):
        got = exact_quantile(df, ["a", "b", "c"], q, bins=4)
        for col in "abc":
            v = pdf[col].dropna().to_numpy()
            assert abs(got[col] - np.quantile(v, q)) < 1e-9, (col, q)


def test_exact_quantile_even_count_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (10.0, 5.0), (20.0, 5.0)], "x double, y double")
    got = exact_quantile(df, ["x", "y"], 0.5, bins=2)
    assert got == {"x": 6.0, "y": 5.0}


def test_top_k_per_group_salted_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "v": rng.integers(0, 300, 2000).astype(str)})
    counts = pdf.groupby(["g", "v"]).size().rename("cnt").reset_index()
    df = spark.createDataFrame(counts)
    got = top_k_per_group(df, ["g"], [F.desc("cnt"), F.asc("v")], 7, salt_cols=["v"], salt=8).toPandas()
    exp = counts.sort_values(["g", "cnt", "v"], ascending=[True, False, True]).groupby("g").head(7)
    assert sorted(map(tuple, got[["g", "v", "cnt"]].values.tolist())) == \
        sorted(map(tuple, exp[["g", "v", "cnt"]].values.tolist()))


def test_duplicates_exact_and_type_aware(spark):
    rng = np.random.default_rng(1)
    n = 500
    x = rng.integers(0, 4, n).astype(float)
    pdf = pd.DataFrame({"id": np.arange(n), "a": x, "b": x.copy(), "c": x + 0.0, "d": rng.integers(0, 4, n).astype(float),
                        "e": x.astype(int), "s": x.astype(str), "t": x.astype(str)})
    df = spark.createDataFrame(pdf)
    m = DropDuplicate(excludeCols=["id"], idCol="id").fit(df)
    # brute force: identical values and identical dtype, keep the smallest name
    cols = [c for c in pdf.columns if c != "id"]
    drop = set()
    for i, a in enumerate(sorted(cols)):
        for b in sorted(cols)[i + 1:]:
            if a not in drop and pdf[a].dtype == pdf[b].dtype and pdf[a].equals(pdf[b]):
                drop.add(b)
    assert set(m.v("dropCols")) == drop == {"b", "c", "t"}


def test_constant_include_ignore(spark):
    df = spark.createDataFrame([(1, 1.0, None, "x"), (2, 1.0, 2.0, "x"), (3, 1.0, 2.0, "y")],
                               "id int, a double, b double, c string")
    assert DropConstant(excludeCols=["id"]).fit(df).v("dropCols") == ["a"]
    assert sorted(DropConstant(excludeCols=["id"], missingValues="ignore").fit(df).v("dropCols")) == ["a", "b"]
    assert DropConstant(excludeCols=["id"], tol=0.7).fit(df).v("dropCols") == ["a"]
    import pytest
    with pytest.raises(ValueError, match="no columns after dropping"):
        DropConstant(excludeCols=["id"], tol=0.6).fit(df)


def test_correlated_grouping_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 400
    base = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": base, "b": 3 * base + rng.normal(scale=0.01, size=n),
                        "c": rng.normal(size=n), "d": -0.5 * base + rng.normal(scale=0.001, size=n),
                        "e": np.ones(n)})
    df = spark.createDataFrame(pdf)
    m = DropCorrelated(excludeCols=["id"], threshold=0.98).fit(df)
    corr = pdf[["a", "b", "c", "d", "e"]].corr().to_numpy()
    groups = correlated_groups(["a", "b", "c", "d", "e"], corr.tolist(), 0.98)
    assert groups == [["a", "b", "d"]] == m.v("groups")
    assert sorted(m.v("dropCols")) == ["a", "d"]  # b has the largest variance


def test_chunked_profiles_on_wide_input_match_pandas(spark):
    """Wide inputs are split into several codegen-sized aggregate jobs; the
    merged result must equal a direct computation."""
    from keelson.functions.profile import chunked_aggregate, numeric_profile
    from keelson.operators.selection import column_facts
    rng = np.random.default_rng(11)
    n, d = 400, 40
    data = rng.normal(size=(n, d)) * rng.uniform(1, 100, size=d)
    data[rng.random((n, d)) < 0.05] = np.nan
    pdf = pd.DataFrame(data, columns=[f"c{j:02d}" for j in range(d)])
    pdf["id"] = np.arange(n)
    pdf["s1"] = np.where(rng.random(n) < 0.5, "a", "b")
    pdf["s2"] = "same"
    df = spark.createDataFrame(pdf).select(
        "id", "s1", "s2", *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in pdf.columns[:d]])
    cols = list(pdf.columns[:d])
    prof = numeric_profile(df, cols)
    for c in cols:
        v = pdf[c].dropna()
        assert prof[c]["count"] == len(v) and prof[c]["n"] == n
        assert abs(prof[c]["mean"] - v.mean()) < 1e-9 * max(1, abs(v.mean()))
        assert abs(prof[c]["std_pop"] - v.std(ddof=0)) < 1e-9 * v.std(ddof=0)
        assert abs(prof[c]["var_samp"] - v.var(ddof=1)) < 1e-9 * v.var(ddof=1)
        assert prof[c]["min"] == v.min() and prof[c]["max"] == v.max()
    facts = column_facts(df, cols + ["s1", "s2"], "id")
    assert facts["s2"]["min"] == facts["s2"]["max"] and facts["s1"]["min"] != facts["s1"]["max"]
    assert all(facts[c]["nn"] == pdf[c].notna().sum() for c in cols)
    r = chunked_aggregate(df, [(f"x{j}", F.count_if(F.col(c) > 0), 1) for j, c in enumerate(cols)], max_fields=7)
    assert [r[f"x{j}"] for j in range(d)] == [int((pdf[c] > 0).sum()) for c in cols]


def test_exact_quantile_with_a_hot_value(spark):
    """One value holding a third of the rows: the search ends in the bin whose min = max."""
    rng = np.random.default_rng(21)
    n = 3000
    v = rng.normal(size=n)
    v[: n // 3] = 0.25
    df = spark.createDataFrame(pd.DataFrame({"x": v}))
    for q in (0.5, 0.2, 0.9):
        got = exact_quantile(df, ["x"], q, bins=8)["x"]
        assert abs(got - np.quantile(v, q)) < 1e-12


def test_duplicate_ids_with_a_hot_id(spark):
    from keelson.operators.validate import violations
    from keelson.spec import DatasetSpec, Feature
    rows = [(7 if i % 3 == 0 else i, float(i)) for i in range(3000)]  # id 7 holds a third of the rows
    df = spark.createDataFrame(rows, "id long, x double")
    spec = DatasetSpec("id", "t", (Feature("x", "NUMERIC", True, example=1.0),))
    got = {(r.rule, r.column): r.n_violations for r in violations(df, spec, is_train=False).collect()}
    n_seven = sum(1 for r in rows if r[0] == 7)
    assert got == {("unique_id", "id"): n_seven - 1}


def test_exact_quantile_over_the_whole_range_of_doubles(spark):
    """Values from 1e-320 to 1.7e308 of both signs, infinities, ties and zeros."""
    import math
    import random
    rnd = random.Random(9)
    xs = [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-320, 308.2) for _ in range(6000)] + [0.0, -0.0] * 50 \
        + [1.7e308, -1.7e308] * 20 + [float("inf")] * 3 + [5e-324] * 9
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)] * 7, "x double").repartition(5)
    order = sorted(xs)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        rank = q * (len(xs) - 1)
        lo, hi = order[math.floor(rank)], order[math.ceil(rank)]
        got = exact_quantile(df, ["x"], q)["x"]
        assert min(lo, hi) <= got <= max(lo, hi) and (lo != hi or got == lo)


def test_select_ranks_of_many_columns(spark):
    from pyspark.sql import functions as F
    from keelson.functions.quantile import select_ranks
    df = spark.range(997).select(*[((F.col("id") * (7 + i)) % 997 * 0.37 - i).alias(f"c{i}") for i in range(70)])
    got = select_ranks(df, {f"c{i}": (F.col(f"c{i}"), 10 * i) for i in range(70)})
    assert all(abs(got[f"c{i}"] - (10 * i * 0.37 - i)) < 1e-9 for i in range(70))


def test_split_and_null_injection_lose_no_row_without_an_id(spark):
    from pyspark.sql import functions as F
    from keelson.operators.sample import inject_nulls, split_train_val
    df = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"), F.col("id").alias("x"))
    for exact in (False, True):
        tr, va = split_train_val(df, "id", 0.2, exact_size=exact)
        a, b = {r.x for r in tr.collect()}, {r.x for r in va.collect()}
        assert not a & b and a | b == set(range(100)) and (not exact or len(b) == 20)
    assert inject_nulls(df, "id", ["x"]).count() == 100
