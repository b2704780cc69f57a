"""Fixed-decimal text like C / Python '%.4f' (exact binary value, ties to even)."""

import numpy as np
import pandas as pd

from keelson.functions.exprs import format_fixed


def test_matches_python_percent_f(spark):
    rng = np.random.default_rng(7)
    vals = list(rng.normal(scale=1000, size=3000)) + list(rng.normal(scale=1e-3, size=500))
    vals += [2.15625, 2.15635, 1.00005, 0.00005, -0.00005, 0.12335, 0.12345, 1.5, 2.5, -2.5e-5, -0.0, 0.0,
             123456789.98765, 1e13 + 0.5, 0.99995, 9.99995, -9.99995, 1e-10]
    vals += [round(v, 6) for v in rng.normal(size=2000)]          # values like rounded scores: many 5th-digit ties
    vals += [k / 32.0 for k in range(-400, 400)]                  # exactly representable halves at the 5th digit
    pdf = pd.DataFrame({"i": range(len(vals)), "x": vals})
    got = {r.i: r.s for r in spark.createDataFrame(pdf).select("i", format_fixed("x", 4).alias("s")).collect()}
    bad = [(v, got[i], "%.4f" % v) for i, v in enumerate(vals) if got[i] != "%.4f" % v]
    assert not bad, bad[:10]


def test_nulls_and_other_decimals(spark):
    df = spark.createDataFrame([(1, None), (2, 0.125), (3, float("nan")), (4, 1e300)], "i int, x double")
    got = {r.i: r.s for r in df.select("i", format_fixed("x", 2).alias("s")).collect()}
    assert got[1] is None and got[2] == "%.2f" % 0.125
    assert got[4] is not None


def test_format_decimals_staged_matches_python(spark):
    from keelson.sources.files import format_decimals
    rng = np.random.default_rng(8)
    vals = [k / 32.0 for k in range(-300, 300)] + list(rng.normal(scale=100, size=1000)) + [None, float("nan")]
    pdf = pd.DataFrame({"i": range(len(vals)), "x": vals, "y": [None if v is None else -v for v in vals]})
    got = format_decimals(spark.createDataFrame(pdf)).collect()
    for r in got:
        for col, v in (("x", vals[r.i]), ("y", None if vals[r.i] is None else -vals[r.i])):
            exp = None if v is None or v != v else "%.4f" % v
            assert r[col] == exp, (v, r[col], exp)
