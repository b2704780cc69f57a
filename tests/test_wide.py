"""The steps that every value of a wide table goes through."""

import glob
import math

import numpy as np
import pyarrow.parquet as pq
from conftest import SF_SMALL
from pyspark.sql import functions as F

from keelson.functions import states
from keelson.plans import catalog as C
from keelson.plans.preprocess import Preprocessor, fused_transform
from keelson.session import ensure_checkpoint_dir, staged


def test_staged_doubles_have_no_dictionary(spark):
    df = spark.range(0, 5000, 1, 1).select("id", F.rand(1).alias("x"), (F.col("id") % 3).cast("double").alias("a.b"),
                                           F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"))
    table = staged(df, "plain")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))
    file = glob.glob(table.inputFiles()[0].replace("file://", ""))[0]
    group = pq.ParquetFile(file).metadata.row_group(0)
    encodings = {group.column(i).path_in_schema: set(group.column(i).encodings) for i in range(group.num_columns)}
    dictionary = {"PLAIN_DICTIONARY", "RLE_DICTIONARY"}
    assert not encodings["x"] & dictionary
    assert encodings["label"] & dictionary


def test_wide_result_is_rounded_by_arithmetic(spark):
    """Four decimals, halves away from zero, nulls and NaN kept, no negative zero; no decimal text of any value."""
    values = [0.00005, -0.00005, 0.5, -3.99995, 1.23456, -1.23454, -0.00001, 4.0, -4.0, 0.0, 2.71828182]
    want = [0.0001, -0.0001, 0.5, -4.0, 1.2346, -1.2345, 0.0, 4.0, -4.0, 0.0, 2.7183]
    df = spark.createDataFrame([(x,) for x in [*values, None, math.nan]], "x double").selectExpr(f"{C._rounded('x')} AS x")
    *got, null, nan = [r["x"] for r in df.collect()]
    assert got == want and null is None and math.isnan(nan)
    assert all(math.copysign(1, x) > 0 for x in got if x == 0)
    out = C.q_preprocess_wide(spark, SF_SMALL)
    assert "round(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_folds_do_not_depend_on_the_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1.0, size=(3000, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 4] = np.nan
    keys, hashes = rng.integers(0, 1 << 62, 3000).astype(np.uint64), rng.integers(0, 9, (3000, 1))
    found = []
    for values in (1, 4000, 1 << 20):
        monkeypatch.setattr(states, "BLOCK_VALUES", values)
        found.append((states.moments_of(x), states.Facts(5, 1).add(x, hashes, hashes > 2, keys).packed()))
    there = x[:, :4]
    for m, facts in found:
        assert m[0].tolist() == facts["counts"].tolist() == (~np.isnan(x)).sum(axis=0).tolist()
        np.testing.assert_allclose(m[1, :4], np.nanmean(there, axis=0), rtol=1e-14)
        np.testing.assert_allclose(m[2, :4] / m[0, :4], np.nanvar(there, axis=0), rtol=1e-9)
        assert m[3, :4].tolist() == facts["low"][:4].tolist() == np.nanmin(there, axis=0).tolist()
        assert m[4, :4].tolist() == facts["high"][:4].tolist() == np.nanmax(there, axis=0).tolist()
        assert facts["low"][4] == np.inf and facts["high"][4] == -np.inf
        np.testing.assert_allclose(facts["products"], found[0][1]["products"], rtol=1e-12)
        for name in ("marks", "label_marks", "label_counts", "label_low", "label_high"):
            assert facts[name].tolist() == found[0][1][name].tolist()


def test_wide_query_keeps_no_copy_of_its_features(spark):
    """The features follow from orders in every scan: a copy would take twenty times the table's disk."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/**", recursive=True))
    out = C.q_preprocess_wide(spark, SF_SMALL)
    out.write.format("noop").mode("overwrite").save()
    assert set(glob.glob(f"{folder}/**", recursive=True)) == before
    assert out.inputFiles() == C.table(spark, SF_SMALL, "orders").inputFiles()


def test_fit_of_derived_rows_equals_fit_of_their_copy(spark):
    df, spec = C.wide_orders_frame(spark, SF_SMALL, 40)
    copied, derived = Preprocessor(spec).fit(df), Preprocessor(spec).fit(df, rederive=True)
    assert (derived.n_rows, derived.feature_cols, derived.report) == (copied.n_rows, copied.feature_cols, copied.report)
    rows = [{r["o_orderkey"]: list(r.asDict().values()) for r in fused_transform(f.pipeline, f.source).collect()}
            for f in (copied, derived)]
    assert rows[0].keys() == rows[1].keys()
    for key, values in rows[0].items():
        np.testing.assert_allclose(rows[1][key], values, rtol=1e-9, atol=1e-12)
