"""Single operators on small frames whose results are worked out by hand."""

import pytest

from pyspark.sql import functions as F

from keelson.operators.stages import (
    CategoricalImputer, ColumnOrder, ColumnSelector, DropAllNull, MeanMedianImputer, MissingIndicator,
    MostFrequentImputer, OneHotEncoder, RareLabelEncoder, StandardScaler, TargetScaler, TypeCaster,
    ValueClipper,
)


def rows(df, cols=None):
    return [tuple(r) for r in df.select(*(cols or df.columns)).orderBy(df.columns[0]).collect()]


def test_column_selector_keep_and_drop(spark):
    df = spark.createDataFrame([("k1", 0.5, True, 9)], "sku string, weight double, fragile boolean, stock int")
    keep = ColumnSelector(columns=["stock", "weight", "not there"], passthrough=["sku"])
    assert keep.transform(df).columns == ["sku", "weight", "stock"]
    drop = ColumnSelector(columns=["sku", "stock", "fragile"], selectorType="drop", passthrough=["sku"])
    assert drop.transform(df).columns == ["sku", "weight"]
    with pytest.raises(AssertionError):
        ColumnSelector(columns=["sku"], selectorType="sideways").transform(df)


def test_cast_int_and_str(spark):
    df = spark.createDataFrame([("-17", 250.0, 0.25)], "depth string, load double, ratio double")
    assert rows(TypeCaster(inputCols=["depth", "load"], castType="int").transform(df)) == [(-17, 250, 0.25)]
    assert rows(TypeCaster(inputCols=["load", "ratio"], castType="string").transform(df)) == [("-17", "250.0", "0.25")]


def test_cast_str_booleans_and_nulls(spark):
    df = spark.createDataFrame([(True, None), (False, "x")], "b boolean, s string")
    out = TypeCaster(inputCols=["b", "s"], castType="string", nullsAsLabel=True).transform(df)
    assert sorted(rows(out)) == [("False", "x"), ("True", "nan")]


def test_cast_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "A string, B int")
    out = TypeCaster(inputCols=["A"], castType="int").transform(df)
    assert [r.A for r in out.collect()] == [None, None]


def test_cast_float_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,)], "x double")
    out = TypeCaster(inputCols=["x"], castType="double").transform(df)
    assert sorted([r.x for r in out.collect()], key=lambda v: (v is not None, v)) == [None, 1.5]


def test_clip_both_and_one_sided(spark):
    df = spark.createDataFrame([("a", -30.0, 4), ("b", 0.5, 18), ("c", 77.0, -6)], "k string, temp double, level int")
    def clipped(**bounds):
        return rows(ValueClipper(inputCols=["temp", "level", "absent"], **bounds).transform(df))
    assert clipped(lower=-10.0, upper=15.0) == [("a", -10.0, 4.0), ("b", 0.5, 15.0), ("c", 15.0, -6.0)]
    assert clipped(lower=0.0) == [("a", 0.0, 4.0), ("b", 0.5, 18.0), ("c", 77.0, 0.0)]
    assert clipped(upper=0.0) == [("a", -30.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, -6.0)]
    assert clipped() == rows(df)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1, None), (2, 10.0)], "i int, x double")
    out = ValueClipper(inputCols=["x"], lower=-4.0, upper=4.0).transform(df)
    assert rows(out) == [(1, None), (2, 4.0)]


def test_mode_impute_threshold(spark):
    """1 of 5 missing is below a threshold of 0.3, 2 of 5 is not."""
    df = spark.createDataFrame([(1, "oak", None), (2, None, "wet"), (3, "elm", "wet"), (4, "oak", None), (5, "oak", "dry")],
                               "plot int, tree string, soil string")
    out = MostFrequentImputer(inputCols=["tree", "soil"], threshold=0.3).fit(df).transform(df)
    assert rows(out) == [(1, "oak", None), (2, "oak", "wet"), (3, "elm", "wet"), (4, "oak", None), (5, "oak", "dry")]


def test_mode_ties_smallest_label(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "i int, c string")
    m = MostFrequentImputer(inputCols=["c"], threshold=0.5).fit(df)
    assert m.fills() == {"c": "a"}


def test_missing_tag(spark):
    df = spark.createDataFrame([(1, "n", None), (2, None, None), (3, None, "s")], "i int, lane string, side string")
    out = CategoricalImputer(inputCols=["lane", "side"], fillValue="?").fit(df).transform(df)
    assert rows(out) == [(1, "n", "?"), (2, "?", "?"), (3, "?", "s")]


def test_one_hot_counts_by_cap(spark):
    """Column i has i + 2 labels, so a cap of k gives min(k, i + 1) columns for it (at least one)."""
    df = spark.createDataFrame([tuple(f"v{j % (i + 2)}" for i in range(4)) for j in range(60)],
                               "two string, three string, four string, five string")
    for cap in (1, 2, 3, 9):
        m = OneHotEncoder(inputCols=df.columns, maxCategories=cap).fit(df)
        assert [len(c) for c in m.v("categories")] == [min(cap, i + 1) for i in range(4)]
        assert len(m.transform(df).columns) == sum(min(cap, i + 1) for i in range(4))


def test_one_hot_single_category_and_missing_column(spark):
    df = spark.createDataFrame([("a",), ("a",)], "c string")
    m = OneHotEncoder(inputCols=["c"]).fit(df)
    assert m.transform(df).columns == ["c_a"]
    with pytest.raises(ValueError):
        m.transform(df.withColumnRenamed("c", "d"))


def test_one_hot_null_and_unknown_are_zero(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "c string")
    m = OneHotEncoder(inputCols=["c"]).fit(df)
    assert m.v("categories") == [["a", "b"]]
    new = spark.createDataFrame([("zz",), (None,), ("b",)], "c string")
    assert sorted(tuple(r) for r in m.transform(new).collect()) == [(0, 0), (0, 0), (0, 1)]


def test_rare_label(spark):
    """Shares 0.55, 0.25, 0.15 and 0.05 at a tolerance of 0.15: the last label only is rare."""
    labels = ["bus"] * 11 + ["tram"] * 5 + ["ferry"] * 3 + ["gondola"]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, ride string")
    m = RareLabelEncoder(inputCols=["ride"], tol=0.15, nCategories=2).fit(df)
    assert m.v("keep") == [["bus", "ferry", "tram"]]
    assert {r.ride for r in m.transform(df).collect()} == {"bus", "ferry", "tram", "Rare"}
    # no more labels than nCategories: all seen labels stay, whatever their share
    assert RareLabelEncoder(inputCols=["ride"], tol=0.9, nCategories=4).fit(df).v("keep") == [sorted(set(labels))]


@pytest.mark.parametrize("others", [1, 40])
def test_rare_label_exactly_at_the_tolerance(spark, others):
    """7 of 100 rows at 0.07 is kept, however many labels share the rest."""
    labels = ["edge"] * 7 + [f"o{i % others}" for i in range(93)]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, c string")
    keep = RareLabelEncoder(inputCols=["c"], tol=0.07, nCategories=1).fit(df).v("keep")[0]
    assert "edge" in keep and len(keep) == (2 if others == 1 else 1)


def test_rare_label_with_zero_tolerance(spark):
    """Every seen label stays; an unseen one is rare."""
    df = spark.createDataFrame([(i, f"v{i}") for i in range(500)], "i int, c string")
    m = RareLabelEncoder(inputCols=["c"], tol=0.0, nCategories=1).fit(df)
    assert m.transform(df).where("c = 'Rare'").count() == 0
    assert m.transform(spark.createDataFrame([(1, "new")], "i int, c string")).first().c == "Rare"


def test_mean_median_indicator_scaler(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0), (4, None), (5, 50.0)], "i int, x double")
    assert MissingIndicator(inputCols=["x"]).fit(df).transform(df).columns == ["i", "x", "x_na"]
    assert MeanMedianImputer(inputCols=["x"]).fit(df).fills() == {"x": 30.0}
    med = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 10.0), (4, 20.0)], "i int, x double")
    assert MeanMedianImputer(inputCols=["x"], method="median").fit(med).fills() == {"x": 6.0}
    sc = StandardScaler(inputCols=["x"]).fit(med)
    assert sc.v("means") == [8.25]
    import numpy as np
    assert abs(sc.v("stds")[0] - float(np.std([1.0, 2.0, 10.0, 20.0]))) < 1e-12  # population std
    const = spark.createDataFrame([(1, 3.0), (2, 3.0)], "i int, x double")
    assert [r.x for r in StandardScaler(inputCols=["x"]).fit(const).transform(const).collect()] == [0.0, 0.0]


def test_target_scale_round_trip(spark):
    df = spark.createDataFrame([(i, 3.0 * i - 40) for i in range(9)], "i int, price double")
    m = TargetScaler(targetCol="price").fit(df)
    back = m.transform(df).select("i", m.inverse("price", F.col("price")).alias("price"))
    assert [round(r.price, 6) for r in back.orderBy("i").collect()] == [3.0 * i - 40 for i in range(9)]
    with pytest.raises(ValueError):
        TargetScaler(targetCol="cost").fit(df)


def test_drop_all_null_and_error(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0)], "i int, a double, b double")
    m = DropAllNull(inputCols=["a", "b"]).fit(df)
    assert m.transform(df).columns == ["i", "b"]
    allnull = spark.createDataFrame([(1, None)], "i int, a double")
    with pytest.raises(ValueError, match="All features in the input dataframe are NaN"):
        DropAllNull(inputCols=["a"]).fit(allnull).transform(allnull)


def test_column_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, b int, a int")
    m = ColumnOrder(passthrough=["id"]).fit(df)
    assert m.transform(df).columns == ["id", "a", "b"]
    with pytest.raises(KeyError):
        m.transform(df.drop("a"))


def test_stage_persistence(spark, tmp_dir):
    from pyspark.ml import PipelineModel
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "a", 3.0)], "i int, c string, x double")
    pm = PipelineModel([MeanMedianImputer(inputCols=["x"]).fit(df), OneHotEncoder(inputCols=["c"]).fit(df)])
    pm.write().overwrite().save(tmp_dir + "/pm")
    again = PipelineModel.load(tmp_dir + "/pm")
    assert rows(pm.transform(df)) == rows(again.transform(df))
