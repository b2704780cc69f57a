"""CSV folders, numbers in text, number texts, staged training input, malformed stream lines."""

import json

import pytest
from pyspark.sql import functions as F

from keelson.functions.exprs import double_text, format_fixed, is_not_number, text_number
from keelson.operators.stages import TypeCaster
from keelson.sources.files import src_csv
from keelson.spec import DatasetSpec, Feature

SPEC = DatasetSpec("pid", "cost", (Feature("height", "NUMERIC", True, example=1.0),
                                   Feature("shade", "CATEGORICAL", True, ("red", "blue"))))


def write(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def test_files_are_matched_by_header_names(spark, tmp_path):
    write(tmp_path, "a.csv", "pid,height,shade\np1,1.5,red\np2,NA,N/A\n")
    write(tmp_path, "b.csv", "shade,extra,pid,height\nblue,7,p3,-2e1\n<NA>,8,p4,null\n,9,p5,\n")
    rows = {r.pid: r for r in src_csv(spark, str(tmp_path), SPEC, is_train=False).collect()}
    assert [(rows[p].height, rows[p].shade) for p in sorted(rows)] == \
        [(1.5, "red"), (None, None), (-20.0, "blue"), (None, None), (None, None)]
    assert rows["p1"].extra is None and rows["p4"].extra == "8"
    kept = src_csv(spark, str(tmp_path), SPEC, is_train=False, null_values=()).where("pid = 'p2'")
    with pytest.raises(Exception, match="not a number"):
        kept.collect()


def test_empty_folder_and_missing_folder(spark, tmp_path):
    assert src_csv(spark, str(tmp_path), SPEC, is_train=True).count() == 0
    with pytest.raises(FileNotFoundError):
        src_csv(spark, f"{tmp_path}/none", SPEC)


NUMBERS = {"1": 1.0, " -2.5e3 ": -2500.0, ".5": 0.5, "5.": 5.0, "+1E+2": 100.0, "inf": float("inf"), "-Infinity": float("-inf"),
           "12f": None, "1d": None, "0x1p3": None, "NA": None, "1,000": None, "": None, "1e": None, "--1": None}


def test_numbers_in_text(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS] + [(None,)], "t string")
    for r in df.select("t", text_number(F.col("t")).alias("v"), is_not_number(F.col("t")).alias("bad")).collect():
        assert (r.v, r.bad) == ((NUMBERS[r.t], NUMBERS[r.t] is None) if r.t is not None else (None, False)), r
    assert spark.range(1).select(F.isnan(text_number(F.lit("NaN")))).first()[0]


DOUBLES = [0.0, -0.0, 1.0, -1.5, 0.1, 0.001, 0.0001, 0.00012345, 0.00001, 1e-7, 1.5e-10, 123456.789, 9999999.0, 1e7, 12345678.5, 1.25e15,
           123456789012345.6, 1e15, 9007199254740993.0, 1e16, 1.5e16, 1.2345e20, 1e22, 1.5e300, 2.5e-300, -3e9, -1e-5,
           float("inf"), float("-inf")]


def test_doubles_are_written_as_python_writes_them(spark):
    df = spark.createDataFrame([(x,) for x in DOUBLES], "x double")
    got = {r.x: r.t for r in df.select("x", double_text(F.col("x")).alias("t")).collect()}
    assert all(got[x] == str(x) for x in DOUBLES if x != 0), {x: (got[x], str(x)) for x in DOUBLES if got[x] != str(x)}
    # the column path and the SQL text path agree
    stage = TypeCaster(inputCols=["x"], castType="string")
    from keelson.operators.base import select_stages
    assert [tuple(r) for r in stage.transform(df).collect()] == [tuple(r) for r in select_stages(df, [stage]).collect()]


def test_whole_numbers_keep_all_digits(spark):
    df = spark.createDataFrame([("9007199254740993", 3e9), ("-12", 2.9)], "t string, d double")
    out = TypeCaster(inputCols=["t", "d"], castType="int").transform(df).collect()
    assert [tuple(r) for r in out] == [(9007199254740993, 3000000000), (-12, 2)]


def test_four_decimals_of_large_values(spark):
    xs = [4503599627370.49951171875, 8796093022208.0625, 1e15 + 0.375, 9007199254740993.0, 123456789012.34565, 4.6e18, -70368744177664.015625]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert {r.x: r.t for r in df.select("x", format_fixed("x", 4).alias("t")).collect()} == {x: "%.4f" % x for x in xs}


def test_train_reads_its_input_once(spark, tmp_path):
    """The scan of the input is behind one write; everything later reads Parquet of its own."""
    from keelson.plans.workflow import train
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    df = spark.range(400).selectExpr("id AS pid", "cast(id % 37 AS double) AS height",
                                     "if(id % 3 = 0, 'red', 'blue') AS shade", "cast(id % 11 AS double) AS cost")
    res = train(df.mapInArrow(counted, df.schema), SPEC, hyperparameters={"alpha": 0.1}, max_iter=5)
    assert n.value == 400 and res.preprocess.n_rows + res.validation.count() == 400


def test_a_target_that_is_no_number_is_refused(spark):
    from keelson.operators.validate import ValidationError
    from keelson.plans.workflow import train
    df = spark.createDataFrame([(i, float(i), "red", "x" if i == 3 else str(i)) for i in range(30)],
                               "pid int, height double, shade string, cost string")
    with pytest.raises(ValidationError, match="cost"):
        train(df, SPEC)


def test_quarantine_agrees_with_violations(spark):
    import datetime

    from keelson.operators.validate import quarantine, violations
    df = spark.createDataFrame([(i, datetime.date(2024, 1, 1) if i % 2 else None, "red" if i % 3 else "grey", "1" if i else "x")
                                for i in range(9)], "pid int, height date, shade string, cost string")
    switches = dict(check_categories=True, check_target=True)
    counts = {(r["rule"], r["column"]): r.n_violations for r in violations(df, SPEC, **switches).collect()}
    listed: dict = {}
    for r in quarantine(df, SPEC, **switches).collect():
        for reason in r.reasons:
            key = tuple(reason.split(":"))
            listed[key] = listed.get(key, 0) + 1
    assert listed == counts == {("numeric", "height"): 4, ("category", "shade"): 3, ("target_numeric", "cost"): 1}


def test_duplicate_groups_are_split_when_signatures_collide(spark):
    from keelson.operators.selection import duplicate_groups
    df = spark.createDataFrame([(1, 1, 2, 2, 1), (2, 2, 1, 1, 2)], "a int, b int, c int, d int, e int")
    same = dict(type="int", fp=0, n=2, nn=2, min=1, max=2)
    assert duplicate_groups(df, list("abcde"), dict.fromkeys("abcde", same)) == [["a", "b", "e"], ["c", "d"]]


@pytest.mark.parametrize("missing", ["include", "ignore"])
def test_quasi_constants_without_a_shuffle_of_all_values(spark, missing):
    from keelson.operators.selection import DropConstant
    df = spark.range(1000).selectExpr("id", "if(id % 10 < 9, 'x', cast(id AS string)) AS most", "id % 2 AS half",
                                      "if(id % 100 < 92, NULL, id) AS empty", "id AS every")
    m = DropConstant(excludeCols=["id"], tol=0.9, missingValues=missing).fit(df)
    assert m.v("dropCols") == (["most", "empty"] if missing == "include" else ["most"])


def test_malformed_lines_get_an_error_response(spark, tmp_path):
    from keelson.plans import catalog as C
    from keelson.streaming import score_stream
    from conftest import SF_SMALL
    _, bundle = C._literal_bundle(spark, SF_SMALL)
    spec = C.events_spec()
    instance = {"event_id": "1", "value": 1.0, "k": 2.0, "k_copy": 2.0, "one": 1.0, "click_score": 0.1,
                "event_type": "view", "parity": "odd"}
    good = "r1\t" + json.dumps({"instances": [instance]})
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "lines.txt", "\n".join([good, good, "no separator", "r2\t{", "r3\t{}", ""]) + "\n")
    q = score_stream(spark, f"{tmp_path}/in", spec, bundle, f"{tmp_path}/out", f"{tmp_path}/ckpt", id_separator="\t")
    assert q.awaitTermination(120)
    rows = spark.read.schema("requestId string, json string, status string").json(f"{tmp_path}/out").collect()
    assert sorted(r.status for r in rows) == ["error"] * 4 + ["success"] * 2


def _bundle():
    from pyspark.ml import PipelineModel
    from keelson.operators.model import HuberPredictorModel
    from keelson.plans.workflow import TargetUnscaleModel
    return PipelineModel([HuberPredictorModel(featureCols=["height"], coefficients=[2.0], intercept=1.0),
                          TargetUnscaleModel(col="prediction", mean=10.0, std=3.0)])


def test_scoring_reads_its_input_once(spark, tmp_path):
    """Rules, emptiness, the ID check, the write and a later action cost one read."""
    from keelson.plans.workflow import score_batch
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    df = spark.range(500).selectExpr("id AS pid", "cast(id % 37 AS double) AS height", "if(id % 3 = 0, 'red', 'blue') AS shade")
    out = score_batch(df.mapInArrow(counted, df.schema), SPEC, _bundle(), output_dir=f"{tmp_path}/out")
    assert {r.pid: r.prediction for r in out.collect()} == {i: (2.0 * (i % 37) + 1) * 3 + 10 for i in range(500)}
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 500
    assert n.value == 500


@pytest.mark.parametrize("broken", ["null", "repeated id", "empty", "text", "both"])
def test_violations_are_named_and_nothing_is_written(spark, tmp_path, broken):
    import os

    from keelson.operators.validate import ValidationError
    from keelson.plans.workflow import score_batch
    rows = [(i, f"{i % 7}.5", "red") for i in range(20)]
    if broken in ("repeated id", "both"):
        rows[4] = (3, "1.5", "red")
    if broken in ("null", "both"):
        rows[9] = (9, None, "red")
    if broken == "text":
        rows[9] = (9, "tall", "red")
    if broken == "empty":
        rows = []
    df = spark.createDataFrame(rows, "pid int, height string, shade string")
    from keelson.operators.stages import TypeCaster
    from pyspark.ml import PipelineModel
    bundle = PipelineModel([TypeCaster(inputCols=["height"], castType="double"), *_bundle().stages])
    want = {"null": "null values", "repeated id": "pid", "empty": "empty", "text": "non-numeric", "both": "pid"}[broken]
    spec = DatasetSpec("pid", "cost", (Feature("height", "NUMERIC", False, example=1.0), SPEC.features[1]))
    with pytest.raises(ValidationError, match=want):
        score_batch(df, spec, bundle, output_dir=f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")


def test_types_follow_from_all_values(spark, tmp_path):
    """Columns in other orders, missing texts, a column that one file lacks: the same with and without a description."""
    write(tmp_path, "a.csv", "pid,height,shade,flag,big,none,late\np1,1,red,true,9223372036854775807,,7\np2,NA,n/a,False,1,,8\n")
    write(tmp_path, "b.csv", "shade,none,pid,big,flag,height\nblue,,p3,99999999999999999999,TRUE,2.5\n,null,p4,2,,-3e2\n")
    got = src_csv(spark, str(tmp_path))
    kinds = dict(got.dtypes)
    assert kinds == {"pid": "string", "height": "double", "shade": "string", "flag": "boolean", "big": "double",
                     "none": "double", "late": "bigint"}
    rows = {r.pid: r for r in got.collect()}
    assert [rows[f"p{i}"].height for i in range(1, 5)] == [1.0, None, 2.5, -300.0]
    assert [rows[f"p{i}"].flag for i in range(1, 5)] == [True, False, True, None]
    assert [rows[f"p{i}"].late for i in range(1, 5)] == [7, 8, None, None]
    described = {r.pid: (r.height, r.shade) for r in src_csv(spark, str(tmp_path), SPEC, is_train=False).collect()}
    assert described == {p: (r.height, r.shade) for p, r in rows.items()}


def test_type_lattice():
    from keelson.sources.files import BOOLEAN, REAL, TEXT, WHOLE, joined_type
    name = lambda bits: joined_type(bits).simpleString()
    assert [name(b) for b in (0, WHOLE, REAL, WHOLE | REAL, BOOLEAN)] == ["double", "bigint", "double", "double", "boolean"]
    assert {name(b) for b in (TEXT, TEXT | WHOLE, BOOLEAN | WHOLE, BOOLEAN | REAL, TEXT | BOOLEAN | WHOLE | REAL)} == {"string"}
