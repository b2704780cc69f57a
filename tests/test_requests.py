"""Scoring requests: checks per request, responses, and the streaming form."""

import json
import os

from pyspark.ml import PipelineModel


from keelson.operators.model import HuberPredictorModel
from keelson.operators.stages import MeanMedianImputer, OneHotEncoder
from keelson.sources.requests import explode_instances, parse_requests, score_requests
from keelson.spec import DatasetSpec, Feature
from keelson.streaming import score_stream

SPEC = DatasetSpec("id", "target", (Feature("number", "NUMERIC", True, example=0.2),
                                    Feature("color", "CATEGORICAL", True, ("Blue", "Green", "Red"))),
                   target_description="Target variable")

REQUESTS = {
    "good": {"instances": [{"id": "a", "number": 1.0, "color": "Red"}, {"id": "b", "number": None, "color": "Blue"}]},
    "nulls": {"instances": [{"id": "c", "number": None, "color": None}]},
    "unknown": {"instances": [{"id": "d", "number": 1.0, "color": "Purple"}]},
    "empty": {"instances": []},
    "nokey": {"instances": [{"id": "e", "color": "Red"}]},
    "noinst": {"rows": [{"id": "f"}]},
    "wrongtype": {"instances": [{"id": "g", "number": "abc", "color": "Red"}]},
    "dupid": {"instances": [{"id": "h", "number": 1.0, "color": "Red"}, {"id": "h", "number": 2.0, "color": "Red"}]},
    "notlist": {"instances": {"id": "i"}},
    "coerced": {"instances": [{"id": 42, "number": "1.0", "color": "Red"}]},
}


def bundle(spark):
    train = spark.createDataFrame([(1.0, "Red"), (3.0, "Blue"), (None, "Red"), (5.0, "Green")],
                                  "number double, color string")
    imp = MeanMedianImputer(inputCols=["number"]).fit(train)
    ohe = OneHotEncoder(inputCols=["color"]).fit(train)
    model = HuberPredictorModel(featureCols=["number", "color_Red", "color_Blue"], coefficients=[2.0, 10.0, 20.0],
                                intercept=1.0)
    return PipelineModel([imp, ohe, model])


def request_frame(spark, extra=None):
    docs = [(k, json.dumps(v)) for k, v in REQUESTS.items()] + [("notjson", "{not json")]
    return spark.createDataFrame(docs, "requestId string, value string")


def test_request_statuses_and_predictions(spark):
    parsed = parse_requests(request_frame(spark), SPEC, "value", "requestId")
    out = {r.requestId: r.response for r in score_requests(parsed, SPEC, bundle(spark).stages).collect()}
    assert out["good"].status == "success" and out["nulls"].status == "success"
    preds = {p.sampleId: p.prediction for p in out["good"].predictions}
    assert preds == {"a": 2.0 + 10.0 + 1.0, "b": 2.0 * 3.0 + 20.0 + 1.0}  # b: number imputed with mean 3
    assert out["nulls"].predictions[0].prediction == 7.0
    for bad in ("unknown", "empty", "nokey", "noinst", "wrongtype", "dupid", "notjson", "notlist"):
        assert out[bad].status == "error" and out[bad].predictions is None, bad
    assert "Purple" in out["unknown"].message
    assert out["nokey"].message.endswith("number")
    assert out["wrongtype"].message.endswith("not a valid float: number")
    assert out["notjson"].message == "Invalid request: body is not JSON"
    assert out["noinst"].message == "instances: field required"
    assert out["notlist"].message == "instances: value is not a valid list of objects"
    # numbers given as text and numeric IDs are coerced, as the reference's request model does
    assert out["coerced"].status == "success"
    assert [(p.sampleId, p.prediction) for p in out["coerced"].predictions] == [("42", 13.0)]
    assert out["good"].targetDescription == "Target variable"


def test_response_json_keeps_null_predictions(spark):
    parsed = parse_requests(request_frame(spark), SPEC, "value", "requestId").where("requestId = 'empty'")
    doc = json.loads(score_requests(parsed, SPEC, bundle(spark).stages).first().json)
    assert doc["predictions"] is None and doc["status"] == "error"
    assert set(doc) == {"status", "message", "timestamp", "requestId", "targetDescription", "predictions"}


def test_explode_instances(spark):
    parsed = parse_requests(request_frame(spark), SPEC, "value", "requestId").where("requestId = 'good'")
    rows = [tuple(r) for r in explode_instances(parsed, SPEC).orderBy("pos").collect()]
    assert rows == [("good", 0, "a", 1.0, "Red"), ("good", 1, "b", None, "Blue")]


def test_stream_available_now(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "part-0.txt"), "w") as fh:
        for k, v in REQUESTS.items():
            fh.write(f"{k}\t{json.dumps(v)}\n")
    q = score_stream(spark, src, SPEC, bundle(spark), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"),
                     id_separator="\t")
    q.awaitTermination()
    out = spark.read.json(os.path.join(tmp_dir, "out"))
    st = {r.requestId: r.status for r in out.collect()}
    assert st["good"] == "success" and st["dupid"] == "error" and len(st) == len(REQUESTS)
    # plan: one stateless projection, no shuffle, no Python UDF
    # (checked on the batch read of the same files: the streaming plan is the same projection)
    lines = spark.read.text(src)
    plan = score_requests(parse_requests(lines, SPEC), SPEC, bundle(spark).stages)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text and "Exchange" not in text and "Python" not in text


def test_stream_restart_processes_only_new_files(spark, tmp_dir):
    """A restarted query with the same checkpoint skips what it already answered."""
    src, out, ck = (os.path.join(tmp_dir, d) for d in ("in", "out", "ck"))
    os.makedirs(src)
    good = json.dumps(REQUESTS["good"])
    with open(os.path.join(src, "a.txt"), "w") as fh:
        fh.write(f"r1\t{good}\nr2\t{good}\n")
    score_stream(spark, src, SPEC, bundle(spark), out, ck, id_separator="\t").awaitTermination()
    with open(os.path.join(src, "b.txt"), "w") as fh:
        fh.write(f"r3\t{good}\n")
    score_stream(spark, src, SPEC, bundle(spark), out, ck, id_separator="\t").awaitTermination()
    ids = sorted(r.requestId for r in spark.read.json(out).collect())
    assert ids == ["r1", "r2", "r3"]


def test_stream_in_bounded_micro_batches(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, d) for d in ("in", "out", "ck"))
    os.makedirs(src)
    good = json.dumps(REQUESTS["good"])
    for k in range(3):
        with open(os.path.join(src, f"f{k}.txt"), "w") as fh:
            fh.write(f"r{k}\t{good}\n")
    q = score_stream(spark, src, SPEC, bundle(spark), out, ck, id_separator="\t", max_files_per_trigger=1)
    q.awaitTermination()
    assert q.lastProgress is not None and len(q.recentProgress) >= 3
    assert sorted(r.requestId for r in spark.read.json(out).collect()) == ["r0", "r1", "r2"]


def test_kafka_source_needs_the_connector(spark, tmp_dir):
    """The Kafka path builds the same projection; without the connector jar (as in
    this image) Spark reports the missing data source when the query starts."""
    import pytest
    with pytest.raises(Exception, match="(?i)kafka"):
        score_stream(spark, None, SPEC, bundle(spark), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"),
                     kafka_options={"kafka.bootstrap.servers": "localhost:9", "subscribe": "requests"})


def test_category_tables_equal_literal_lists(spark):
    """Probing a table gives the verdicts of the list in the spec; nulls, repeats, empty requests and hot values included."""
    from keelson.sources.requests import parse_requests, request_checks, with_category_misses
    from keelson.spec import DatasetSpec, Feature
    spec = DatasetSpec("id", "y", (Feature("shade", "CATEGORICAL", True, ("red", "blue")),
                                   Feature("size", "CATEGORICAL", True, ("s", "m"))))
    one = lambda i, shade, size: {"id": str(i), "shade": shade, "size": size}
    docs = [[one(1, "red", "s"), one(2, "grey", "xl"), one(3, "pink", "m")], [one(1, None, "m")], [], [one(1, "blue", None)],
            [one(i, "red" if i else "teal", "s") for i in range(300)], [one(1, "red", "zz"), one(2, "blue", "yy")]]
    import json
    df = spark.createDataFrame([(str(i), json.dumps({"instances": d})) for i, d in enumerate(docs)] + [("bad", "no json")],
                               "requestId string, value string")
    parsed = parse_requests(df, spec, "value", "requestId")
    ok, message = request_checks(spec)
    want = {r[0]: (r[1], (r[2] or "").split(".Allowed")[0]) for r in parsed.select("requestId", ok, message).collect()}
    allowed = spark.createDataFrame([("shade", "red"), ("shade", "blue"), ("size", "s"), ("size", "m")], "feature string, value string")
    probed = with_category_misses(parsed, allowed)
    ok, message = request_checks(spec, table_features=("shade", "size"))
    got = {r[0]: (r[1], (r[2] or "").split(".Allowed")[0]) for r in probed.select("requestId", ok, message).collect()}
    assert got == want and sum(not v[0] for v in got.values()) == 5
