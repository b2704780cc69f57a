"""Registered checks: one Spark query per operator of SURVEY §2, and the
DuckDB SQL that computes the same result from the same tables.

The test tables hold no nulls, rare labels, duplicate or constant columns, so
each query derives them *by rule* from the rows (``event_id % 17`` -> NULL,
and so on); the SQL applies the same rules.  Every query reads whole tables.
Doubles are rounded to 6 decimals on both sides (``+ 0.0`` folds -0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.exprs import one_hot_name
from keelson.functions.hashing import hash_uniform, hash_uniform_sql
from keelson.session import spread
from keelson.spec import DatasetSpec, Feature

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
STREAM_TIMEOUT_S = 900


# ----------------------------------------------------------------------------
# shared inputs
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals and fold -0.0 to 0.0."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def events_frame(spark: SparkSession, sf_dir: str, raw_value: bool = False) -> DataFrame:
    """``events`` with rule-made nulls, copies, a constant, rare labels and a target
    (``raw_value=True`` also keeps the untouched ``value`` as ``raw_value``)."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    et = F.when(eid % 29 == 0, F.lit(None)).otherwise(F.col("event_type"))
    k = _k()
    noise = (hash_uniform(eid, 7) - F.lit(0.5)) * F.lit(2.0)
    return ev.select(
        eid,
        F.when(eid % 17 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
        k.alias("k"),
        k.alias("k_copy"),
        F.lit(1.0).alias("one"),
        (F.when(et == "click", F.lit(1.0)).otherwise(F.lit(0.0)) + (eid % 7) * F.lit(0.001)).alias("click_score"),
        et.alias("event_type"),
        F.when(eid % 200 == 0, F.lit("zz")).when(eid % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("parity"),
        (F.lit(3.0) * k - F.lit(0.5) * F.col("value") + noise
         + F.when(eid % 10 == 0, F.lit(400.0)).otherwise(F.lit(0.0))).alias("target"),
        *([F.col("value").alias("raw_value")] if raw_value else []),
    )


EV_SQL = f"""ev AS (
  SELECT event_id,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_copy,
         1.0::DOUBLE AS one,
         CAST(CASE WHEN (CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END) = 'click' THEN 1.0 ELSE 0.0 END
           + (event_id % 7) * 0.001 AS DOUBLE) AS click_score,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 200 = 0 THEN 'zz' WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
         3.0 * CAST(json_extract_string(props, '$.k') AS DOUBLE) - 0.5 * value
           + ({hash_uniform_sql('event_id', '7')} - 0.5) * 2.0
           + CASE WHEN event_id % 10 = 0 THEN 400.0 ELSE 0.0 END AS target
  FROM events)"""


def events_spec(with_target: bool = True) -> DatasetSpec:
    return DatasetSpec(
        "event_id", "target",
        (Feature("value", "NUMERIC", True, example=1.0), Feature("k", "NUMERIC", example=1.0),
         Feature("k_copy", "NUMERIC", example=1.0), Feature("one", "NUMERIC", example=1.0),
         Feature("click_score", "NUMERIC", example=1.0),
         Feature("event_type", "CATEGORICAL", True, tuple(EVENT_TYPES)),
         Feature("parity", "CATEGORICAL", False, ("even", "odd", "zz"))),
        target_description="synthetic target from events", id_type=T.LongType())


def request_spec() -> DatasetSpec:
    return DatasetSpec(
        "event_id", "target",
        (Feature("value", "NUMERIC", True, example=1.0), Feature("k", "NUMERIC", False, example=1.0),
         Feature("event_type", "CATEGORICAL", True, tuple(EVENT_TYPES))),
        target_description="synthetic target from events")


CHECKS: dict = {}


def check(name: str, sql: str | None):
    def deco(fn):
        CHECKS[name] = (fn, sql)
        return fn
    return deco


def _fit_preprocess(spark, sf_dir):
    from keelson.plans.preprocess import Preprocessor
    df = events_frame(spark, sf_dir)
    return df, Preprocessor(events_spec()).fit(df)


# ----------------------------------------------------------------------------
# 2.1 sources and sinks
@check("src_csv", """WITH """ + EV_SQL + """
SELECT event_id, value, event_type, parity FROM ev""")
def q_src_csv(spark, sf_dir):
    from keelson.session import scratch_dir
    from keelson.sources.files import src_csv
    path = scratch_dir(spark, "src_csv")
    df = events_frame(spark, sf_dir).select("event_id", "value", "event_type", "parity")
    # two kinds of files in one folder: other column orders, other spellings of a missing value
    odd = F.col("event_id") % 2 == 1
    df.where(~odd).write.option("header", True).csv(path)
    df.where(odd).select("parity", F.coalesce("event_type", F.lit("NA")).alias("event_type"),
                         F.coalesce(F.col("value").cast("string"), F.lit("#N/A")).alias("value"), "event_id") \
        .write.mode("append").option("header", True).csv(path)
    spec = DatasetSpec("event_id", "target", (Feature("value", "NUMERIC", True, example=1.0),
                                              Feature("event_type", "CATEGORICAL", True, tuple(EVENT_TYPES)),
                                              Feature("parity", "CATEGORICAL", False, ("even", "odd", "zz"))),
                       id_type=T.LongType())
    return src_csv(spark, path, spec, is_train=False)


@check("src_csv_inferred", """WITH """ + EV_SQL + """
SELECT event_id, value, event_type, event_id % 2 = 0 AS even, event_id // 10 AS tens,
       CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE parity END AS mixed FROM ev""")
def q_src_csv_inferred(spark, sf_dir):
    """No description: files with columns in different orders and different texts for missing values."""
    from keelson.session import scratch_dir
    from keelson.sources.files import src_csv
    eid = F.col("event_id")
    df = events_frame(spark, sf_dir).select(
        "event_id", "value", "event_type", (eid % 2 == 0).alias("even"), F.expr("event_id div 10").alias("tens"),
        F.when(eid % 3 == 0, eid.cast("string")).otherwise(F.col("parity")).alias("mixed"))
    path = scratch_dir(spark, "src_csv_inferred")
    df.where(eid % 2 == 0).write.option("header", True).option("nullValue", "NA").csv(path)
    df.where(eid % 2 != 0).select(*reversed(df.columns)).write.mode("append").option("header", True) \
        .option("nullValue", "n/a").csv(path)
    return src_csv(spark, path)


@check("sink_csv", """WITH """ + EV_SQL + """
SELECT event_id, printf('%.4f', value) AS value, printf('%.4f', k / 16.0) AS k16,
       printf('%.4f', k / 32.0) AS k32, printf('%.4f', value / 7.0) AS v7, event_type FROM ev""")
def q_sink_csv(spark, sf_dir):
    from keelson.session import scratch_dir
    from keelson.sources.files import sink_csv
    path = scratch_dir(spark, "sink_csv")
    # k / 32 has exact binary ties at the 5th decimal: rounded to even, as '%.4f' does
    sink_csv(events_frame(spark, sf_dir).select("event_id", "value", (F.col("k") / 16.0).alias("k16"),
                                                (F.col("k") / 32.0).alias("k32"), (F.col("value") / 7.0).alias("v7"),
                                                "event_type"), path)
    schema = "event_id bigint, value string, k16 string, k32 string, v7 string, event_type string"
    return spark.read.option("header", True).schema(schema).csv(path)


def _requests(spark, sf_dir, per_request: int = 50):
    from keelson.sources.requests import requests_from_table
    df = events_frame(spark, sf_dir).select("event_id", "value", "k", "event_type")
    return requests_from_table(df, request_spec(), F.expr(f"event_id div {per_request}"))


@check("src_requests", """WITH """ + EV_SQL + """
SELECT CAST(event_id // 50 AS VARCHAR) AS requestId,
       row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS pos,
       CAST(event_id AS VARCHAR) AS event_id, value, k, event_type FROM ev""")
def q_src_requests(spark, sf_dir):
    from keelson.sources.requests import explode_instances, parse_requests
    parsed = parse_requests(_requests(spark, sf_dir), request_spec(), "value", "requestId")
    out = explode_instances(parsed, request_spec())
    return out.withColumn("pos", F.col("pos").cast("bigint"))


LITERAL_SQL = "(1.5 + 0.25 * value - 2.0 * k)"


def _literal_predictor():
    from keelson.operators.model import HuberPredictorModel
    return HuberPredictorModel(featureCols=["value", "k"], coefficients=[0.25, -2.0], intercept=1.5)


@check("sink_responses", """WITH """ + EV_SQL + f"""
SELECT CAST(event_id // 50 AS VARCHAR) AS requestId, 'success' AS status,
       CAST(event_id AS VARCHAR) AS sampleId, round({LITERAL_SQL}, 5) + 0.0 AS prediction FROM ev""")
def q_sink_responses(spark, sf_dir):
    from keelson.sources.requests import explode_instances, parse_requests, responses_from_predictions
    spec = request_spec()
    inst = explode_instances(parse_requests(_requests(spark, sf_dir), spec, "value", "requestId"), spec)
    pred = _literal_predictor().transform(inst)
    resp = responses_from_predictions(pred, spec)
    back = resp.select(F.from_json("json", "status string, requestId string, "
                                           "predictions array<struct<sampleId:string,prediction:double>>").alias("r"))
    return back.select(F.col("r.requestId").alias("requestId"), F.col("r.status").alias("status"),
                       F.explode("r.predictions").alias("p")) \
        .select("requestId", "status", F.col("p.sampleId").alias("sampleId"),
                (F.col("p.prediction") + F.lit(0.0)).alias("prediction"))


A15_TEMPLATE = """WITH """ + EV_SQL + """,
st AS (SELECT avg(value) AS mv, avg(k) AS mk, stddev_pop(k) AS sk,
              avg(click_score) AS mc, stddev_pop(click_score) AS sc FROM ev),
f AS (SELECT ev.*, coalesce(ev.value, st.mv) AS value_f FROM ev, st),
st2 AS (SELECT avg(value_f) AS mv2, stddev_pop(value_f) AS sv2 FROM f)
SELECT event_id,
  R(greatest(-4.0, least(4.0, (click_score - mc) / sc))) AS click_score,
  CASE WHEN coalesce(event_type, 'nan') = 'error' THEN 1 ELSE 0 END AS event_type_error,
  CASE WHEN coalesce(event_type, 'nan') = 'purchase' THEN 1 ELSE 0 END AS event_type_purchase,
  CASE WHEN coalesce(event_type, 'nan') = 'signup' THEN 1 ELSE 0 END AS event_type_signup,
  CASE WHEN coalesce(event_type, 'nan') = 'view' THEN 1 ELSE 0 END AS event_type_view,
  R(greatest(-4.0, least(4.0, (k - mk) / sk))) AS k,
  CASE WHEN parity = 'odd' THEN 1 ELSE 0 END AS parity_odd,
  R(greatest(-4.0, least(4.0, (value_f - mv2) / sv2))) AS value,
  CASE WHEN value IS NULL THEN 1 ELSE 0 END AS value_na
FROM f, st, st2"""


def _a15(rounded: bool, with_target: bool = False) -> str:
    import re
    sql = re.sub(r"R\((greatest\(-4\.0, least\(4\.0, [^;]*?\)\))\)",
                 (r"round(\1, 6) + 0.0" if rounded else r"\1"), A15_TEMPLATE)
    if with_target:
        head, tail = sql.rsplit("SELECT event_id,\n", 1)
        sql = head + "SELECT event_id, target,\n" + tail
    return sql


A15_SQL = _a15(True)


@check("artifact_pipeline", A15_SQL)
def q_artifact_pipeline(spark, sf_dir):
    from keelson.plans.preprocess import fused_transform
    from keelson.plans.workflow import load_bundle, save_bundle
    from keelson.session import scratch_dir
    df, fp = _fit_preprocess(spark, sf_dir)
    path = scratch_dir(spark, "artifact_pipeline")
    save_bundle(fp.pipeline, path)
    return r6(fused_transform(load_bundle(path), df).drop("target"))


@check("artifact_model", """WITH """ + EV_SQL + f"""
SELECT event_id, round({LITERAL_SQL}, 6) + 0.0 AS prediction FROM ev""")
def q_artifact_model(spark, sf_dir):
    """A model with given coefficients, saved, loaded and applied."""
    from keelson.operators.model import load_model, save_model
    from keelson.session import scratch_dir
    path = scratch_dir(spark, "artifact_model")
    save_model(_literal_predictor(), path)
    return r6(load_model(path).transform(events_frame(spark, sf_dir)).select("event_id", "prediction"))


# ----------------------------------------------------------------------------
# 2.2 validation
def _lineitem_spec(extra_missing: bool = False) -> DatasetSpec:
    feats = [Feature("l_quantity", "NUMERIC", False, example=1.0),
             Feature("l_extendedprice", "NUMERIC", False, example=1.0),
             Feature("l_returnflag", "CATEGORICAL", False, ("A", "N", "R"))]
    if extra_missing:
        feats.append(Feature("l_comment_score", "NUMERIC", True, example=1.0))
    return DatasetSpec("l_orderkey", "l_tax", tuple(feats), id_type=T.LongType())


@check("val_columns", """
SELECT 'feature_present' AS rule, 'l_comment_score' AS "column", CAST(1 AS BIGINT) AS n_violations
UNION ALL
SELECT 'unique_id', 'l_orderkey', CAST(sum(c - 1) AS BIGINT)
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""")
def q_val_columns(spark, sf_dir):
    from keelson.operators.validate import violations
    return violations(table(spark, sf_dir, "lineitem"), _lineitem_spec(extra_missing=True), is_train=True)


@check("val_unique_id", """
SELECT 'unique_id' AS rule, 'l_orderkey' AS "column", CAST(sum(c - 1) AS BIGINT) AS n_violations
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""")
def q_val_unique_id(spark, sf_dir):
    from keelson.operators.validate import violations
    return violations(table(spark, sf_dir, "lineitem"), _lineitem_spec(), is_train=True)


@check("val_non_null", """WITH """ + EV_SQL + """
SELECT 'non_null' AS rule, 'value' AS "column", count(*) - count(value) AS n_violations FROM ev
UNION ALL
SELECT 'non_null', 'event_type', count(*) - count(event_type) FROM ev""")
def q_val_non_null(spark, sf_dir):
    from keelson.operators.validate import violations
    spec = DatasetSpec("event_id", "target", (Feature("value", "NUMERIC", False, example=1.0),
                                              Feature("k", "NUMERIC", False, example=1.0),
                                              Feature("event_type", "CATEGORICAL", False, tuple(EVENT_TYPES))))
    return violations(events_frame(spark, sf_dir), spec, is_train=True)


@check("val_numeric", """
SELECT 'numeric' AS rule, 'value_text' AS "column",
       count(*) FILTER (WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 OR event_id % 79 = 0) AS n_violations
FROM events""")
def q_val_numeric(spark, sf_dir):
    from keelson.operators.validate import violations
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    df = ev.select("event_id", F.when(eid % 97 == 0, F.concat(F.lit("x"), eid)).when(eid % 89 == 0, F.lit("12f"))
                   .when(eid % 83 == 0, F.lit("0x1p3")).when(eid % 79 == 0, F.lit("1d")).when(eid % 73 == 0, F.lit(" -1.5e3 "))
                   .when(eid % 71 == 0, F.lit("inf")).otherwise(F.col("value").cast("string")).alias("value_text"),
                   F.col("value").alias("value_num"), (F.col("value") > 50).alias("value_flag"))
    spec = DatasetSpec("event_id", "target", (Feature("value_text", "NUMERIC", True, example=1.0),
                                              Feature("value_num", "NUMERIC", True, example=1.0),
                                              Feature("value_flag", "NUMERIC", True, example=1.0)))
    return violations(df, spec, is_train=False)


def _request_docs(spark, sf_dir, per_request: int = 20):
    """Request documents from ``events`` with rule-made faults (by request number r):
    r % 37 = 0 not JSON; r % 31 = 0 empty instances; r % 13 = 0 key 'k' renamed;
    k NULL where event_id % 23 = 0; event_type 'bogus' where event_id % 41 = 0."""
    from keelson.sources.requests import requests_from_table
    ev = events_frame(spark, sf_dir)
    eid = F.col("event_id")
    df = ev.select("event_id", "value",
                   F.when(eid % 23 == 0, F.lit(None)).otherwise(F.col("k")).alias("k"),
                   F.when(eid % 41 == 0, F.lit("bogus")).otherwise(F.col("event_type")).alias("event_type"))
    docs = requests_from_table(df, request_spec(), F.expr(f"event_id div {per_request}"))
    r = F.col("requestId").cast("bigint")
    value = (F.when(r % 37 == 0, F.lit("not json {"))
             .when(r % 31 == 0, F.lit('{"instances": []}'))
             .when(r % 13 == 0, F.regexp_replace("value", '"k":', '"kk":'))
             .otherwise(F.col("value")))
    return docs.select("requestId", value.alias("value"))


REQ_SQL = f"""req AS (
  SELECT event_id // 20 AS r,
         bool_or(event_id % 23 = 0) AS has_null_k,
         bool_or(event_id % 41 = 0) AS has_bogus,
         min(CASE WHEN event_id % 41 = 0 THEN 'bogus' END) AS first_bogus
  FROM events GROUP BY 1)"""

_SHAPE_MSG = f"""CASE WHEN r % 37 = 0 THEN 'Invalid request: body is not JSON'
            WHEN r % 31 = 0 THEN 'instances: ensure this value has at least 1 items'
            WHEN r % 13 = 0 THEN 'instances: field required: k'"""


@check("val_request_shape", "WITH " + REQ_SQL + f"""
SELECT CAST(r AS VARCHAR) AS requestId, {_SHAPE_MSG} END AS message FROM req""")
def q_val_request_shape(spark, sf_dir):
    from keelson.sources.requests import parse_requests, request_checks
    spec = request_spec()
    # shape rules only: drop the value rules by checking a spec without non-nullable / category lists
    shape_spec = DatasetSpec(spec.id, spec.target, tuple(
        Feature(f.name, f.kind, True, ()) for f in spec.features))
    parsed = parse_requests(_request_docs(spark, sf_dir), shape_spec, "value", "requestId")
    _, message = request_checks(shape_spec)
    return parsed.select("requestId", message.alias("message"))


@check("val_request_non_null", "WITH " + REQ_SQL + f"""
SELECT CAST(r AS VARCHAR) AS requestId, {_SHAPE_MSG}
            WHEN has_null_k THEN 'Feature `k` is non-nullable. Given null value is not allowed.'
       END AS message FROM req""")
def q_val_request_non_null(spark, sf_dir):
    from keelson.sources.requests import parse_requests, request_checks
    spec = request_spec()
    no_cats = DatasetSpec(spec.id, spec.target, tuple(Feature(f.name, f.kind, f.nullable, ()) for f in spec.features))
    parsed = parse_requests(_request_docs(spark, sf_dir), no_cats, "value", "requestId")
    _, message = request_checks(no_cats)
    return parsed.select("requestId", message.alias("message"))


@check("val_request_category", "WITH " + REQ_SQL + f"""
SELECT CAST(r AS VARCHAR) AS requestId, {_SHAPE_MSG}
            WHEN has_null_k THEN 'Feature `k` is non-nullable. Given null value is not allowed.'
            WHEN has_bogus THEN 'Value ''' || first_bogus || ''' not allowed for ''event_type''.Allowed values: [''click'', ''error'', ''purchase'', ''signup'', ''view'']'
       END AS message,
       NOT (r % 37 = 0 OR r % 31 = 0 OR r % 13 = 0 OR has_null_k OR has_bogus) AS ok FROM req""")
def q_val_request_category(spark, sf_dir):
    from keelson.sources.requests import parse_requests, request_checks
    spec = request_spec()
    parsed = parse_requests(_request_docs(spark, sf_dir), spec, "value", "requestId")
    ok, message = request_checks(spec)
    return parsed.select("requestId", message.alias("message"), ok.alias("ok"))


@check("val_request_long_categories", """
WITH o AS (SELECT o_orderkey, CAST(o_orderkey // 50 AS VARCHAR) AS r, CAST(o_custkey AS VARCHAR) AS v,
                  o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 101 <> 4) AS good FROM orders),
b AS (SELECT r, arg_min(v, o_orderkey) FILTER (WHERE NOT good) AS bad FROM o GROUP BY r)
SELECT r AS requestId, bad IS NULL AS ok, CASE WHEN bad IS NOT NULL THEN
       'Value ''' || bad || ''' not allowed for ''o_custkey''.Allowed values: those of the category table' END AS message FROM b""")
def q_val_request_long_categories(spark, sf_dir):
    """A category per customer: the list is a table that is probed, not literals."""
    from keelson.sources.requests import parse_requests, request_checks, requests_from_table, with_category_misses
    spec = DatasetSpec("o_orderkey", "target", (Feature("o_custkey", "CATEGORICAL", False, ()),
                                                Feature("o_totalprice", "NUMERIC", False, example=1.0)))
    docs = requests_from_table(table(spark, sf_dir, "orders"), spec, F.expr("o_orderkey div 50"))
    allowed = table(spark, sf_dir, "customer").where("c_custkey % 101 <> 4").select(
        F.lit("o_custkey").alias("feature"), F.col("c_custkey").cast("string").alias("value"))
    parsed = with_category_misses(parse_requests(docs, spec, "value", "requestId"), allowed)
    ok, message = request_checks(spec, table_features=("o_custkey",))
    return parsed.select("requestId", message.alias("message"), ok.alias("ok"))


@check("quarantine", """WITH e AS (
  SELECT event_id, CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS id,
         event_id % 97 = 0 OR event_id % 89 = 0 AS bad_text, event_id % 17 = 0 AS no_type, event_id % 23 = 0 AS odd_type
  FROM events), d AS (SELECT id FROM e GROUP BY id HAVING count(*) > 1)
SELECT event_id, concat_ws(',', CASE WHEN no_type THEN 'non_null:event_type' END, CASE WHEN bad_text THEN 'numeric:value_text' END,
                           CASE WHEN odd_type AND NOT no_type THEN 'category:event_type' END,
                           CASE WHEN id IN (SELECT id FROM d) THEN 'unique_id:id' END) AS reasons
FROM e WHERE bad_text OR no_type OR odd_type OR id IN (SELECT id FROM d)""")
def q_quarantine(spark, sf_dir):
    """The offending rows of the row-level rules, with their reasons."""
    from keelson.operators.validate import quarantine
    eid = F.col("event_id")
    df = table(spark, sf_dir, "events").select(
        "event_id", F.when(eid % 50 == 49, eid - 1).otherwise(eid).alias("id"),
        F.when(eid % 97 == 0, F.lit("x")).when(eid % 89 == 0, F.lit("12f")).otherwise(F.col("value").cast("string")).alias("value_text"),
        F.when(eid % 17 == 0, F.lit(None)).when(eid % 23 == 0, F.lit("bogus")).otherwise(F.col("event_type")).alias("event_type"))
    spec = DatasetSpec("id", "target", (Feature("value_text", "NUMERIC", True, example=1.0),
                                        Feature("event_type", "CATEGORICAL", False, tuple(EVENT_TYPES))))
    return quarantine(df, spec, check_categories=True).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@check("val_predictions", """SELECT count(*) AS n_predictions FROM events""")
def q_val_predictions(spark, sf_dir):
    from keelson.operators.validate import validate_predictions
    preds = _literal_predictor().transform(events_frame(spark, sf_dir)).select("event_id", "prediction")
    validate_predictions(preds, events_spec(), "prediction")
    return preds.agg(F.count(F.lit(1)).alias("n_predictions"))


# ----------------------------------------------------------------------------
# 2.3 projections and casts
@check("col_select", """WITH """ + EV_SQL + """
SELECT event_id, value, k, event_type FROM ev""")
def q_col_select(spark, sf_dir):
    from keelson.operators.stages import ColumnSelector
    df = events_frame(spark, sf_dir)
    kept = ColumnSelector(columns=["event_type", "k", "value", "no_such_column"], passthrough=["event_id"]).transform(df)
    return r6(ColumnSelector(columns=["parity"], selectorType="drop").transform(kept))


@check("cast_str", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity,
       CAST(l_extendedprice AS VARCHAR) AS l_extendedprice, CAST(l_tax AS VARCHAR) AS l_tax,
       CAST(l_linenumber AS VARCHAR) AS line_label,
       coalesce(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END, 'nan') AS l_returnflag
FROM lineitem""")
def q_cast_str(spark, sf_dir):
    from keelson.operators.stages import TypeCaster
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax",
        F.col("l_linenumber").alias("line_label"),
        F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag"))
    out = TypeCaster(inputCols=["l_quantity", "l_extendedprice", "l_tax", "line_label"], castType="string").transform(li)
    return TypeCaster(inputCols=["l_returnflag"], castType="string", nullsAsLabel=True).transform(out)


CAST_VALUES = ["0.0001", "12345678.5", "1e16", "0.00001", "-0.00012", "1.5e300", "9007199254740992", "-1234567.25", "100000",
               "2.5e-7", "123456789012345680", "3e9"]


@check("cast_full_range", """
WITH v AS (SELECT event_id, CAST((list_value(""" + ", ".join(f"'{v}'" for v in CAST_VALUES) + """))[1 + event_id % 12] AS DOUBLE) AS x FROM events)
SELECT event_id, CAST(x AS VARCHAR) AS x_text, CAST(9007199254740993 + event_id AS BIGINT) AS whole,
       CAST(3000000000 + event_id AS BIGINT) AS wide_int FROM v""")
def q_cast_full_range(spark, sf_dir):
    """Doubles of any size as text; whole numbers beyond 2**53 and 2**31 from text."""
    from keelson.operators.stages import TypeCaster
    eid = F.col("event_id")
    x = F.get(F.array(*[F.lit(float(v)) for v in CAST_VALUES]), (eid % 12).cast("int"))
    df = table(spark, sf_dir, "events").select(
        "event_id", x.alias("x_text"), (eid + F.lit(9007199254740993)).cast("string").alias("whole"),
        (eid + F.lit(3000000000)).cast("string").alias("wide_int"))
    df = TypeCaster(inputCols=["x_text"], castType="string").transform(df)
    return TypeCaster(inputCols=["whole", "wide_int"], castType="int").transform(df)


@check("cast_float", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_text, CAST(user_id AS DOUBLE) AS user_id FROM events""")
def q_cast_float(spark, sf_dir):
    from keelson.operators.stages import TypeCaster
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("value").cast("string").alias("value_text"),
        "user_id")
    return r6(TypeCaster(inputCols=["k", "value_text", "user_id"], castType="double").transform(ev))


@check("cast_int", """
SELECT l_orderkey, CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice,
       CAST(trunc(l_quantity) AS BIGINT) AS l_quantity, CAST(l_linenumber AS BIGINT) AS line_text FROM lineitem""")
def q_cast_int(spark, sf_dir):
    from keelson.operators.stages import TypeCaster
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_quantity", F.col("l_linenumber").cast("string").alias("line_text"))
    return TypeCaster(inputCols=["l_extendedprice", "l_quantity", "line_text"], castType="bigint").transform(li)


@check("clip", """WITH """ + EV_SQL + """
SELECT event_id,
       round(CASE WHEN value IS NULL THEN NULL ELSE greatest(10.0, least(100.0, value)) END, 6) + 0.0 AS value,
       round(greatest(20.0, k), 6) + 0.0 AS k, round(least(50.0, k_copy), 6) + 0.0 AS k_copy FROM ev""")
def q_clip(spark, sf_dir):
    from keelson.operators.stages import ValueClipper
    df = events_frame(spark, sf_dir).select("event_id", "value", "k", "k_copy")
    df = ValueClipper(inputCols=["value", "missing_col"], lower=10.0, upper=100.0).transform(df)
    df = ValueClipper(inputCols=["k"], lower=20.0).transform(df)
    return r6(ValueClipper(inputCols=["k_copy"], upper=50.0).transform(df))


@check("col_order", """WITH """ + EV_SQL + """
SELECT event_id, click_score, event_type, k, k_copy, one, parity, value FROM ev""")
def q_col_order(spark, sf_dir):
    from keelson.operators.stages import ColumnOrder
    df = events_frame(spark, sf_dir).drop("target")
    return r6(ColumnOrder(passthrough=["event_id"]).fit(df).transform(df))


# ----------------------------------------------------------------------------
# 2.4 sampling
SPARSE_ID_SQL = "CASE WHEN event_id % 10 <> 3 THEN event_id END"      # every tenth row has no ID


def _sparse_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("id", F.when(F.col("event_id") % 10 != 3, F.col("event_id")))


@check("split_train_val", f"""
SELECT event_id, CASE WHEN {hash_uniform_sql(SPARSE_ID_SQL, '42')} < 0.1 THEN 'val' ELSE 'train' END AS split
FROM events""")
def q_split_train_val(spark, sf_dir):
    from keelson.operators.sample import split_train_val
    tr, va = split_train_val(_sparse_ids(spark, sf_dir), "id", 0.1, seed=42)
    return tr.select("event_id", F.lit("train").alias("split")).unionByName(
        va.select("event_id", F.lit("val").alias("split")))


@check("split_train_val_exact", f"""
WITH u AS (SELECT event_id, {hash_uniform_sql(SPARSE_ID_SQL, '42')} AS u FROM events),
     rk AS (SELECT event_id, row_number() OVER (ORDER BY u, event_id) AS rn, count(*) OVER () AS n FROM u)
SELECT event_id, CASE WHEN rn <= ceil(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM rk""")
def q_split_train_val_exact(spark, sf_dir):
    from keelson.operators.sample import split_train_val
    tr, va = split_train_val(_sparse_ids(spark, sf_dir), "id", 0.15, seed=42, exact_size=True)
    return tr.select("event_id", F.lit("train").alias("split")).unionByName(
        va.select("event_id", F.lit("val").alias("split")))


@check("inject_nulls", f"""
SELECT event_id,
  CASE WHEN {hash_uniform_sql('event_id', '123', "'raw_value'")} < 0.05 THEN NULL ELSE value END AS raw_value,
  CASE WHEN {hash_uniform_sql('event_id', '123', "'raw_type'")} < 0.05 THEN NULL ELSE event_type END AS raw_type,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
FROM events""")
def q_inject_nulls(spark, sf_dir):
    from keelson.operators.sample import inject_nulls
    ev = table(spark, sf_dir, "events")
    df = ev.select("event_id", F.col("value").alias("raw_value"), F.col("event_type").alias("raw_type"),
                   F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
                   _k().alias("k"))
    # raw_value / raw_type have no null: about 5% are nulled; value already has nulls: unchanged
    return r6(inject_nulls(df, "event_id", ["raw_value", "raw_type", "value"], p=0.05, seed=123))


# ----------------------------------------------------------------------------
# 2.5 fit-type operators
@check("drop_all_null", """WITH """ + EV_SQL + """
SELECT event_id, value, k FROM ev""")
def q_drop_all_null(spark, sf_dir):
    from keelson.operators.stages import DropAllNull
    df = events_frame(spark, sf_dir).select("event_id", "value", "k", F.lit(None).cast("double").alias("empty_num"),
                                            F.lit(None).cast("string").alias("empty_cat"))
    return r6(DropAllNull(inputCols=["value", "k", "empty_num", "empty_cat"]).fit(df).transform(df))


@check("missing_indicator", """WITH """ + EV_SQL + """
SELECT event_id, value, k, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS value_na FROM ev""")
def q_missing_indicator(spark, sf_dir):
    from keelson.operators.stages import MissingIndicator
    df = events_frame(spark, sf_dir).select("event_id", "value", "k")
    return r6(MissingIndicator(inputCols=["value", "k"]).fit(df).transform(df))


@check("mean_impute", """WITH """ + EV_SQL + """
SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) + 0.0 AS value,
       round(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE k END, avg(CASE WHEN event_id % 3 = 0 THEN NULL ELSE k END) OVER ()), 6) + 0.0 AS k3
FROM ev""")
def q_mean_impute(spark, sf_dir):
    from keelson.operators.stages import MeanMedianImputer
    df = events_frame(spark, sf_dir).select(
        "event_id", "value", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("k")).alias("k3"))
    return r6(MeanMedianImputer(inputCols=["value", "k3"]).fit(df).transform(df))


@check("median_impute", """WITH """ + EV_SQL + """,
li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_extendedprice END AS price,
              CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS qty FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(price, median(price) OVER ()), 6) + 0.0 AS price,
       round(coalesce(qty, median(qty) OVER ()), 6) + 0.0 AS qty FROM li""")
def q_median_impute(spark, sf_dir):
    from keelson.operators.stages import MeanMedianImputer
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 2, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("qty"))
    return r6(MeanMedianImputer(inputCols=["price", "qty"], method="median").fit(li).transform(li))


@check("median_impute_wide_range", """
WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 1e308 WHEN 2 THEN -1e308 WHEN 3 THEN 1e-300 * (event_id % 50)
                  WHEN 4 THEN 0.25 ELSE value END AS x FROM events)
SELECT event_id, coalesce(x, median(x) OVER ()) AS x FROM e""")
def q_median_impute_wide_range(spark, sf_dir):
    """Values from -1e308 to 1e308 with heavy ties."""
    from keelson.operators.stages import MeanMedianImputer
    eid = F.col("event_id")
    x = F.when(eid % 7 == 0, F.lit(None).cast("double")).when(eid % 7 == 1, F.lit(1e308)).when(eid % 7 == 2, F.lit(-1e308)) \
        .when(eid % 7 == 3, F.lit(1e-300) * (eid % 50)).when(eid % 7 == 4, F.lit(0.25)).otherwise(F.col("value"))
    df = table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    return MeanMedianImputer(inputCols=["x"], method="median").fit(df).transform(df)


@check("standard_scale", """WITH """ + EV_SQL + """
SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) + 0.0 AS value,
       round((k - avg(k) OVER ()) / stddev_pop(k) OVER (), 6) + 0.0 AS k,
       round(one - 1.0, 6) + 0.0 AS one FROM ev""")
def q_standard_scale(spark, sf_dir):
    from keelson.operators.stages import StandardScaler
    df = events_frame(spark, sf_dir).select("event_id", "value", "k", "one")
    return r6(StandardScaler(inputCols=["value", "k", "one"]).fit(df).transform(df))


MODE_SQL = """(SELECT v FROM (SELECT {c} AS v, count(*) AS c FROM ev WHERE {c} IS NOT NULL GROUP BY 1)
              ORDER BY c DESC, v LIMIT 1)"""


@check("mode_impute", """WITH """ + EV_SQL + """,
e2 AS (SELECT ev.*, CASE WHEN event_id % 7 = 0 THEN NULL ELSE parity END AS parity7 FROM ev)
SELECT event_id, coalesce(event_type, """ + MODE_SQL.format(c="event_type") + """) AS event_type, parity7
FROM e2""")
def q_mode_impute(spark, sf_dir):
    from keelson.operators.stages import MostFrequentImputer
    df = events_frame(spark, sf_dir).select(
        "event_id", "event_type",
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("parity")).alias("parity7"))
    # event_type: 3.4% null < 10% -> filled; parity7: 14% null -> left alone
    return MostFrequentImputer(inputCols=["event_type", "parity7"], threshold=0.1).fit(df).transform(df)


@check("missing_tag", """WITH """ + EV_SQL + """
SELECT event_id, coalesce(event_type, 'missing') AS event_type, parity FROM ev""")
def q_missing_tag(spark, sf_dir):
    from keelson.operators.stages import CategoricalImputer
    df = events_frame(spark, sf_dir).select("event_id", "event_type", "parity")
    return CategoricalImputer(inputCols=["event_type", "parity"]).fit(df).transform(df)


@check("rare_label", """
WITH p AS (SELECT p_partkey, p_brand, p_type,
                  count(*) OVER (PARTITION BY p_brand) AS cb, count(*) OVER (PARTITION BY p_type) AS ct,
                  count(*) OVER () AS n FROM part),
     d AS (SELECT count(DISTINCT p_brand) AS db, count(DISTINCT p_type) AS dt FROM part)
SELECT p_partkey,
       CASE WHEN db <= 1 OR cb / n >= 0.045 THEN p_brand ELSE 'Rare' END AS p_brand,
       CASE WHEN dt <= 1 OR ct / n >= 0.045 THEN p_type ELSE 'Rare' END AS p_type
FROM p, d""")
def q_rare_label(spark, sf_dir):
    from keelson.operators.stages import RareLabelEncoder
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return RareLabelEncoder(inputCols=["p_brand", "p_type"], tol=0.045, nCategories=1).fit(df).transform(df)


@check("rare_label_at_tolerance", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 100 < 7 THEN 'edge' ELSE 'rest' END AS narrow,
                  CASE WHEN event_id % 100 < 7 THEN 'edge' ELSE 'o' || CAST(event_id % 50 AS VARCHAR) END AS wide FROM events),
     c AS (SELECT *, count(*) OVER (PARTITION BY narrow) AS cn, count(*) OVER (PARTITION BY wide) AS cw, count(*) OVER () AS n FROM e)
SELECT event_id, CASE WHEN cn / n >= CAST(0.07 AS DOUBLE) THEN narrow ELSE 'Rare' END AS narrow,
       CASE WHEN cw / n >= CAST(0.07 AS DOUBLE) THEN wide ELSE 'Rare' END AS wide FROM c""")
def q_rare_label_at_tolerance(spark, sf_dir):
    """A label with (near) exactly the tolerated share, in a narrow and in a wide column."""
    from keelson.operators.stages import RareLabelEncoder
    eid = F.col("event_id")
    df = table(spark, sf_dir, "events").select(
        "event_id", F.when(eid % 100 < 7, F.lit("edge")).otherwise(F.lit("rest")).alias("narrow"),
        F.when(eid % 100 < 7, F.lit("edge")).otherwise(F.concat(F.lit("o"), (eid % 50).cast("string"))).alias("wide"))
    return RareLabelEncoder(inputCols=["narrow", "wide"], tol=0.07, nCategories=1).fit(df).transform(df)


@check("drop_duplicate_flags", """
SELECT event_id, CAST(event_id % 2 AS INT) AS f000, CAST(event_id % 3 AS INT) AS g FROM events""")
def q_drop_duplicate_flags(spark, sf_dir):
    """200 equal flags and one other column: as many comparisons as columns."""
    from keelson.operators.selection import DropDuplicate
    eid = F.col("event_id")
    df = table(spark, sf_dir, "events").select("event_id", *[(eid % 2).cast("int").alias(f"f{j:03d}") for j in range(200)],
                                               (eid % 3).cast("int").alias("g"))
    return DropDuplicate(excludeCols=["event_id"], idCol="event_id").fit(df).transform(df)


@check("drop_constant", """WITH """ + EV_SQL + """
SELECT event_id, value, k, event_type, parity FROM ev""")
def q_drop_constant(spark, sf_dir):
    from keelson.operators.selection import DropConstant
    df = events_frame(spark, sf_dir).select("event_id", "value", "k", "one", "event_type", "parity",
                                            F.lit("same").alias("const_label"),
                                            F.lit(None).cast("double").alias("all_null"))
    return r6(DropConstant(excludeCols=["event_id"]).fit(df).transform(df))


@check("drop_duplicate", """
SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2.0 AS k2 FROM events""")
def q_drop_duplicate(spark, sf_dir):
    from keelson.operators.selection import DropDuplicate
    ev = table(spark, sf_dir, "events")
    df = ev.select("event_id", "value", _k().alias("k"), _k().alias("k_copy"), "event_type",
                   F.col("event_type").alias("type_copy"), (_k() * 2.0).alias("k2"),
                   F.col("value").cast("string").alias("value_text"))
    # value_text has the same digits as value but another type: not a duplicate
    return r6(DropDuplicate(excludeCols=["event_id"], idCol="event_id").fit(df).transform(df).drop("value_text"))


@check("one_hot", """
WITH cols AS (SELECT 'p_brand' AS col, p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part),
     cnt AS (SELECT col, v, count(*) AS c FROM cols GROUP BY 1, 2),
     dd AS (SELECT col, count(*) AS nd FROM cnt GROUP BY 1),
     top AS (SELECT cnt.col, v, row_number() OVER (PARTITION BY cnt.col ORDER BY c DESC, v) AS rk, nd FROM cnt JOIN dd USING (col)),
     chosen AS (SELECT col, v FROM top WHERE rk <= greatest(1, least(10, nd - 1)))
SELECT p.p_partkey, chosen.col || '_' || chosen.v AS feature,
       CASE WHEN (CASE chosen.col WHEN 'p_brand' THEN p.p_brand ELSE p.p_type END) = chosen.v THEN 1 ELSE 0 END AS flag
FROM part p CROSS JOIN chosen""")
def q_one_hot(spark, sf_dir):
    from keelson.operators.stages import OneHotEncoder
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    m = OneHotEncoder(inputCols=["p_brand", "p_type"], maxCategories=10).fit(df)
    out = m.transform(df)
    names = m.output_names()
    return out.unpivot(["p_partkey"], names, "feature", "flag")


@check("drop_correlated", """
SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id FROM events""")
def q_drop_correlated(spark, sf_dir):
    from keelson.operators.selection import DropCorrelated
    ev = table(spark, sf_dir, "events")
    df = ev.select("event_id", "value", _k().alias("k"),
                   (_k() / 2.0 + (F.col("event_id") % 5) * 0.01).alias("k_half"),
                   F.col("user_id"))
    # k and k_half correlate at ~1: the one with the larger variance (k) stays
    return r6(DropCorrelated(excludeCols=["event_id"], threshold=0.98).fit(df).transform(df))


@check("target_scale", """WITH """ + EV_SQL + """
SELECT event_id, round((target - avg(target) OVER ()) / stddev_pop(target) OVER (), 6) + 0.0 AS target FROM ev""")
def q_target_scale(spark, sf_dir):
    from keelson.operators.stages import TargetScaler
    df = events_frame(spark, sf_dir).select("event_id", "target")
    return r6(TargetScaler(targetCol="target").fit(df).transform(df))


@check("target_unscale", """WITH """ + EV_SQL + f""",
t AS (SELECT avg(target) AS m, stddev_pop(target) AS s FROM ev)
SELECT event_id, round((0.001 * k) * s + m, 6) + 0.0 AS prediction FROM ev, t""")
def q_target_unscale(spark, sf_dir):
    from keelson.operators.stages import TargetScaler
    from keelson.plans.workflow import TargetUnscaleModel
    df = events_frame(spark, sf_dir)
    ts = TargetScaler(targetCol="target").fit(df)
    un = TargetUnscaleModel(col="prediction", mean=ts.v("means")[0], std=ts.v("stds")[0])
    return r6(un.transform(df.select("event_id", (F.lit(0.001) * F.col("k")).alias("prediction"))))


@check("preprocess_fit_transform", A15_SQL)
def q_preprocess_fit_transform(spark, sf_dir):
    from keelson.plans.preprocess import fused_transform
    _, fp = _fit_preprocess(spark, sf_dir)
    return r6(fused_transform(fp.pipeline, fp.source).drop("target"))


WIDE_FEATURES = 200  # the reference's stated maximum width


SHARED = 32          # features that share one 32-bit number, each with a multiplier of its own


def _multiplier(k: int) -> int:
    """Odd, and far from the others: a power of 69069 modulo 2**31."""
    return pow(69069, k % SHARED, 1 << 31)


def _spark_part(salt: str, k: int) -> str:
    """Uniform number k of a salt: a multiple, modulo 2**32, of eight hex digits of a digest of the key (``_seeds``)."""
    return f"((u_{salt}_{k // SHARED} * {_multiplier(k)}L & 4294967295L) / 4294967296D)"


def _seeds(width: int) -> list[str]:
    """The 32-bit numbers that the features share, as columns of their own."""
    return [f"CAST(conv(substring(md5(concat(CAST(o_orderkey AS STRING), '|{salt}|{k}')), 1, 8), 16, 10) AS BIGINT) "
            f"AS u_{salt}_{k}" for salt in ("f", "null") for k in range(-(-width // SHARED))]


def _duck_part(salt: str, k: int) -> str:
    """The same in DuckDB's."""
    seed = f"('0x' || substr(md5(concat(o_orderkey, '|{salt}|{k // SHARED}')), 1, 8))::BIGINT"
    return f"(({seed} * {_multiplier(k)}) % 4294967296 / 4294967296.0)"


def _wide_feature(j: int, part) -> str:
    """Feature j in the SQL of ``part``: noise of its own scale plus a share of the price; even ones have nulls."""
    price = "o_totalprice / CAST(1000000 AS DOUBLE)"
    x = f"{part('f', j)} * CAST({1 + j % 5} AS DOUBLE) + {price} * CAST({j % 3 - 1} AS DOUBLE)"
    if j % 2 == 0:
        x = f"CASE WHEN {part('null', j // 2)} < CAST(0.05 AS DOUBLE) THEN NULL ELSE {x} END"
    return x


def wide_orders_frame(spark: SparkSession, sf_dir: str, width: int = WIDE_FEATURES):
    """``orders`` widened to ``width`` numeric features (hash noise mixed with the
    order price; every other feature has ~5% rule-made nulls) plus two
    categoricals; target = price / 1000."""
    features = [(f"f{j:03d}", _wide_feature(j, _spark_part)) for j in range(width)]
    spec_feats = [Feature(name, "NUMERIC", j % 2 == 0, example=0.5) for j, (name, _) in enumerate(features)]
    spec_feats += [Feature("o_orderstatus", "CATEGORICAL", False, ("F", "O", "P")),
                   Feature("o_orderpriority", "CATEGORICAL", False, ("1-URGENT", "2-HIGH", "3-MEDIUM",
                                                                     "4-NOT SPECIFIED", "5-LOW"))]
    # as SQL text: one parse instead of thousands of calls; the rule is costly, so its rows are dealt out first
    df = spread(table(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", *_seeds(width)).selectExpr(
        "o_orderkey", *[f"{e} AS {name}" for name, e in features], "o_orderstatus", "o_orderpriority",
        "o_totalprice / 1000D AS target")
    return df, DatasetSpec("o_orderkey", "target", tuple(spec_feats), id_type=T.LongType())


WIDE_LABELS = {"o_orderstatus": ["F", "O", "P", "Rare"],
               "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "Rare"]}


def _wide_sql(width: int) -> str:
    """The same features, imputed, scaled and clipped or encoded, in SQL (none is constant, repeated or correlated)."""
    raw, stats, filled, out = [], [], [], []
    for j in range(width):
        f = f"f{j:03d}"
        if j % 2 == 0:
            out.append(f"CASE WHEN r.{f} IS NULL THEN 1 ELSE 0 END AS {f}_na")
        raw.append(f"{_wide_feature(j, _duck_part)} AS {f}")
        filled.append(f"coalesce({f}, avg({f}) OVER ()) AS {f}")
        stats.append(f"avg({f}) AS m{j}, stddev_pop({f}) AS s{j}")
        out.append(f"round(greatest(-4.0, least(4.0, (v.{f} - m{j}) / s{j})), 4) + 0.0 AS {f}")
    tables = []
    for c, labels in WIDE_LABELS.items():
        # labels below the tolerated share become Rare; the least frequent one of the rest gets no column (here: -1)
        tables.append(f"l_{c} AS (SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY {c}) / count(*) OVER () >= 0.03 "
                      f"THEN {c} ELSE 'Rare' END AS v FROM orders), "
                      f"k_{c} AS (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) AS rk, count(*) OVER () AS nd "
                      f"FROM l_{c} GROUP BY v)")
        for label in labels:
            has = f"EXISTS (SELECT 1 FROM k_{c} WHERE v = '{label}' AND rk <= greatest(1, least(10, nd - 1)))"
            out.append(f"CASE WHEN {has} THEN CASE WHEN l_{c}.v = '{label}' THEN 1 ELSE 0 END ELSE -1 END "
                       f"AS \"{one_hot_name(c, label)}\"")
    joins = " ".join(f"JOIN l_{c} USING (o_orderkey)" for c in WIDE_LABELS)
    return (f"WITH raw AS (SELECT o_orderkey, {', '.join(raw)} FROM orders), "
            f"filled AS (SELECT o_orderkey, {', '.join(filled)} FROM raw), st AS (SELECT {', '.join(stats)} FROM filled), "
            f"{', '.join(tables)} "
            f"SELECT r.o_orderkey, {', '.join(out)} FROM raw r JOIN filled v USING (o_orderkey) {joins}, st")


def _rounded(x: str) -> str:
    """To 4 decimals by arithmetic on doubles, as DuckDB's ``round``: the factor next above 1 takes halves away from zero.
    Spark's ``round`` goes through a decimal text of every value, which took most of the last projection."""
    return f"rint({x} * 10000D * 1.0000000000000002D) / 10000D + 0D"


@check("preprocess_wide", _wide_sql(WIDE_FEATURES))
def q_preprocess_wide(spark, sf_dir):
    """A15 at the reference's maximum width: 200 numeric + 2 categorical features over every order, all columns
    returned (a label without a column of its own, the least frequent one, is shown as -1)."""
    from keelson.plans.preprocess import Preprocessor, fused_transform
    df, spec = wide_orders_frame(spark, sf_dir)
    # a copy of the features would be many times as large as orders, and its write dearer than deriving them in each scan
    fp = Preprocessor(spec).fit(df, rederive=True)
    out = fused_transform(fp.pipeline, fp.source).drop("target")
    encoded = [one_hot_name(c, label) for c, labels in WIDE_LABELS.items() for label in labels]
    return out.selectExpr(*[f"{_rounded(f'`{f.name}`')} AS `{f.name}`" if isinstance(f.dataType, T.DoubleType)
                            else f"`{f.name}`" for f in out.schema.fields],
                          *[f"-1 AS `{c}`" for c in encoded if c not in out.columns])


# ----------------------------------------------------------------------------
# 2.6 model operators
def _features_sql(names: list[str], val_pct: float = 0.0) -> str:
    """CTEs up to ``x``: event_id, val, tm and ts (the target's mean and scale), y (the scaled target) and x0, x1, ...:
    the preprocessed columns ``names`` and a one; everything is fitted on the rows outside the validation split."""
    ready = {"click_score": "greatest(-4.0, least(4.0, (click_score - mc) / sc))",
             "k": "greatest(-4.0, least(4.0, (k - mk) / sk))",
             "value": "greatest(-4.0, least(4.0, (value_f - mv2) / sv2))",
             "value_na": "CASE WHEN value IS NULL THEN 1 ELSE 0 END", "parity_odd": "CASE WHEN parity = 'odd' THEN 1 ELSE 0 END"}
    for t in EVENT_TYPES:
        ready[f"event_type_{t}"] = f"CASE WHEN coalesce(event_type, 'nan') = '{t}' THEN 1 ELSE 0 END"
    columns = [f"CAST({ready[n]} AS DOUBLE) AS x{i}" for i, n in enumerate(names)] + [f"1.0::DOUBLE AS x{len(names)}"]
    return EV_SQL + f""",
u AS MATERIALIZED (SELECT *, {hash_uniform_sql('event_id', '42')} < {val_pct} AS val FROM ev),
st AS (SELECT avg(value) AS mv, avg(k) AS mk, stddev_pop(k) AS sk, avg(click_score) AS mc, stddev_pop(click_score) AS sc,
              avg(target) AS tm, stddev_pop(target) AS ts FROM u WHERE NOT val),
f AS (SELECT u.*, st.*, coalesce(u.value, st.mv) AS value_f FROM u, st),
st2 AS (SELECT avg(value_f) AS mv2, stddev_pop(value_f) AS sv2 FROM f WHERE NOT val),
x AS MATERIALIZED (SELECT event_id, val, tm, ts, (target - tm) / ts AS y, {', '.join(columns)} FROM f, st2)"""


def _newton_sql(d: int) -> str:
    """CTEs ``it`` and ``fitted`` (trial, p = coefficients, intercept, scale) for the rows of ``x`` outside the validation
    split and the table ``trials`` (trial, alpha, eps): damped Newton steps, one recursion per evaluation."""
    m = d + 2                                                       # parameters: d coefficients, intercept, scale
    s = f"cand[{m}]"
    dot = " + ".join(f"cand[{i + 1}] * x{i}" for i in range(d + 1))
    total = lambda e: f"coalesce(sum({e}) FILTER (WHERE inside), 0)"
    pull = "CASE WHEN inside THEN 2 * r / s ELSE 2 * eps * sign(r) END"
    value = f"s * count(*) + {total('r * r')} / s + coalesce(sum(2 * eps * abs(r) - eps * eps * s) FILTER (WHERE NOT inside), 0)"
    ridge = "2 * alpha"
    w = ", ".join(f"cand[{i + 1}]" for i in range(d))
    gradient = [f"sum(({pull}) * x{i})" + (f" + {ridge} * cand[{i + 1}]" if i < d else "") for i in range(d + 1)]
    gradient.append(f"count(*) - {total('r * r')} / (s * s) - count(*) FILTER (WHERE NOT inside) * eps * eps")
    rows = []
    for i in range(m):
        row = []
        for j in range(m):
            a, b = min(i, j), max(i, j)
            if b <= d:
                e = f"2 / s * {total(f'x{a} * x{b}')}" + (f" + {ridge}" if a == b and a < d else "")
            elif a <= d:
                e = f"-2 / (s * s) * {total(f'x{a} * r')}"
            else:
                e = f"2 * {total('r * r')} / (s * s * s)"
            row.append(e)
        rows.append("[" + ", ".join([*row, f"-g[{i + 1}]"]) + "]")
    keys = "trial, alpha, eps, k, cand, point, value, step, slope, len"
    inner = (f"SELECT {keys}, s, x.*, {dot} - y AS r, abs({dot} - y) <= eps * s AS inside "
             f"FROM (SELECT *, {s} AS s FROM it WHERE NOT done AND k < 400) JOIN x ON NOT x.val")
    # the sums first, so that each is computed once and the matrix is made of them
    sums: dict[str, str] = {}

    def named(e: str) -> str:
        return sums.setdefault(e, f"a{len(sums)}")

    import re
    pattern = re.compile(r"coalesce\(sum\([^()]*\) FILTER \(WHERE inside\), 0\)")
    rows = [pattern.sub(lambda t: named(t.group(0)), row) for row in rows]
    g = ", ".join(f"{e} AS g{i}" for i, e in enumerate(gradient))
    sql = (f"SELECT {keys}, s, {value} + alpha * list_sum([v * v for v in [{w}]]) AS f, {g}, "
           f"{', '.join(f'{e} AS {a}' for e, a in sums.items())} FROM ({inner}) GROUP BY {keys}, s")
    sql = f"SELECT *, [{', '.join(f'g{i}' for i in range(m))}] AS g FROM ({sql})"
    sql = f"SELECT {keys}, s, f, g, [{', '.join(rows)}] AS m FROM ({sql})"
    for i in range(1, m + 1):                                       # Gauss-Jordan elimination
        sql = f"SELECT {keys}, s, f, g, m, [v / m[{i}][{i}] for v in m[{i}]] AS top_row FROM ({sql})"
        sql = (f"SELECT {keys}, s, f, g, [CASE WHEN i = {i} THEN top_row ELSE [m[i][j] - m[i][{i}] * top_row[j] "
               f"for j in range(1, {m + 2})] END for i in range(1, {m + 1})] AS m FROM ({sql})")
    sql = (f"SELECT {keys}, f, [row[{m + 1}] for row in m] AS d, list_dot_product(g, [row[{m + 1}] for row in m]) AS gd, "
           f"step IS NULL OR f <= value + 1e-4 * len * slope + 1e-12 * abs(value) AS ok FROM ({sql})")
    sql = (f"SELECT *, list_max([abs(v) for v in d]) <= 1e-9 * (1 + list_max([abs(v) for v in cand])) OR -gd <= 1e-13 * abs(f) AS small, "
           f"CASE WHEN d[{m}] < 0 THEN least(1.0, -0.8 * cand[{m}] / d[{m}]) ELSE 1.0 END AS far FROM ({sql})")
    moved = f"[{', '.join(f'cand[{i}] + far * d[{i}]' for i in range(1, m + 1))}]"
    back = f"[{', '.join(f'point[{i}] + len / 2 * step[{i}]' for i in range(1, m + 1))}]"
    sql = (f"SELECT trial, alpha, eps, k + 1 AS k, CASE WHEN ok THEN {moved} ELSE {back} END AS cand, "
           f"CASE WHEN ok THEN cand ELSE point END AS point, CASE WHEN ok THEN f ELSE value END AS value, "
           f"CASE WHEN ok THEN d ELSE step END AS step, CASE WHEN ok THEN gd ELSE slope END AS slope, "
           f"CASE WHEN ok THEN far ELSE len / 2 END AS len, (ok AND small) OR len < 1e-12 AS done FROM ({sql})")
    start = ", ".join(["0.0::DOUBLE"] * (d + 1) + ["1.0::DOUBLE"])
    return (f"it AS (SELECT trial, alpha::DOUBLE AS alpha, eps::DOUBLE AS eps, 0 AS k, [{start}] AS cand, [{start}] AS point, "
            f"0.0::DOUBLE AS value, NULL::DOUBLE[] AS step, 0.0::DOUBLE AS slope, 1.0::DOUBLE AS len, FALSE AS done FROM trials "
            f"UNION ALL {sql}), "
            "fitted AS MATERIALIZED (SELECT trial, alpha, eps, arg_max(cand, k) AS p FROM it GROUP BY ALL)")


def _predicted_sql(d: int) -> str:
    return " + ".join(f"p[{i + 1}] * x{i}" for i in range(d + 1))


ONE_TRIAL = "trials AS (SELECT 0 AS trial, 0.0001 AS alpha, 1.35 AS eps)"
MODEL_TERMS = ["click_score", *[f"event_type_{t}" for t in EVENT_TYPES[1:]], "k", "parity_odd", "value", "value_na"]


@check("huber_fit", f"""WITH RECURSIVE {_features_sql(MODEL_TERMS)}, {ONE_TRIAL}, {_newton_sql(len(MODEL_TERMS))}
SELECT unnest([{', '.join(f"'{t}'" for t in [*MODEL_TERMS, '__intercept__', '__scale__'])}]) AS term,
       round(unnest(p), 6) + 0.0 AS coefficient FROM fitted""")
def q_huber_fit(spark, sf_dir):
    from keelson.operators.model import huber_fit
    from keelson.plans.workflow import scaled
    _, fp = _fit_preprocess(spark, sf_dir)
    m = huber_fit(scaled(fp, fp.source), fp.feature_cols, "target")
    rows = [(c, float(w)) for c, w in zip(m.v("featureCols"), m.v("coefficients"))]
    rows += [("__intercept__", float(m.v("intercept"))), ("__scale__", float(m.v("scale")))]
    return r6(spark.createDataFrame(rows, "term string, coefficient double"))


@check("huber_predict", """WITH """ + EV_SQL + f"""
SELECT event_id, round({LITERAL_SQL}, 6) + 0.0 AS prediction FROM ev""")
def q_huber_predict(spark, sf_dir):
    return r6(_literal_predictor().transform(events_frame(spark, sf_dir)).select("event_id", "prediction"))


@check("predict_rescaled", """WITH """ + EV_SQL + f""",
t AS (SELECT avg(target) AS m, stddev_pop(target) AS s FROM ev)
SELECT event_id, round({LITERAL_SQL} * s + m, 6) + 0.0 AS prediction FROM ev, t""")
def q_predict_rescaled(spark, sf_dir):
    from pyspark.ml import PipelineModel
    from keelson.operators.stages import TargetScaler
    from keelson.plans.preprocess import fused_transform
    from keelson.plans.workflow import TargetUnscaleModel
    df = events_frame(spark, sf_dir)
    ts = TargetScaler(targetCol="target").fit(df)
    bundle = PipelineModel([_literal_predictor(),
                            TargetUnscaleModel(col="prediction", mean=ts.v("means")[0], std=ts.v("stds")[0])])
    return r6(fused_transform(bundle, df).select("event_id", "prediction"))


def _literal_bundle(spark, sf_dir):
    """Fitted preprocessing + literal coefficients + fitted target inverse."""
    from pyspark.ml import PipelineModel
    from keelson.operators.model import HuberPredictorModel
    from keelson.plans.workflow import TargetUnscaleModel
    df, fp = _fit_preprocess(spark, sf_dir)
    coefs = {"click_score": 0.5, "k": 1.25, "value": -0.75, "value_na": 0.3, "parity_odd": 0.2,
             "event_type_error": 0.1, "event_type_purchase": -0.1, "event_type_signup": 0.05,
             "event_type_view": -0.05}
    cols = fp.feature_cols
    model = HuberPredictorModel(featureCols=cols, coefficients=[coefs.get(c, 0.0) for c in cols], intercept=0.125)
    ts = fp.target_scaler
    return df, PipelineModel(list(fp.pipeline.stages) + [
        model, TargetUnscaleModel(col="prediction", mean=ts.v("means")[0], std=ts.v("stds")[0])])


BUNDLE_SQL = _a15(False, with_target=True)
LITERAL_BUNDLE_RAW = """WITH x AS (""" + BUNDLE_SQL + """),
t AS (SELECT avg(target) AS m, stddev_pop(target) AS s FROM x)
SELECT event_id, (0.125 + 0.5 * click_score + 1.25 * k - 0.75 * value + 0.3 * value_na + 0.2 * parity_odd
        + 0.1 * event_type_error - 0.1 * event_type_purchase + 0.05 * event_type_signup
        - 0.05 * event_type_view) * s + m AS prediction
FROM x, t"""
LITERAL_BUNDLE_SQL = "SELECT event_id, round(prediction, 6) + 0.0 AS prediction FROM (" + LITERAL_BUNDLE_RAW + ")"


@check("predictions_table", LITERAL_BUNDLE_SQL)
def q_predictions_table(spark, sf_dir):
    from keelson.plans.workflow import predict
    df, bundle = _literal_bundle(spark, sf_dir)
    return r6(predict(bundle, df, events_spec()))


@check("r2", """WITH """ + EV_SQL + """,
p AS (SELECT ev.target, 1.5 + 0.25 * e.value - 2.0 * ev.k AS prediction FROM ev JOIN events e USING (event_id))
SELECT round(1.0 - sum((target - prediction) * (target - prediction)) / (var_pop(target) * count(target)), 6) + 0.0 AS r2
FROM p""")
def q_r2(spark, sf_dir):
    """R^2 over every row (the predictor reads the raw ``value``, which has no null)."""
    from keelson.operators.model import HuberPredictorModel, r2_expr
    df = events_frame(spark, sf_dir, raw_value=True)
    p = HuberPredictorModel(featureCols=["raw_value", "k"], coefficients=[0.25, -2.0], intercept=1.5).transform(df)
    return r6(p.agg(r2_expr(F.col("target"), F.col("prediction")).alias("r2")))


def _trial_sql(name: str) -> str:
    return f"(('0x' || substr(md5('5|' || number || '|{name}'), 1, 13))::BIGINT / {16.0 ** 13})"


@check("tune", f"""WITH RECURSIVE {_features_sql(MODEL_TERMS, 0.1)},
trials AS (SELECT number AS trial, exp(ln(1e-6) + {_trial_sql('alpha')} * (ln(1.0) - ln(1e-6))) AS alpha,
                  1.0 + {_trial_sql('epsilon')} AS eps FROM range(20) t(number)),
{_newton_sql(len(MODEL_TERMS))}
SELECT CAST(trial AS BIGINT) AS number, round(alpha, 6) + 0.0 AS params_alpha, round(eps, 6) + 0.0 AS params_epsilon,
       round(-(1.0 - sum((q - y) * (q - y)) / (var_pop(y) * count(*))), 6) + 0.0 AS value
FROM (SELECT trial, alpha, eps, y, {_predicted_sql(len(MODEL_TERMS))} AS q FROM fitted JOIN x ON x.val) GROUP BY trial, alpha, eps""")
def q_tune(spark, sf_dir):
    """All trials of the reference's search (20, over alpha, log-uniform, and epsilon, uniform) and their values."""
    from keelson.operators.sample import split_train_val
    from keelson.operators.tune import tune
    from keelson.plans.preprocess import Preprocessor
    from keelson.plans.workflow import scaled
    df = events_frame(spark, sf_dir)
    tr_raw, va_raw = split_train_val(df, "event_id", 0.1)
    fp = Preprocessor(events_spec()).fit(tr_raw)
    res = tune(spark, scaled(fp, fp.source), scaled(fp, va_raw), fp.feature_cols, "target", num_trials=20)
    return r6(res.trials)


# ----------------------------------------------------------------------------
# 2.7 workflows
@check("train", f"""WITH RECURSIVE {_features_sql(MODEL_TERMS, 0.1)}, {ONE_TRIAL}, {_newton_sql(len(MODEL_TERMS))}
SELECT event_id, round(y, 6) + 0.0 AS target, round({_predicted_sql(len(MODEL_TERMS))}, 6) + 0.0 AS prediction
FROM x, fitted WHERE val""")
def q_train(spark, sf_dir):
    """The validation rows with the scaled target and the trained model's prediction of it."""
    from keelson.plans.workflow import train
    res = train(events_frame(spark, sf_dir), events_spec())
    return r6(res.model.transform(res.validation).select("event_id", "target", "prediction"))


FILE_TERMS = [*[f"event_type_{t}" for t in EVENT_TYPES], "k", "value", "value_na"]


@check("train_and_score_files", f"""WITH RECURSIVE {_features_sql(FILE_TERMS, 0.2)}, {ONE_TRIAL}, {_newton_sql(len(FILE_TERMS))}
SELECT event_id, round(({_predicted_sql(len(FILE_TERMS))}) * ts + tm, 4) + 0.0 AS score FROM x, fitted""")
def q_train_and_score_files(spark, sf_dir):
    """The user's path: a CSV folder and a JSON description in, artifacts, a CSV folder of predictions out."""
    import json

    from keelson.plans.workflow import run_batch_predictions, run_training
    from keelson.session import scratch_dir
    df = events_frame(spark, sf_dir).select("event_id", "value", "k", "event_type", "target")
    folder = scratch_dir(spark, "files")
    df.write.option("header", True).csv(f"{folder}/train")
    df.drop("target").write.option("header", True).csv(f"{folder}/test")
    feature = lambda n, t, **kw: dict(name=n, dataType=t, description=n, **kw)       # noqa: E731
    described = {"title": "events", "description": "events", "modelCategory": "regression", "schemaVersion": 1.0,
                 "inputDataFormat": "CSV", "id": {"name": "event_id", "description": "id"},
                 "target": {"name": "target", "description": "target", "example": 1.0},
                 "features": [feature("value", "NUMERIC", example=1.0, nullable=True),
                              feature("k", "NUMERIC", example=1.0, nullable=False),
                              feature("event_type", "CATEGORICAL", categories=EVENT_TYPES, nullable=True)]}
    settings = {"prediction_field_name": "score", "validation_split": 0.2, "seed_value": 7}
    for name, document in (("spec", described), ("settings", settings)):
        spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    run_training(spark, f"{folder}/train", f"{folder}/spec", f"{folder}/artifacts", model_config_path=f"{folder}/settings")
    run_batch_predictions(spark, f"{folder}/test", f"{folder}/spec", f"{folder}/artifacts", f"{folder}/out",
                          model_config_path=f"{folder}/settings")
    out = spark.read.option("header", True).schema("event_id bigint, score double").csv(f"{folder}/out")
    return out.select("event_id", (F.round("score", 4) + F.lit(0.0)).alias("score"))


@check("score_batch", "SELECT event_id, round(prediction, 4) + 0.0 AS prediction FROM (" + LITERAL_BUNDLE_RAW + ")")
def q_score_batch(spark, sf_dir):
    from keelson.plans.workflow import load_bundle, save_bundle, score_batch
    from keelson.session import scratch_dir
    df, bundle = _literal_bundle(spark, sf_dir)
    path = scratch_dir(spark, "bundle")
    save_bundle(bundle, path)
    out = scratch_dir(spark, "score_batch")
    score_batch(df.drop("target"), events_spec(), load_bundle(path), output_dir=out)
    return r6(spark.read.option("header", True).schema("event_id bigint, prediction double").csv(out))


@check("score_stream", "WITH x AS (" + LITERAL_BUNDLE_RAW + """)
SELECT CAST(x.event_id // 50 AS VARCHAR) AS requestId, 'success' AS status, CAST(x.event_id AS VARCHAR) AS sampleId,
       round(x.prediction, 5) + 0.0 AS prediction
FROM x
UNION ALL
SELECT CAST(x.event_id // 50 AS VARCHAR), 'success', CAST(x.event_id AS VARCHAR), round(x.prediction, 5) + 0.0
FROM x WHERE x.event_id // 50 % 20 = 0
UNION ALL SELECT substr(md5('no separator'), 1, 10), 'error', NULL, NULL
UNION ALL SELECT 'bad', 'error', NULL, NULL""")
def q_score_stream(spark, sf_dir):
    from keelson.session import scratch_dir
    from keelson.sources.requests import requests_from_table
    from keelson.streaming import score_stream
    df, bundle = _literal_bundle(spark, sf_dir)
    spec = events_spec()
    req_spec = DatasetSpec(spec.id, spec.target, spec.features, spec.target_description)
    docs = requests_from_table(df, req_spec, F.expr("event_id div 50"))
    src = scratch_dir(spark, "requests")
    # one request per line: "<requestId>\t<document>"
    lines = docs.select(F.concat_ws("\t", "requestId", "value").alias("value"), F.col("requestId").cast("bigint").alias("r"))
    # every twentieth request is there twice, and two lines are no requests
    lines.select("value").unionByName(lines.where("r % 20 = 0").select("value")).unionByName(
        spark.createDataFrame([("no separator",), ("bad\tnot json {",)], "value string")).write.text(src)
    sink, ckpt = scratch_dir(spark, "responses"), scratch_dir(spark, "stream-ckpt")
    q = score_stream(spark, src, req_spec, bundle, sink, ckpt, id_separator="\t")
    if not q.awaitTermination(STREAM_TIMEOUT_S):
        q.stop()
        raise TimeoutError(f"score_stream did not drain its input within {STREAM_TIMEOUT_S} s")
    out = spark.read.schema("requestId string, json string, status string").json(sink)
    r = out.select(F.from_json("json", "requestId string, status string, "
                                       "predictions array<struct<sampleId:string,prediction:double>>").alias("r"))
    return r.select(F.col("r.requestId").alias("requestId"), F.col("r.status").alias("status"),
                    F.explode_outer("r.predictions").alias("p")) \
        .select("requestId", "status", F.col("p.sampleId").alias("sampleId"),
                (F.col("p.prediction") + F.lit(0.0)).alias("prediction"))
