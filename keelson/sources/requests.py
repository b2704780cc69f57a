"""Scoring requests and responses as JSON columns.

A request is one JSON document ``{"instances": [{...}, ...]}`` in one row.
It is parsed with ``from_json``; checks and scoring run with higher-order
functions over the ``instances`` array, so a request stays in its row from
parse to response (no explode, no regrouping, no state: the same code serves
batch and streaming).  ``explode_instances`` gives the one-row-per-instance
form, and ``responses_from_predictions`` regroups such rows when needed.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.exprs import is_not_number, text_number
from keelson.operators.base import apply_stages
from keelson.spec import NUMERIC, DatasetSpec

# Response fields and texts.
STATUS_OK = "success"
STATUS_ERROR = "error"
PREDICTION_DECIMALS = 5
MSG_NOT_JSON = "Invalid request: body is not JSON"
MSG_NO_INSTANCES = "instances: field required"
MSG_NOT_LIST = "instances: value is not a valid list of objects"
MSG_EMPTY = "instances: ensure this value has at least 1 items"
MSG_NON_NULLABLE = "Feature `{f}` is non-nullable. Given null value is not allowed."
MSG_CATEGORY = "' not allowed for '{f}'.Allowed values: {cats}"
CATEGORY_TABLE = "those of the category table"      # in place of a list too long to be written out
MSG_DUPLICATE_ID = "Data validation failed: ID field '{id}' does not contain unique values"


def request_schema(spec: DatasetSpec) -> T.StructType:
    """Typed schema of a request document (for writers and documentation)."""
    return spec.request_struct()


SHOWN_ID_CHARS = 10


def shown_id(key: Column) -> Column:
    """The short request ID of a response; ``key`` (the full digest or a given ID) identifies the request."""
    return F.when(key.rlike("^[0-9a-f]{32}$"), F.substring(key, 1, SHOWN_ID_CHARS)).otherwise(key)


def content_key(*parts: Column) -> Column:
    """A full digest of a request's place and text: the same when a task is run again."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _typed_instance(spec: DatasetSpec):
    """One instance map -> typed struct.  Values arrive as JSON text, so numbers
    written as strings ("1.5") are accepted and strings take numbers as their
    text, as the reference's request model coerces them."""
    def build(m):
        fields = [m[spec.id].alias(spec.id)]
        for f in spec.features:
            v = m[f.name]
            fields.append((text_number(v) if f.kind == NUMERIC else v).alias(f.name))
        return F.struct(*fields)
    return build


def parse_requests(df: DataFrame, spec: DatasetSpec, value_col: str = "value",
                   request_id: Column | str | None = None) -> DataFrame:
    """(requestId, value) -> + ``keys`` (instances as string maps: tells a missing
    key from an explicit null, keeps values as text) and ``req.instances`` (typed)."""
    rid = F.col(request_id) if isinstance(request_id, str) else (request_id if request_id is not None
                                                                  else content_key(F.col(value_col)))
    keys = F.from_json(F.col(value_col), "instances array<map<string,string>>")
    return df.select(
        rid.cast("string").alias("requestId"), F.col(value_col).alias("value"),
        F.get_json_object(F.col(value_col), "$").isNotNull().alias("is_json"),
        F.get_json_object(F.col(value_col), "$.instances").isNotNull().alias("has_instances"),
        keys.alias("keys"),
        F.struct(F.transform(keys["instances"], _typed_instance(spec)).alias("instances")).alias("req"))


# Lambda factories: Spark counts a Python lambda's parameters, so closures
# must not carry extra (default) arguments.
def _lacks(key: str):
    return lambda m: ~F.map_contains_key(m, F.lit(key))


def _not_number(key: str):
    return lambda m: is_not_number(m[key])


def _is_null(field: str):
    return lambda i: i[field].isNull()


def _not_in(field: str, cats: list):
    return lambda i: i[field].isNotNull() & ~i[field].isin(cats)


def _first_key(spec_keys: list, pred) -> Column:
    """Name of the first key for which some instance map satisfies ``pred(key)``."""
    return F.coalesce(*[F.when(F.exists(F.col("keys.instances"), pred(k)), F.lit(k)) for k in spec_keys])


def with_category_misses(parsed: DataFrame, allowed: DataFrame) -> DataFrame:
    """``parsed`` with ``misses``, a map from each feature of the table ``allowed`` (feature, value) to the first of a
    request's values (by position) that the table lacks.

    For category lists too long to be literals.  Values are probed by one anti-join, whose form (broadcast or
    shuffled) AQE picks by the measured size of the table; only misses are regrouped by request.  NULL is no miss.
    """
    features = [r["feature"] for r in allowed.select("feature").distinct().collect()]      # columns of a spec: few
    if not features:
        return parsed.withColumn("misses", F.lit(None).cast("map<string,string>"))
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col("i")[f].cast("string").alias("value"))
                                 for f in features]))
    probes = parsed.select("requestId", F.posexplode("req.instances").alias("pos", "i")) \
        .select("requestId", "pos", values.alias("v")).select("requestId", "pos", "v.feature", "v.value").where("value IS NOT NULL")
    first = probes.join(allowed.select("feature", F.col("value").cast("string").alias("value")), ["feature", "value"], "left_anti") \
        .groupBy("requestId", "feature").agg(F.min_by("value", "pos").alias("value"))
    misses = first.groupBy("requestId").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("misses"))
    return parsed.join(misses, "requestId", "left")


def request_checks(spec: DatasetSpec, table_features: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(ok, message) for a parsed request row, rules in the reference's order:
    shape (JSON, instances present, a list of objects, non-empty, all keys,
    numbers where numeric), then non-nullable features, then categories; plus
    unique IDs within a request.  Features of ``table_features`` are judged by
    the ``misses`` of ``with_category_misses`` instead of a list in the spec."""
    inst = F.col("req.instances")
    missing = _first_key([spec.id] + spec.feature_names, _lacks)
    not_number = _first_key(spec.numeric_features, _not_number) if spec.numeric_features else F.lit(None)
    rules: list[tuple[Column, Column]] = [
        (~F.col("is_json"), F.lit(MSG_NOT_JSON)),
        (~F.col("has_instances"), F.lit(MSG_NO_INSTANCES)),
        (F.col("keys.instances").isNull(), F.lit(MSG_NOT_LIST)),
        (F.size(inst) < 1, F.lit(MSG_EMPTY)),
        (missing.isNotNull(), F.concat(F.lit("instances: field required: "), missing)),
        (not_number.isNotNull(), F.concat(F.lit("instances: value is not a valid float: "), not_number)),
    ]
    for f in spec.non_nullable_features:
        rules.append((F.exists(inst, _is_null(f)),
                      F.lit(MSG_NON_NULLABLE.format(f=f))))
    for f in spec.categorical_features:
        cats = spec.categories(f)
        if f in table_features:
            miss = F.col("misses")[f]
            rules.append((miss.isNotNull(), F.concat(F.lit("Value '"), miss, F.lit(MSG_CATEGORY.format(f=f, cats=CATEGORY_TABLE)))))
            continue
        if not cats:
            continue
        bad = F.filter(inst, _not_in(f, cats))
        rules.append((F.size(bad) > 0,
                      F.concat(F.lit("Value '"), bad[0][f], F.lit(MSG_CATEGORY.format(f=f, cats=cats)))))
    ids = F.transform(inst, lambda i: i[spec.id])
    rules.append((F.size(F.array_distinct(ids)) < F.size(ids),
                  F.lit(MSG_DUPLICATE_ID.format(id=spec.id))))
    message = None
    for cond, msg in rules:
        message = F.when(cond, msg) if message is None else message.when(cond, msg)
    message = message.otherwise(F.lit(None))
    return message.isNull(), message


def instance_prediction(stages, spec: DatasetSpec, i: Column) -> Column:
    """The fitted scoring stages applied to the fields of one instance struct."""
    cols = OrderedDict((f, i[f]) for f in [spec.id] + spec.feature_names)
    types = {f.name: (T.DoubleType() if f.kind == NUMERIC else T.StringType()) for f in spec.features}
    types[spec.id] = T.StringType()
    out = apply_stages(stages, cols, types)
    return out["prediction"]


def score_requests(parsed: DataFrame, spec: DatasetSpec, stages, timestamp: Column | None = None) -> DataFrame:
    """One response per request row: (requestId, response struct, response JSON)."""
    ok, message = request_checks(spec)
    preds = F.transform(F.col("req.instances"), lambda i: F.struct(
        i[spec.id].alias("sampleId"),
        F.round(instance_prediction(stages, spec, i), PREDICTION_DECIMALS).alias("prediction")))
    ts = timestamp if timestamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    resp = F.struct(
        F.when(ok, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_ERROR)).alias("status"),
        F.coalesce(message, F.lit("")).alias("message"),
        ts.alias("timestamp"),
        shown_id(F.col("requestId")).alias("requestId"),
        F.lit(spec.target_description).alias("targetDescription"),
        F.when(ok, preds).alias("predictions"))
    return parsed.select("requestId", resp.alias("response")) \
        .withColumn("json", F.to_json("response", {"ignoreNullFields": "false"}))


def explode_instances(parsed: DataFrame, spec: DatasetSpec) -> DataFrame:
    """src_requests: one row per instance (requestId, pos, id, features...)."""
    fields = [spec.id] + spec.feature_names
    return (parsed.select("requestId", F.posexplode("req.instances").alias("pos", "i"))
            .select("requestId", "pos", *[F.col("i")[f].alias(f) for f in fields]))


def responses_from_predictions(pred: DataFrame, spec: DatasetSpec, prediction_col: str = "prediction",
                               timestamp: Column | None = None) -> DataFrame:
    """sink_responses for the exploded form: regroup (requestId, pos, id,
    prediction) rows into one response per request.  A group is one request,
    bounded by the request's own size."""
    ts = timestamp if timestamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    grouped = pred.groupBy("requestId").agg(F.array_sort(F.collect_list(F.struct(
        F.col("pos"), F.col(spec.id).cast("string").alias("sampleId"),
        F.round(F.col(prediction_col), PREDICTION_DECIMALS).alias("prediction")))).alias("p"))
    resp = F.struct(F.lit(STATUS_OK).alias("status"), F.lit("").alias("message"), ts.alias("timestamp"),
                    shown_id(F.col("requestId")).alias("requestId"), F.lit(spec.target_description).alias("targetDescription"),
                    F.transform("p", lambda x: F.struct(x["sampleId"].alias("sampleId"),
                                                        x["prediction"].alias("prediction"))).alias("predictions"))
    return grouped.select("requestId", resp.alias("response")) \
        .withColumn("json", F.to_json("response", {"ignoreNullFields": "false"}))


def requests_from_table(df: DataFrame, spec: DatasetSpec, group: Column) -> DataFrame:
    """Build request documents from a table (for tests and benchmarks): rows
    sharing ``group`` form one request, instances ordered by ID.  ``group``
    must bound the request size."""
    inst = F.struct(F.col(spec.id).cast("string").alias(spec.id),
                    *[F.col(f).alias(f) for f in spec.feature_names])
    return (df.groupBy(group.alias("requestId"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col(spec.id).alias("__k"), inst.alias("i")))).alias("a"))
            .select(F.col("requestId").cast("string").alias("requestId"),
                    F.to_json(F.struct(F.transform("a", lambda x: x["i"]).alias("instances")),
                              {"ignoreNullFields": "false"}).alias("value")))
