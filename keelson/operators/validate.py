"""Data validation as aggregates.

Every data rule of a table is evaluated in fused aggregates (codegen-sized
column chunks, plus one group-by for ID uniqueness, run concurrently) and
returned as a violations DataFrame
``(rule, column, n_violations)``; ``strict=True`` raises on the first violated
rule in the reference order, with the reference's messages.  ``quarantine``
returns the offending rows instead.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.exprs import is_not_number, qcol
from keelson.functions.profile import chunked_aggregate
from keelson.spec import DatasetSpec

VIOLATION_SCHEMA = "rule string, column string, n_violations bigint"

# The reference's validation messages (the last two belong to our opt-in rules).
PREFIX = "Data validation failed: "
MESSAGES = {
    "id_present": "ID field '{column}' is not present in the given data",
    "unique_id": "ID field '{column}' does not contain unique values",
    "target_present": "Target field '{column}' is not present in the given data",
    "feature_present": "Feature '{column}' is not present in the given data",
    "non_null": "Non-nullable feature '{column}' contains null values",
    "numeric": "Numeric feature '{column}' contains non-numeric data",
    "category": "Categorical feature '{column}' contains values outside its categories",
    "target_numeric": "Target field '{column}' contains null or non-numeric values",
}

class ValidationError(ValueError):
    pass


def _numeric_violation(c: str, dt: T.DataType) -> Column | None:
    """Count expression for values that are neither null nor real numbers."""
    if isinstance(dt, (T.NumericType, T.BooleanType)):
        return None  # the physical type guarantees it: no job needed
    if isinstance(dt, T.StringType):
        return F.count_if(is_not_number(qcol(c)))
    return F.count_if(qcol(c).isNotNull())


def _rows(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, VIOLATION_SCHEMA)


def check_columns(df: DataFrame, spec: DatasetSpec, is_train: bool) -> list[tuple]:
    """val_columns: metadata only, no job."""
    out = []
    if spec.id not in df.columns:
        out.append(("id_present", spec.id, 1))
    if is_train and spec.target not in df.columns:
        out.append(("target_present", spec.target, 1))
    for f in spec.feature_names:
        if f not in df.columns:
            out.append(("feature_present", f, 1))
    return out


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """IDs that occur more than once, with their counts (one shuffle; a hot ID
    is collapsed by the map-side partial aggregate).  NULL ids count as
    duplicates of each other."""
    return df.groupBy(qcol(id_col).alias(id_col)).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def rule_aggregates(df: DataFrame, spec: DatasetSpec, is_train: bool = True, check_categories: bool = False,
                    check_target: bool = False) -> list[tuple[str, str, Column]]:
    """(rule, column, count of violating rows) of every rule about single rows that the types do not settle."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for f in spec.non_nullable_features:
        if f in df.columns:
            aggs.append(("non_null", f, F.count_if(qcol(f).isNull())))
    for f in spec.numeric_features:
        if f in df.columns:
            e = _numeric_violation(f, types[f])
            if e is not None:
                aggs.append(("numeric", f, e))
    if check_categories:
        for f in spec.categorical_features:
            if f in df.columns:
                aggs.append(("category", f, F.count_if(qcol(f).isNotNull()
                                                       & ~qcol(f).cast("string").isin(spec.categories(f)))))
    if check_target and is_train and spec.target in df.columns:
        t = spec.target
        bad = qcol(t).isNull() if isinstance(types[t], T.NumericType) else \
            (qcol(t).isNull() | (is_not_number(qcol(t)) if isinstance(types[t], T.StringType) else F.lit(True)))
        aggs.append(("target_numeric", spec.target, F.count_if(bad)))
    return aggs


def repeated_ids(df: DataFrame, id_col: str) -> int:
    """Rows beyond the first of their ID."""
    return int(duplicate_ids(df, id_col).agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("n")).first()["n"])


def violations(df: DataFrame, spec: DatasetSpec, is_train: bool = True, strict: bool = False,
               check_unique_id: bool = True, check_categories: bool = False,
               check_target: bool = False) -> DataFrame:
    """All violated rules as a DataFrame (rule, column, n_violations).

    Reference order: id present, id unique, target present, features present,
    non-nullable features without nulls, numeric features numeric.
    Opt-in extras (not checked by the reference on batch data): category
    membership and a non-null numeric target.
    """
    spark = df.sparkSession
    rows = list(check_columns(df, spec, is_train))
    aggs = rule_aggregates(df, spec, is_train, check_categories, check_target)

    def rule_counts():
        r = chunked_aggregate(df, [(f"a{i}", e, 1) for i, (_, _, e) in enumerate(aggs)])
        return [(rule, c, int(r[f"a{i}"])) for i, (rule, c, _) in enumerate(aggs)]

    def unique_id():
        if spec.id not in df.columns or not check_unique_id:
            return []
        return [("unique_id", spec.id, repeated_ids(df, spec.id))]

    # the ID group-by and the fused rule aggregates run as concurrent jobs
    with ThreadPoolExecutor(max_workers=2) as pool:
        f_unique, f_rules = pool.submit(unique_id), pool.submit(rule_counts)
        rows += f_unique.result() + f_rules.result()
    rows = [r for r in rows if r[2] > 0]
    if strict:
        raise_first([dict(rule=r[0], column=r[1]) for r in rows])
    return _rows(spark, rows)


_ORDER = ["id_present", "unique_id", "target_present", "feature_present", "non_null", "numeric",
          "category", "target_numeric"]


def message(rule: str, column: str) -> str:
    return MESSAGES[rule].format(column=column)


def raise_first(rows) -> None:
    if not rows:
        return
    first = sorted(rows, key=lambda r: _ORDER.index(r["rule"]))[0]
    raise ValidationError(PREFIX + message(first["rule"], first["column"]))


def validate(df: DataFrame, spec: DatasetSpec, is_train: bool = True, **kw) -> DataFrame:
    """Raise on the first violated rule; return ``df`` unchanged otherwise."""
    violations(df, spec, is_train, strict=True, **kw)
    return df


def quarantine(df: DataFrame, spec: DatasetSpec, check_unique_id: bool = True, check_categories: bool = False,
               check_target: bool = False, is_train: bool = True) -> DataFrame:
    """Rows breaking a row-level rule of ``violations`` (same switches), with a ``reasons`` array column.

    Every row of a repeated ID is listed; the join on the repeated IDs is left to AQE."""
    types = schema = {f.name: f.dataType for f in df.schema.fields}
    reasons = []

    def add(cond: Column, rule: str, column: str) -> None:
        reasons.append(F.when(cond, F.lit(f"{rule}:{column}")))

    for f in spec.non_nullable_features:
        if f in schema:
            add(qcol(f).isNull(), "non_null", f)
    for f in spec.numeric_features:
        if f in schema and not isinstance(types[f], (T.NumericType, T.BooleanType)):
            add(is_not_number(qcol(f)) if isinstance(types[f], T.StringType) else qcol(f).isNotNull(), "numeric", f)
    if check_categories:
        for f in spec.categorical_features:
            if f in schema:
                add(qcol(f).isNotNull() & ~qcol(f).cast("string").isin(spec.categories(f)), "category", f)
    if check_target and is_train and spec.target in schema:
        t = spec.target
        add(qcol(t).isNull() | (F.lit(False) if isinstance(types[t], T.NumericType) else is_not_number(qcol(t))
                                if isinstance(types[t], T.StringType) else F.lit(True)), "target_numeric", t)
    out = df
    if check_unique_id and spec.id in schema:
        dups = duplicate_ids(df, spec.id).select(qcol(spec.id).alias("__dup_id"), F.lit(True).alias("__dup"))
        out = out.join(dups, qcol(spec.id).eqNullSafe(F.col("__dup_id")), "left").drop("__dup_id")
        add(F.col("__dup").isNotNull(), "unique_id", spec.id)
    if not reasons:
        return df.limit(0).withColumn("reasons", F.array().cast("array<string>"))
    out = out.withColumn("reasons", F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    return out.where(F.size("reasons") > 0).drop("__dup")


def validate_predictions(df: DataFrame, spec: DatasetSpec, prediction_field: str = "prediction") -> DataFrame:
    """val_predictions: not empty, has the ID and prediction columns."""
    if spec.id not in df.columns:
        raise ValidationError(f"ID field '{spec.id}' is not present in predictions")
    if prediction_field not in df.columns:
        raise ValidationError(f"Prediction field '{prediction_field}' is not present in predictions")
    if df.isEmpty():
        raise ValidationError("The provided predictions DataFrame is empty.")
    return df
