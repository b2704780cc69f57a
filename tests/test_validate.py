"""Validation rules: violations table, strict errors with the reference's messages, quarantine."""

import pytest

from keelson.operators.validate import ValidationError, quarantine, validate, validate_predictions, violations
from keelson.spec import DatasetSpec, Feature

SPEC = DatasetSpec("id", "target", (Feature("n1", "NUMERIC", True, example=1.0),
                                    Feature("n2", "NUMERIC", False, example=1.0),
                                    Feature("c1", "CATEGORICAL", False, ("A", "B"))))


def test_clean_table_passes(spark):
    df = spark.createDataFrame([(1, None, 1.0, "A", 1.0), (2, 2.0, 2.0, "B", 2.0)],
                               "id int, n1 double, n2 double, c1 string, target double")
    assert violations(df, SPEC).count() == 0
    assert validate(df, SPEC) is df


def test_each_rule(spark):
    df = spark.createDataFrame([(1, "x", None, "Z", 1.0), (1, "2", 2.0, None, 2.0), (3, None, 1.0, "A", None)],
                               "id int, n1 string, n2 double, c1 string, target double")
    got = {(r.rule, r.column): r.n_violations for r in violations(df, SPEC, check_categories=True,
                                                                   check_target=True).collect()}
    assert got == {("unique_id", "id"): 1, ("non_null", "n2"): 1, ("non_null", "c1"): 1,
                   ("numeric", "n1"): 1, ("category", "c1"): 1, ("target_numeric", "target"): 1}
    with pytest.raises(ValidationError, match="Data validation failed: ID field 'id' does not contain unique values"):
        validate(df, SPEC)


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, 1.0)], "id int, n2 double")
    with pytest.raises(ValidationError, match="Target field 'target' is not present"):
        validate(df, SPEC, is_train=True)
    with pytest.raises(ValidationError, match="Feature 'n1' is not present"):
        validate(df, SPEC, is_train=False)
    with pytest.raises(ValidationError, match="ID field 'id' is not present"):
        validate(df.drop("id"), SPEC, is_train=False)


def test_quarantine_rows(spark):
    df = spark.createDataFrame([(1, "x", 1.0, "A"), (1, "2", 2.0, "B"), (3, "3", None, "A"), (4, "4", 4.0, "A")],
                               "id int, n1 string, n2 double, c1 string")
    q = {r.n1: sorted(r.reasons) for r in quarantine(df, SPEC).collect()}
    assert q == {"x": ["numeric:n1", "unique_id:id"], "2": ["unique_id:id"], "3": ["non_null:n2"]}


def test_validate_predictions(spark):
    ok = spark.createDataFrame([(1, 0.5)], "id int, prediction double")
    validate_predictions(ok, SPEC)
    with pytest.raises(ValidationError):
        validate_predictions(ok.limit(0), SPEC)
    with pytest.raises(ValidationError):
        validate_predictions(ok.drop("prediction"), SPEC)


def test_quarantine_lists_every_row_of_a_repeated_id(spark):
    df = spark.createDataFrame([(1, "x", 1.0, "A"), (1, "2", 2.0, "B"), (3, "3", None, "A"), (4, "4", 4.0, "A")],
                               "id int, n1 string, n2 double, c1 string")
    q = quarantine(df, SPEC)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan or "AdaptiveSparkPlan" in plan
    assert {r.n1: sorted(r.reasons) for r in q.collect()} == \
        {"x": ["numeric:n1", "unique_id:id"], "2": ["unique_id:id"], "3": ["non_null:n2"]}
