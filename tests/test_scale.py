"""Scale properties: results independent of partitioning; plans without
shuffles or Python where none is needed; projections pruned at the scan."""



from conftest import SF_SMALL
from keelson.plans import catalog as C
from keelson.plans.preprocess import Preprocessor, fused_transform
from keelson.plans.workflow import predict


def _fit_on(df):
    fp = Preprocessor(C.events_spec()).fit(df)
    out = fused_transform(fp.pipeline, df).drop("target")
    return fp, sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.collect())


def test_preprocess_same_for_1_4_64_partitions(spark):
    base = C.events_frame(spark, SF_SMALL)
    results = [_fit_on(base.repartition(n)) for n in (1, 4, 64)]
    reports = [r[0].report for r in results]
    assert reports[0] == reports[1] == reports[2]
    assert results[0][1] == results[1][1] == results[2][1]


def test_score_batch_plan_is_one_projection(spark):
    df, bundle = C._literal_bundle(spark, SF_SMALL)
    plan = predict(bundle, df, C.events_spec())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan
    assert "Python" not in plan and "BatchEvalPython" not in plan
    assert "WholeStageCodegen" in plan or "*(" in plan


def test_scan_prunes_columns(spark):
    from keelson.operators.stages import ColumnSelector
    ev = C.table(spark, SF_SMALL, "lineitem")
    out = ColumnSelector(columns=["l_quantity"], passthrough=["l_orderkey"]).transform(ev).where("l_quantity > 10")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan


def test_frequency_table_partial_aggregation(spark):
    from keelson.functions.profile import frequency_table
    plan = frequency_table(C.table(spark, SF_SMALL, "part"), ["p_brand", "p_type"]) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2  # partial (map side) + final


def test_split_is_partitioning_independent(spark):
    from keelson.operators.sample import split_train_val
    ev = C.table(spark, SF_SMALL, "events")
    a = sorted(r.event_id for r in split_train_val(ev.repartition(1), "event_id", 0.1)[1].collect())
    b = sorted(r.event_id for r in split_train_val(ev.repartition(13), "event_id", 0.1)[1].collect())
    assert a == b and len(a) > 0
