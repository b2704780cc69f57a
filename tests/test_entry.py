"""Driver contract: entry() runs; a sample of registered queries equals its DuckDB oracle."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["part", "lineitem", "events", "orders", "customer"]
SAMPLE = ["src_requests", "val_unique_id", "val_request_category", "cast_str", "split_train_val_exact",
          "inject_nulls", "median_impute", "mode_impute", "rare_label", "one_hot", "drop_duplicate",
          "preprocess_fit_transform", "predictions_table", "r2"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "event_id" in df.columns


def test_every_oracle_key_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple("None" if v is None else (f"{round(float(v), 6):.6f}" if isinstance(v, float) else str(v))
                         for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = _norm(tuple(r[c] for c in cols) for r in sdf.collect())
    rel = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    exp = _norm(tuple(r[i] for i in idx) for r in rel.fetchall())
    assert got == exp


def test_every_registered_query_runs(spark):
    """All registered queries execute on the smallest tables and return rows."""
    empty_ok = set()  # none expected
    failures = {}
    for name, fn in E.queries().items():
        try:
            n = fn(spark, SF_SMALL).count()
            if n == 0 and name not in empty_ok:
                failures[name] = "no rows"
        except Exception as e:  # noqa: BLE001
            failures[name] = f"{type(e).__name__}: {str(e)[:200]}"
    assert not failures, failures
