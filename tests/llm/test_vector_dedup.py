import duckdb
import numpy as np
import pytest
from cases import odd_vectors
from conftest import SF_SMALL
from keelson.llm import queries, vector_dedup


def brute(rows: list, threshold: float = 0.9) -> dict:
    """[(id, vector)] -> {row place: (id, n_links, component_id, kept)} from all pairs' cosines."""
    length = max(map(len, (v for _, v in rows if usable(v))), key=[len(v) for _, v in rows if usable(v)].count)
    live = [k for k, (_, v) in enumerate(rows) if usable(v) and len(v) == length]
    x = np.array([rows[k][1] for k in live])
    norm = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T) / np.outer(norm, norm) >= threshold - 1e-13
    np.fill_diagonal(near, False)
    out = {k: (i, 0, i, True) for k, (i, _) in enumerate(rows)}
    seen = set()
    for s in range(len(live)):
        if s in seen:
            continue
        group, todo = {s}, [s]
        while todo:
            for t in np.flatnonzero(near[todo.pop()]).tolist():
                if t not in group:
                    group.add(t), todo.append(t)
        seen |= group
        least = min((rows[live[t]][0] for t in group if rows[live[t]][0] is not None), default=None)
        for t in group:
            i = rows[live[t]][0]
            out[live[t]] = (i, int(near[t].sum()), least, i == least)
    return out


def usable(v) -> bool:
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


def _key(t):
    return tuple((v is None, v or 0) for v in t)


def check(df, rows, threshold=0.9):
    got = sorted((tuple(r) for r in vector_dedup.near_duplicates(df, threshold=threshold).collect()), key=_key)
    assert got == sorted(brute(rows, threshold).values(), key=_key)


def test_query_equals_sql_and_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op13_vector_dedup(spark, SF_SMALL).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
    assert got == sorted(con.sql(queries.OP13_SQL).fetchall())


def clustered(n: int, d: int, seed: int) -> list:
    """A third of the rows in one dense group, some chains, exact copies, scaled copies and plain noise."""
    rnd = np.random.default_rng(seed)
    hot, rows = rnd.normal(size=d), []
    for i in range(n):
        if i % 3 == 0:
            v = hot + rnd.normal(size=d) * 0.12
        elif i % 11 == 0:
            v = np.array(rows[rnd.integers(len(rows))][1])
        elif i % 7 == 0:
            v = np.array(rows[rnd.integers(len(rows))][1]) + rnd.normal(size=d) * 0.3
        elif i % 5 == 0:
            v = 3 * np.array(rows[rnd.integers(len(rows))][1])
        else:
            v = rnd.normal(size=d)
        rows.append((i, v.tolist()))
    return rows


@pytest.mark.parametrize("n,d,block,dense", [(900, 40, 64, 0.05), (700, 40, 50, 2.0), (300, 3, 64, 0.05), (400, 20, 1024, 0.0)])
def test_blocks_levels_and_hot_groups(spark, monkeypatch, n, d, block, dense):
    """Small blocks and strips, progressive comparison alone or full products, low and high dimensions."""
    for name, value in (("BLOCK", block), ("STRIP", 2), ("SLICE", 2), ("DENSE", dense), ("LEAD", 8)):
        monkeypatch.setattr(vector_dedup, name, value)
    rows = clustered(n, d, n)
    check(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5), rows)


def test_far_blocks_never_meet(spark, monkeypatch):
    """Clusters on the axes: block pairs of different clusters are left out, links are not."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 20)
    monkeypatch.setattr(vector_dedup, "STRIP", 1)
    rnd = np.random.default_rng(1)
    rows = [(i, (np.eye(6)[i % 6] + rnd.normal(size=6) * 0.05).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    points = vector_dedup.stored(df.selectExpr("embedding AS vec", "1L AS size", "vec_id AS h"), "test-points")
    axes = vector_dedup.share(spark, vector_dedup.principal_axes(points, 6))
    blocks = vector_dedup.stored(vector_dedup.blocks_of(points, 6, axes), "test-blocks")
    n, met = blocks.count(), vector_dedup.block_pairs(blocks, 6, 0.9).collect()
    assert len(met) == len(set(met)) and len(met) < 0.5 * n * (n + 1) / 2
    check(df, rows)


def test_threshold_is_met_exactly(spark):
    """Whole-number vectors whose cosine is the threshold itself, or just below it; very large and small ones."""
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.000000000001]), (4, [-1.0, 0.0]), (5, [8.0, 0.0]),
            (6, [0.0, -1e300]), (7, [0.0, -1e-300])]
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), threshold=0.6).collect()}
    assert [got[i]["n_links"] for i in range(1, 8)] == [2, 3, 1, 0, 2, 1, 1]
    assert [got[i]["component_id"] for i in range(1, 8)] == [1, 1, 1, 4, 1, 6, 6]


def test_odd_rows(spark):
    df = odd_vectors(spark, 8)
    check(df, [(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0
    none = vector_dedup.near_duplicates(df.filter("embedding is null")).collect()
    assert {r["n_links"] for r in none} == {0} and all(r["kept"] for r in none)
