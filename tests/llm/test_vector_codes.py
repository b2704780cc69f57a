import hashlib

import duckdb
import numpy as np
import pytest
from cases import odd_vectors
from conftest import SF_SMALL
from keelson.llm import queries, vector_codes
from keelson.llm.cover_tree import CoverTree


def brute(rows: list, parts: int = 16, entries: int = 64, rounds: int = 2):
    """(id, label, vector) rows -> ([(id, label, code, error)], codebooks) with every distance computed."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[2])))
    x = np.floor(np.array([r[2] for r in rows]) * 256).astype(np.int64)
    books, digits, errors = [], [], 0
    for part in np.split(x, parts, axis=1):
        book = part[:entries].copy()
        for k in range(rounds + 1):
            square = ((part[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            code = square.argmin(axis=1)
            if k < rounds:
                for e in range(len(book)):
                    if (code == e).any():
                        book[e] = part[code == e].sum(axis=0) // (code == e).sum()
        books.append(book)
        digits.append(code)
        errors = errors + square.min(axis=1)
    text = ["".join(f"{d:02x}" for d in row) for row in np.array(digits).T]
    return [(r[0], r[1], t, int(e)) for r, t, e in zip(rows, text, errors, strict=True)], books


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{SF_SMALL}/embeddings.parquet'").fetchall()
    want, books = brute(rows)
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    got = {tuple(r) for r in queries.op11_vector_codes(spark, SF_SMALL).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()}
    assert got == {(i, code, error, by_label[label], digest) for i, label, code, error in want}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
    assert got == {tuple(r) for r in con.sql(queries.OP11_SQL).fetchall()}


@pytest.mark.parametrize("seed,spread,n", [(1, 30, 3000), (2, 3, 2000), (3, 4000, 1500), (4, 0, 50), (5, 100_000_000, 700)])
def test_tree_assigns_like_brute_force(seed, spread, n):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(-spread, spread + 1, size=(n, 4)) + rnd.integers(-2, 3, size=(n, 1)) * spread
    tree, place = CoverTree.build(x)
    assert (tree.points[place] == x).all() and tree.counts.sum() == n
    entries = np.concatenate([x[:40], x[:5], x[-20:] + 1])             # equal entries among them
    square = ((x[:, None, :].astype(object) - entries[None]) ** 2).sum(axis=2)
    best = np.array([min(range(len(entries)), key=lambda e, row=row: (row[e], e)) for row in square])
    code, sums = tree.assign(entries)
    assert (code[place] == best).all()
    for e in range(len(entries)):
        assert sums[e].tolist() == [int((best == e).sum()), *x[best == e].sum(axis=0).tolist()]


def test_tree_keeps_its_invariants():
    x = np.random.default_rng(7).integers(-50, 50, size=(2000, 4))
    tree, _ = CoverTree.build(x)
    assert len(tree.levels) > 3
    above = None
    for centre, lo, radius in tree.levels:
        hi = np.r_[lo[1:], len(tree.points)]
        for c, a, b, r in zip(centre, lo, hi, radius, strict=True):
            assert a <= c < b and np.isclose(np.sqrt(((tree.points[a:b] - tree.points[c]) ** 2).sum(1)).max(), r)
        if above is not None:
            assert set(above) <= set(centre.tolist()) and len(centre) > len(above)
        above = centre.tolist()


def test_odd_rows(spark):
    df = odd_vectors(spark, 32)
    coded, books = vector_codes.compress(df, parts=4, entries=8)
    kept = [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()
            if r["embedding"] and len(r["embedding"]) == 32 and all(v is not None and np.isfinite(v) for v in r["embedding"])]
    want, want_books = brute(kept, 4, 8)
    key = lambda t: (t[0] is None, t[0] or 0, t[2], t[3])
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(want, key=key)
    assert all((a == b).all() for a, b in zip(books, want_books, strict=True))
    empty, none = vector_codes.compress(df.limit(0))
    assert empty.count() == 0 and none == []
    with pytest.raises(ValueError):
        vector_codes.compress(df, parts=5)


def test_hot_vector_and_small_chunks(spark, monkeypatch):
    """A third of all rows equal, chunks of a few rows: the same codes."""
    monkeypatch.setattr(vector_codes, "CHUNK_BYTES", 8 * 8 * 40)
    rnd = np.random.default_rng(3)
    rows = [(i, i % 3, ([0.25] * 8 if i % 3 == 0 else rnd.normal(size=8).tolist())) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(5)
    coded, _ = vector_codes.compress(df, parts=2, entries=16)
    assert {tuple(r) for r in coded.collect()} == set(brute(rows, 2, 16)[0])
