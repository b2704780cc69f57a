"""Tables for the operators' odd cases, and small helpers."""

import random

import duckdb

WORDS = "ash birch cedar dune ember fjord grove heath isle jetty knoll lagoon marsh notch oasis pond quay ridge".split()


def prose(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))


def odd_texts() -> list:
    return [None, "", "   \n\t ", "one", "four words are few", "$$$ %%% !!!", "$$$ %%% !!!", prose(60, 1), prose(60, 1),
            prose(60, 1) + " tail", prose(40_000, 2), "\u0001mark\u0002 \u0000 nul", "Ünïcode ÅÄÖ 日本語 \U0001F600 naïve",
            "a" * 120_000, "9" * 60_000, "1 " * 30_000, "a." * 30_000, "@" * 1000, "-----BEGIN PRIVATE KEY-----" * 200]


def odd_documents(spark, clash: bool = True):
    """Documents with nulls in every column, repeated rows and extra columns named like the operators' own."""
    texts = odd_texts()
    rows = [(i, t, None if i % 3 == 0 else "en" if i % 3 == 1 else "fr", None if i % 5 == 0 else f"s{i % 2}",
             None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "a row without an id", "en", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if clash:
        for name in ("id", "spans", "ids", "key", "size", "shard", "slot", "h", "rep", "score", "lang_pred", "n_words",
                     "items", "decoded", "part", "edge", "base", "row", "kind"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def documents(sf_dir: str) -> dict:
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


def by_id(df, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}


def odd_vectors(spark, d: int):
    """Vectors with nulls, zeros, non-finite components, other lengths, repeats, ties, null ids, clashing columns."""
    rnd = random.Random(11)
    vec = lambda: [rnd.gauss(0, 0.3) for _ in range(d)]
    some = vec()
    rows = [(i, vec(), i % 3) for i in range(40)] + [
        (50, None, 1), (51, [], 1), (52, [0.0] * d, 1), (53, [-0.0] * d, None), (54, [float("nan")] + [0.1] * (d - 1), 1),
        (55, [float("inf")] + [0.1] * (d - 1), 1), (56, [None] + [0.1] * (d - 1), None), (57, [0.5] * (d + 1), 1),
        (58, some, None), (58, some, None), (59, some, 2), (None, some, 1), (None, vec(), None), (None, None, None),
        (60, [2 * v for v in some], 0), (61, [-v for v in some], 0), (62, [0.5] * d, 1), (62, [0.25] * d, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("id", "vec", "code", "error", "h", "size", "n", "of", "component")])
