"""Column profiles for many columns at once.

Whole-column statistics (counts, moments, extremes, fingerprints) are wide
aggregates.  One ``agg`` over hundreds of expressions loses whole-stage
codegen (its buffer passes ``spark.sql.codegen.maxFields``) and is then
interpreted row by row; exploding rows into (column, value) pairs keeps codegen
but multiplies the rows.  Measured on 600k rows x 120 columns, both cost about
6x the CPU of **column chunks**: several aggregates, each with a buffer small
enough for codegen, submitted concurrently.  Parquet is columnar, so the chunks
together read each column once.

Label frequencies are different: they need a group-by on the label, so the
categorical columns are exploded to (column index, label) and aggregated with
map-side partial aggregation (a hot label is one row per task in the shuffle).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.exprs import qcol

# aggregation buffer fields per chunk: below spark.sql.codegen.maxFields (100)
CHUNK_FIELDS = 96
CHUNK_THREADS = 8

# buffer fields of the aggregates used here
FIELDS = {"count": 1, "count_if": 1, "sum": 1, "avg": 2, "min": 1, "max": 1, "var": 3, "covar": 4, "bit_xor": 1}


def chunked_aggregate(df: DataFrame, exprs: list[tuple[str, Column, int]],
                      max_fields: int = CHUNK_FIELDS, threads: int = CHUNK_THREADS) -> dict:
    """Evaluate ``(alias, aggregate expression, buffer fields)`` over ``df`` in
    codegen-sized chunks (concurrent jobs); returns alias -> value."""
    chunks, cur, used = [], [], 0
    for alias, expr, fields in exprs:
        if cur and used + fields > max_fields:
            chunks.append(cur)
            cur, used = [], 0
        cur.append(expr.alias(alias))
        used += fields
    if cur:
        chunks.append(cur)
    if not chunks:
        return {}

    def run(chunk):
        return df.agg(*chunk).first().asDict()

    out: dict = {}
    if len(chunks) == 1:
        out.update(run(chunks[0]))
        return out
    with ThreadPoolExecutor(max_workers=min(threads, len(chunks))) as pool:
        for part in pool.map(run, chunks):
            out.update(part)
    return out


def numeric_profile(df: DataFrame, cols: list[str], extremes: bool = True) -> dict[str, dict]:
    """Per column: n (rows), count (non-null), mean, std_pop, var_samp and, with
    ``extremes``, min and max."""
    if not cols:
        return {}
    exprs = [("__n", F.count(F.lit(1)), 1)]
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        exprs += [(f"c{i}", F.count(x), 1), (f"m{i}", F.avg(x), 2), (f"v{i}", F.var_pop(x), 3)]
        if extremes:
            exprs += [(f"lo{i}", F.min(x), 1), (f"hi{i}", F.max(x), 1)]
    r = chunked_aggregate(df, exprs)
    out = {}
    for i, c in enumerate(cols):
        cnt, vp = r[f"c{i}"], r[f"v{i}"]
        out[c] = dict(n=r["__n"], count=cnt, mean=r[f"m{i}"], std_pop=None if vp is None else max(vp, 0.0) ** 0.5,
                      var_samp=None if vp is None or cnt < 2 else vp * cnt / (cnt - 1),
                      min=r.get(f"lo{i}"), max=r.get(f"hi{i}"))
    return out


def null_counts(df: DataFrame, cols: list[str]) -> tuple[int, dict]:
    """(rows, non-null count per column)."""
    r = chunked_aggregate(df, [("__n", F.count(F.lit(1)), 1)] +
                          [(f"c{i}", F.count(qcol(c)), 1) for i, c in enumerate(cols)])
    return r["__n"], {c: r[f"c{i}"] for i, c in enumerate(cols)}


def long_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, v) rows, nulls kept, values as double (used by exact quantiles)."""
    wide = df.select(*[qcol(c).cast("double").alias(f"__{i}") for i, c in enumerate(cols)])
    long = wide.unpivot([], [f"__{i}" for i in range(len(cols))], "__idx", "v")
    mapping = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"__{i}"), F.lit(c))])
    return long.select(mapping[F.col("__idx")].alias("col"), "v")


def frequency_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long frequency table (col, value, cnt) of string-valued columns.

    NULL is its own value row.  Rows are exploded to (column index, label) and
    aggregated by that pair (an integer key hashes cheaper than the name); the
    map-side partial aggregate collapses hot labels before the exchange.
    """
    entries = [F.struct(F.lit(i).alias("k"), qcol(c).cast("string").alias("value")) for i, c in enumerate(cols)]
    counts = (df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
              .groupBy("k", "value").agg(F.count(F.lit(1)).alias("cnt")))
    names = F.array(*[F.lit(c) for c in cols])
    return counts.select(names[F.col("k")].alias("col"), "value", "cnt")
