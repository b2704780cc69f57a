import zlib

from cases import by_id, documents, empty_documents, odd_documents
from conftest import SF_SMALL
from keelson.llm import queries, shards
from pyspark.sql import functions as F


def test_query_equals_brute_force(spark):
    texts = documents(SF_SMALL)
    got = by_id(queries.op2_histogram_shards(spark, SF_SMALL))
    assert got.keys() == texts.keys()
    total = sum(len((t or "").encode()) + 16 for t in texts.values())
    below, slots = 0, {}
    for i in sorted(texts):
        size = len((texts[i] or "").encode()) + 16
        shard = min(39, below * 40 // total)
        assert (got[i]["size"], got[i]["shard"], got[i]["slot"]) == (size, shard, slots.get(shard, 0))
        assert got[i]["text_crc32"] == zlib.crc32((texts[i] or "").encode()) and got[i]["law"] == "bytes"
        below, slots[shard] = below + size, slots.get(shard, 0) + 1


def test_query_moves_the_texts(spark):
    """Between the placing map and the rows' order in their buckets the plan carries the text, not its digest."""
    plan = queries.op2_histogram_shards(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("Window"):plan.index("MapInArrow")]
    assert " text#" in moved[moved.index("Project"):] and "crc32" not in moved


def test_many_buckets_and_rounds(spark, monkeypatch):
    """Few probes a round and small buckets give the same shards, bucket by bucket."""
    df = spark.range(3000).select((F.col("id") * 7919 % 3001 - 1500).alias("k"), (F.col("id") % 13 * 10).alias("n"))
    want = {r["k"]: (r["shard"], r["slot"]) for r in shards.histogram_sort(df, "k", F.col("n"), 7).collect()}
    monkeypatch.setattr(shards, "PROBES", 3)
    monkeypatch.setattr(shards, "BUCKET_BYTES", 500)
    got = {r["k"]: (r["shard"], r["slot"]) for r in shards.histogram_sort(df, "k", F.col("n"), 7).collect()}
    assert got == want
    total = sum(i % 13 * 10 for i in range(3000))
    sums = {}
    for r in shards.histogram_sort(df, "k", F.col("n"), 7).collect():
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["n"]
    assert max(abs(x - total / 7) for x in sums.values()) <= 120


def test_hot_key_is_split_by_the_row_hash(spark):
    df = spark.range(4000).select(F.lit(5).alias("k"), F.col("id").alias("other"), F.lit(10).alias("n"))
    out = shards.histogram_sort(df, "k", F.col("n"), 8).groupBy("shard").agg(
        F.count("*").alias("c"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert len(out) == 8 and all(r["c"] == 500 and (r["a"], r["b"]) == (0, 499) for r in out)


def test_odd_rows(spark):
    df = odd_documents(spark)
    out = shards.histogram_sort(df, "doc_id", F.octet_length("text"), 5).collect()
    assert len(out) == df.count()
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert min((r["shard"], r["slot"]) for r in out if r["doc_id"] is None) == (0, 0)     # nulls first
    assert shards.histogram_sort(empty_documents(spark), "doc_id", F.octet_length("text"), 5).count() == 0
