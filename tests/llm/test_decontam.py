import random
import re

import numpy as np
import pytest
from cases import by_id, documents, empty_documents, odd_documents, prose
from conftest import SF_SMALL
from keelson.llm import decontam, queries
from pyspark.sql import functions as F

import duckdb

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text) -> list:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(texts: dict, items: list) -> dict:
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in texts.items():
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out


def result(df) -> dict:
    return {i: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(r["items"])) for i, r in by_id(df).items()}


def test_suffix_order_and_search():
    rnd = random.Random(4)
    for n, symbols in ((1, 1), (50, 2), (300, 3), (400, 40)):
        text = np.array([rnd.choice([0, *range(1, symbols + 1)]) for _ in range(n)] + ([1, 2] * 20 if symbols > 1 else []))
        index = decontam.FMIndex(text, symbols)
        for length in (1, 2, 3, 5):
            phrases = np.array([[rnd.randrange(1, symbols + 1) for _ in range(length)] for _ in range(60)])
            which, low, high = index.search(phrases)
            got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
            for k, p in enumerate(phrases.tolist()):
                want = [i for i in range(len(text) - length + 1) if text[i:i + length].tolist() == p]
                assert got.get(k, []) == want


def test_query_equals_brute_force(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_SMALL}/benchmark.parquet'").fetchall()
    want = brute_force(documents(SF_SMALL), items)
    got = by_id(queries.op4_benchmark_decontamination(spark, SF_SMALL))
    assert {i: (r["n_words"], r["n_hit"], r["n_items"]) for i, r in got.items()} == {i: (a, b, len(c)) for i, (a, b, c) in want.items()}
    assert any(r["contaminated"] for r in got.values())


@pytest.fixture
def benchmark(spark):
    items = [(1, prose(25, 1)), (2, "one"), (3, None), (4, "!!"), (5, prose(12, 8)), (5, prose(11, 9)), (None, prose(10, 10)),
             (6, "Four Words ARE few")]
    return spark.createDataFrame(items, "item_id long, text string"), items


def test_pieces_blocks_and_short_items(spark, benchmark, monkeypatch):
    table, items = benchmark
    monkeypatch.setattr(decontam.find_hits, "__defaults__", (64,))          # tiny shards: texts in pieces
    texts = {0: "x " + prose(25, 1) + " y one", 1: prose(300, 5) + " " + prose(12, 8).upper() + " " + prose(200, 6),
             2: prose(70, 7) + " " + prose(10, 10), 3: "one two", 4: "no", 5: "four words are few"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {i: (a, b, [x for x in c if x != "None"]) for i, (a, b, c) in brute_force(texts, items).items()}
    assert result(decontam.find_contamination(df, table)) == want
    assert result(decontam.find_contamination(df, table, block_words=8)) == want       # several blocks


def test_removal(spark, benchmark):
    table, _ = benchmark
    passage = prose(25, 1)
    df = spark.createDataFrame([(1, f"Start, {passage}; end here.", 0), (2, passage, 0), (3, "clean text", 10), (4, None, None)],
                               "doc_id long, text string, n_chars long")
    got = by_id(decontam.remove_contamination(df, table, length_col="n_chars"))
    assert got[1]["text"] == "Start, end here." and got[1]["n_chars"] == 16
    assert 2 not in got and got[3]["text"] == "clean text" and got[4]["text"] is None


def test_removal_does_not_depend_on_the_blocks(spark):
    rows, items = [], []
    for k in range(12):
        w = [f"w{k}x{i}" for i in range(1, 21)]
        items += [(100 + k, " ".join(w[:12])), (200 + k, " ".join(w[7:]))]       # overlapping passages: nothing is left
        rows.append((k, " ".join(w), 0))
        v = [f"v{k}x{i}" for i in range(1, 23)]
        items += [(300 + k, " ".join(v[5:17])), (400 + k, " ".join(v[:5] + v[17:]))]     # the cut joins what is no passage here
        rows.append((50 + k, " ".join(v), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("__SPANS", F.lit("own"))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontam.phrase_blocks(table, "item_id", "text", 10, 8))) > 10
    want = {50 + k: " ".join(f"v{k}x{i}" for i in [*range(1, 6), *range(18, 23)]) for k in range(12)}
    for block_words in (2_000_000, 8):
        out = decontam.remove_contamination(df, table, length_col="n_chars", block_words=block_words)
        got = by_id(out)
        assert out.columns == df.columns and {i: r["text"] for i, r in got.items()} == want
        assert all(r["n_chars"] == len(r["text"]) and r["__SPANS"] == "own" for r in got.values())


def test_odd_rows(spark, benchmark):
    df = odd_documents(spark)
    out = decontam.find_contamination(df, benchmark[0])
    assert out.count() == df.count()
    assert decontam.find_contamination(empty_documents(spark), benchmark[0]).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["spans"] for r in decontam.find_contamination(df, nothing).collect())
    assert decontam.remove_contamination(df, benchmark[0], length_col="n_chars").columns == df.columns
