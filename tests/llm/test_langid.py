import math
import zlib

import duckdb
from cases import by_id, empty_documents, odd_documents
from conftest import SF_MID, SF_SMALL
from keelson.llm import langid, queries
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF_MID}/documents.parquet'").fetchall()
    got = by_id(queries.op9_language_id(spark, SF_MID))
    assert got.keys() == {r[0] for r in rows}
    right = total = 0
    for i, text, lang in rows:
        held = zlib.crc32(str(i).encode()) % 4 == 2
        assert got[i]["held_out"] == held and 0 <= got[i]["score"] <= 1
        if held and lang is not None:
            total, right = total + 1, right + (got[i]["lang_pred"] == lang)
    assert total > 100 and right / total > 0.97


def plain_scores(train: list, text: str, n_max: int) -> dict:
    """Word-first backoff, written out plainly."""
    from collections import Counter
    from math import log10
    words, grams = {}, {}
    for t, lang in train:
        words.setdefault(lang, Counter()).update(langid.words_of(t))
    for lang, c in words.items():
        for w, k in c.items():
            for n in range(1, n_max + 1):
                for g in langid.grams_of(w, n):
                    grams.setdefault((lang, n), Counter())[g] += k
    out = dict.fromkeys(words, 0.0)
    own = langid.words_of(text)

    def score(table, key, lang):
        t = table[lang]
        total = sum(t.values())
        return -log10(t[key] / total) if t[key] else max(-log10(v / total) for v in t.values()) + langid.PENALTY_MARGIN

    for w in own:
        for lang in words:
            if any(c[w] for c in words.values()):
                out[lang] += score(words, w, lang)
                continue
            for n in range(min(n_max, len(w) + 2), 0, -1):
                level = {x: grams.get((x, n), Counter()) for x in words}
                known = [g for g in langid.grams_of(w, n) if any(c[g] for c in level.values())]
                if known:
                    out[lang] += sum(score(level, g, lang) for g in known) / len(known)
                    break
    return {k: v / len(own) for k, v in out.items()}


def test_scores_equal_plain_backoff(spark):
    train = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house", "en"), ("la maison", "fr"), ("skip", None)]
    df = spark.createDataFrame(train, "text string, lang string")
    model = langid.fit(df, n_max=3)
    for text in ["the chat", "cathouse zzz", "maisonette dog", "qqq"]:
        want = plain_scores([t for t in train if t[1]], text, 3)
        mean = [sum(x) / len(langid.words_of(text)) for x in zip(*map(model.word_scores, langid.words_of(text)))]
        assert all(abs(a - want[k]) < 1e-9 for k, a in zip(model.langs, mean)), (text, mean, want)
    tie = langid.score_batch(model, ["qqq"], langid._WordRows(model))
    assert tie == (["en"], [0.5])                                            # nothing known: equal, the smaller name


def test_tables_that_do_not_fit_are_joined(spark):
    """Whatever part of the model the tasks hold (all, a few frequent words, nothing), every document gets the same result."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.filter(~langid.held_out(F.col("doc_id")))
    want = by_id(langid.predict(docs, langid.fit(train)))
    for size in (100_000, 0):
        model = langid.fit(train, model_bytes=size)
        assert not model.complete
        got = by_id(langid.predict(docs, model))
        assert got.keys() == want.keys()
        assert all(got[i]["lang_pred"] == want[i]["lang_pred"] and abs(got[i]["score"] - want[i]["score"]) < 1e-9 for i in want)


def test_the_model_keeps_every_word(spark):
    """More words in one language than the old bound of 50,000: the rarest still score as known words."""
    df = spark.range(60_000).selectExpr("concat('w', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text",
                                        "'aa' AS lang").unionByName(
        spark.createDataFrame([("zu " * 50, "bb")], "text string, lang string"))
    model = langid.fit(df)
    assert model.complete and len(model.word_table[0]) == 60_001
    rare = model.word_scores("wfjjjj")
    assert abs(rare[0] - math.log10(60_000)) < 1e-9 and abs(rare[1] - langid.PENALTY_MARGIN) < 1e-9


def test_hashes_are_those_of_spark(spark):
    texts = ["", "a", "straße", "日本語", " th", "x" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) AS h").collect()
    assert all(langid.hash_of(r["t"]) == r["h"] % (1 << 64) for r in got)


def test_odd_rows(spark):
    df = odd_documents(spark)
    out = langid.predict(df, langid.fit(df))
    assert out.count() == df.count() and out.columns.count("score") == 1
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    for i in (0, 1, 2, 5, 14, 17):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert langid.fit(empty_documents(spark)) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(empty_documents(spark), langid.fit(df)).count() == 0


def test_query_ignores_held_out_labels(spark, tmp_path):
    """Labels and sources of held-out rows, and null labels, change nothing."""
    want = {i: r["lang_pred"] for i, r in by_id(queries.op9_language_id(spark, SF_SMALL)).items()}
    changed = spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr(
        "doc_id", "text", "if(crc32(cast(doc_id AS string)) % 4 = 2, 'xx', lang) AS lang", "'z' AS source", "n_chars")
    changed.write.parquet(f"{tmp_path}/documents.parquet")
    assert {i: r["lang_pred"] for i, r in by_id(queries.op9_language_id(spark, str(tmp_path))).items()} == want


def test_new_words_are_scored_in_blocks(spark, monkeypatch):
    """The n-grams of all new words of a batch at once took a task most of its memory."""
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr")], "text string, lang string"))
    words = ["the", "chien"] + [f"{a}{b}tch" for a in "abcdefghij" for b in "klmnopqrst"]
    want, _ = model.scores_of(words)
    monkeypatch.setattr(langid, "BLOCK_WORDS", 7)
    looked_up, found = [], langid._found
    monkeypatch.setattr(langid, "_found", lambda keys, texts: looked_up.append(len(texts)) or found(keys, texts))
    got, known = model.scores_of(words)
    assert (got == want).all() and known.all() and want[2:].any(axis=1).all()
    assert max(looked_up[1:]) <= 7 * 6                                       # bigrams, padded


def test_word_rows_grow_in_place(spark):
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr")], "text string, lang string"))
    rows, sizes = langid._WordRows(model), set()
    for i in range(100):
        at = rows[f"dog{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}"]
        matrix = rows.matrix()
        assert at == i and len(matrix) == len(rows.known) == i + 1
        sizes.add(matrix.base.shape)
    assert (matrix == model.scores_of(list(rows))[0]).all() and len(sizes) <= 8


def test_the_tables_are_read_a_file_at_a_time(spark, tmp_path):
    import pyarrow as pa
    path = str(tmp_path / "part")
    spark.range(0, 400_000, 1, 8).selectExpr("xxhash64(id) AS h", "id / 2 AS s0", "id / 4 AS s1").write.parquet(path)
    held, before, mine = [], pa.total_allocated_bytes(), langid.give_back
    langid.give_back = lambda: held.append(pa.total_allocated_bytes() - before) or mine()
    try:
        h, rows = langid._arrays(path, 2)
    finally:
        langid.give_back = mine
    want = {r["h"]: (r["s0"], r["s1"]) for r in spark.read.parquet(path).limit(1000).collect()}
    assert len(h) == 400_000 and (h[1:] > h[:-1]).all()
    place = dict(zip(h.tolist(), range(len(h))))
    assert all(tuple(rows[place[k]]) == v for k, v in want.items())
    assert len(held) == 8 and max(held) < 400_000 * 24 / 4                   # of the whole table
