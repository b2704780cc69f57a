import corpus_pipeline as P
import duckdb
from cases import empty_documents, odd_documents, prose
from conftest import SF_SMALL
from keelson.llm import bpe, decontam, langid, queries, secrets
from test_decontam import brute_force as contaminated
from test_ngram_join import brute_force as near_copies
from tokenizers import Tokenizer


def test_whole_run_equals_brute_force(spark):
    """Every stage, on what the stage before it kept, written out plainly."""
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF_SMALL}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_SMALL}/benchmark.parquet'").fetchall()
    model = langid.fit(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    langs, scores = langid.score_batch(model, [d[1] for d in docs], langid._WordRows(model))
    docs = [d for d, lang, s in zip(docs, langs, scores) if lang != "und" and s >= P.LEAST_SCORE]
    groups = near_copies({d[0]: d[1] for d in docs})
    docs = [d for d in docs if groups[d[0]][0] == d[0]]
    hits = contaminated({d[0]: d[1] for d in docs}, items)
    phrases = decontam.Phrases(items)
    cut = {}
    for d in docs:
        text = d[1]
        if hits[d[0]][1]:
            text = decontam.remove_spans(text, decontam.find_hits([text], phrases)[0][1])
            if not decontam.byte_words(text):
                continue
        cut[d[0]] = secrets.redact(text)
    library = Tokenizer.from_file(queries.tokenizer_path())
    got = {r["doc_id"]: r for r in P.run(spark, SF_SMALL).collect()}
    assert got.keys() == cut.keys()
    for i, text in cut.items():
        assert got[i]["ids"] == library.encode(text, add_special_tokens=False).ids and got[i]["n_tokens"] == len(got[i]["ids"])


def test_no_passage_is_left_and_clean_documents_stay(spark, tmp_path):
    passage = prose(30, 77)
    rows = [(1, f"Start here. {passage} And more text that stays in place.", "en", "s", 0), (2, "A clean text about rivers and hills.", "en", "s", 36),
            (3, "Une phrase propre sur les rivières.", "fr", "s", 35), (4, "token=abcdefgh1234 in a clean text about something", "en", "s", 5),
            (5, prose(80, 5), "en", "s", 1), (6, prose(80, 5) + " end", "en", "s", 1), (7, "!!! ???", "en", "s", 7), (8, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    tok = bpe.Tokenizer.from_file(queries.tokenizer_path())
    text = {i: b"".join(map(tok.token_bytes.__getitem__, r["ids"])).decode() for i, r in out.items()}
    assert text[1] == "Start here. And more text that stays in place." and text[2] == rows[1][1]
    assert text[4] == "[SECRET] in a clean text about something"


def test_near_copies_keeps_one_row_of_each_group(spark):
    a, b, c, d = (prose(60, i) for i in range(21, 25))
    rows = [(5, a), (3, a), (5, b), (7, c), (7, c), (None, a), (None, d), (None, d + " end"), (9, None), (9, None), (2, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in P.near_copies(spark, docs, SF_SMALL).collect()]
    d_kept = [x for x in got if x in ((None, d), (None, d + " end"))]
    assert len(d_kept) == 1
    want = [(3, a), (5, b), (7, c), (9, None), (9, None), (2, ""), (2, "")]
    assert sorted(map(repr, got)) == sorted(map(repr, want + d_kept))


def test_stages_keep_the_columns(spark):
    docs = odd_documents(spark)
    for table in (docs, empty_documents(spark)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, table, SF_SMALL)
            assert out.columns == table.columns, name
            assert out.count() <= table.count()
    assert 4 <= len(P.STAGES) <= 5 and P.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
