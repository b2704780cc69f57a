import hashlib
import random

import pytest
from cases import by_id, documents, empty_documents, odd_documents, odd_texts
from conftest import SF_SMALL
from keelson.llm import bpe, queries
from tokenizers import Tokenizer as Reference

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Reference.from_file(PATH)


def test_query_equals_the_library(spark, library):
    texts = documents(SF_SMALL)
    got = by_id(queries.op5_bpe(spark, SF_SMALL))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts_equal_the_library(library):
    rnd = random.Random(2)
    texts = [t for t in odd_texts() if t] + [
        "<|endoftext|>a<|endoftext|><|endoftext", "don't I'LL we've '''s", "a\r\n\t  b   \n\n c  ", " \x1c\x1d\x1e\x1f\x85\xa0᠎​ 　 x",
        "é ٣٤ ½ Ⅷ ²", " " * 3000, "aaaa" * 40, *("".join(chr(rnd.choice(
            [rnd.randrange(1, 128), rnd.randrange(128, 0x500), rnd.randrange(0x2000, 0x3100), rnd.randrange(0x10000, 0x1FFFF)]))
            for _ in range(120)) for _ in range(60))]
    tok = bpe.Tokenizer.from_file(PATH)
    for text, ids in zip(texts, bpe.Encoder(tok).encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]
        assert b"".join(map(tok.token_bytes.__getitem__, ids.tolist())).decode() == text


def test_cache_limit_changes_nothing(monkeypatch):
    tok = bpe.Tokenizer.from_file(PATH)
    texts = [f"word{i} other{i % 7} again\n" * 3 for i in range(50)]
    want = [x.tolist() for x in bpe.Encoder(tok).encode(texts)]
    monkeypatch.setattr(bpe, "CACHED_PIECES", 10)
    small = bpe.Encoder(tok)
    assert [x.tolist() for t in texts for x in small.encode([t])] == want


def test_odd_rows(spark):
    df = odd_documents(spark)
    coded = bpe.encode(df, PATH, keep=("lang",))
    assert coded.count() == df.count() and coded.columns == ["doc_id", "lang", "ids"]
    assert [r["ids"] for r in coded.filter("doc_id < 2").collect()] == [[], []]
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(coded, PATH).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(odd_texts()))
    assert bpe.encode(empty_documents(spark), PATH).count() == 0


def test_blocks_change_nothing(monkeypatch, library):
    """A task has the pieces and pair positions of a block at hand, not those of a whole batch."""
    tok = bpe.Tokenizer.from_file(PATH)
    texts = [None, "", *(f"word{i} other{i % 7} again, and\n\n again\n" * 3 for i in range(60)), "x" * 500, " a b" * 200]
    monkeypatch.setattr(bpe, "BLOCK_LETTERS", 300)
    monkeypatch.setattr(bpe, "INDEX_LETTERS", 64)
    sizes, rows, index, block = [], [], bpe.PairIndex, bpe.Encoder._encode_block
    monkeypatch.setattr(bpe, "PairIndex", lambda words, tok: sizes.append((len(words), sum(map(len, words)))) or index(words, tok))
    monkeypatch.setattr(bpe.Encoder, "_encode_block", lambda self, some: rows.append(len(some)) or block(self, some))
    got = bpe.Encoder(tok).encode(texts)
    assert [x.tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert all(letters <= 64 or words == 1 for words, letters in sizes) and len(sizes) > 10
    assert sum(rows) == len(texts) and max(rows) <= 10
    assert bpe.Encoder(tok).encode([]) == []
