import hashlib

import numpy as np
from cases import by_id, documents, empty_documents, odd_documents
from conftest import SF_SMALL
from keelson.llm import fingerprints, queries
from keelson.llm.multiset import Fingerprints, paragraphs


def test_query_equals_brute_force(spark):
    texts = documents(SF_SMALL)
    got = by_id(queries.op7_multiset_fingerprint(spark, SF_SMALL))
    order = sorted(texts, reverse=True)
    prints = dict(zip(order, Fingerprints.of([texts[i] for i in order]).hex()))
    for i, j in zip(order, order[1:] + order[:1]):
        text, cut = texts[i] or "", len(texts[i] or "") // 3
        edited = text[:len(text) - cut] + (texts[j] or "")[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == prints[i] and r["edited_fingerprint"] == Fingerprints.of([edited]).hex()[0]
        assert r["near_edited"] == Fingerprints.of([text]).likeness(Fingerprints.of([edited]))[0]
        assert r["near_next"] == Fingerprints.of([text]).likeness(Fingerprints.of([texts[j]]))[0]
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 > 0.1 > np.mean([r["near_next"] for r in got.values()])


def test_order_independent_and_incremental():
    lines = [f"paragraph number {i % 9}" for i in range(40)]
    whole, turned = Fingerprints.of(["\n".join(lines)]), Fingerprints.of(["\n".join(reversed(lines))])
    assert whole.hex() == turned.hex()
    first, rest = Fingerprints.of(["\n".join(lines[:11])]), Fingerprints.of(["\n".join(lines[11:])])
    assert (first + rest).hex() == whole.hex() and (whole - first).hex() == rest.hex()
    assert (whole - whole).hex() == Fingerprints.of([None]).hex() == Fingerprints.of([""]).hex()
    assert Fingerprints.from_hex(whole.hex()).hex() == whole.hex()
    assert Fingerprints.of(["a\na"]).hex() != Fingerprints.of(["a"]).hex()


def test_likeness_follows_the_shared_part():
    lines = [f"line {i}" for i in range(300)]
    near = [Fingerprints.of(["\n".join(lines)]).likeness(
        Fingerprints.of(["\n".join(lines[:k] + [f"new {i}" for i in range(300 - k)])]))[0] for k in (300, 270, 200, 100, 0)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[-1] < 0.2 and near[1] > 0.6
    assert paragraphs("One. Two!\n\nx") == ["One. Two!", "x"] and len(paragraphs("A long sentence here. " * 9)) == 9


def test_odd_rows_and_ranges(spark):
    df = odd_documents(spark)
    assert fingerprints.fingerprint_documents(df).count() == df.count()
    out = fingerprints.compare_with_next(df).collect()
    assert len(out) == df.count() and all(0 <= r["near_next"] <= 1 for r in out)
    assert fingerprints.compare_with_next(empty_documents(spark)).count() == 0
    one = fingerprints.compare_with_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
