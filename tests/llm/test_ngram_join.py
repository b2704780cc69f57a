import re
from collections import defaultdict
from itertools import combinations

import numpy as np
from cases import by_id, documents, empty_documents, odd_documents, prose
from conftest import SF_SMALL
from keelson.llm import minhash, ngram_join, queries


def shingles(text) -> frozenset:
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset([text]) if text else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(texts: dict) -> dict:
    """id -> (class_id, n_links) by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = defaultdict(int)
    for own in holders.values():
        for a, b in combinations(sorted(own), 2):
            both[a, b] += 1
    links, group = defaultdict(int), {i: i for i in texts}
    for (a, b), n in sorted(both.items()):
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {k: new if v == old else v for k, v in group.items()}
    return {i: (group[i], links[i]) for i in texts}


def result(df) -> dict:
    return {i: (r["class_id"], r["n_links"]) for i, r in by_id(df).items()}


def test_query_equals_brute_force(spark):
    assert result(queries.op3_ngram_jaccard(spark, SF_SMALL)) == brute_force(documents(SF_SMALL))


def test_large_group_in_blocks(spark, monkeypatch):
    """A group of near copies larger than a block, beside copies and others."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    base = prose(120, 3).split()
    texts = {i: " ".join(base[:i] + [f"new{i}"] + base[i:]) for i in range(70)}
    texts |= {100 + i: prose(30 + i, 50 + i) for i in range(20)}
    texts |= {200 + i: texts[5] for i in range(10)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_force(texts)
    assert want[0][1] == 79 and result(ngram_join.jaccard_groups(df)) == want


def test_posterior_table():
    """The table equals a numeric integral of the posterior, and is monotone."""
    least = minhash.least_matches(0.8, 1e-6)
    s = np.linspace(0, 1, 200_001)
    for k, m in enumerate(least):
        n = (k + 1) * minhash.STEP
        tail = [(lambda p: p[s >= 0.8].sum() / p.sum())(s ** x * (1 - s) ** (n - x)) for x in (m - 1, m)]
        assert tail[0] < 1e-6 <= tail[1] * 1.001
    assert least == sorted(least)


def test_overlaps_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in (1, 5, 80, 200, 250)]
    i, j = np.array([0, 1, 2, 3]), np.array([4, 3, 4, 4])
    assert minhash.exact_overlaps(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 200), (200, 150), (300, 300)] + [(1000 + i, 1000) for i in range(50)]
    got = {r["v"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[200] == got[150] == 100 and got[1049] == 1000


def test_odd_rows(spark):
    df = odd_documents(spark)
    out = ngram_join.jaccard_groups(df).collect()
    assert len(out) == df.count()
    got = {r["doc_id"]: r for r in out}
    assert got[None]["class_id"] is None and got[None]["n_links"] == 0
    assert got[0]["class_id"] == 0 and got[1]["class_id"] == 1 and got[0]["n_links"] == got[1]["n_links"] == 0
    assert got[5]["class_id"] == got[6]["class_id"] == 5 and got[6]["copy_id"] == 5       # no words, equal texts
    assert got[7]["class_id"] == got[8]["class_id"] == got[9]["class_id"] == 7 and got[9]["n_links"] == 4
    assert ngram_join.jaccard_groups(empty_documents(spark)).count() == 0
