"""Language identification by words first, character n-grams for unseen words.

Training counts every word of every labelled document per language, then
derives the n-gram counts from the word counts.  Scoring adds, word by word,
the negative log10 relative frequency of the word in each language (a fixed
penalty where only other languages know it); a word that no language knows is
scored by its longest n-grams that any language knows, falling back to shorter
ones.  The language with the lowest mean wins; ties go to the smaller name.

The tables of scores (a row per word or n-gram, a column per language) are made by Spark and
cover all training rows.  Their most frequent entries, up to ``model_bytes``, go
to the tasks, through the shared folder, as 64-bit hashes (Spark's ``xxhash64``) and scores: a proven size.
What does not fit is not dropped: words that the tasks do not know are then gathered, scored
once each by joins with the full tables, and joined back to their documents.  The result is the same
(up to the order of summation).  Two words of one hash would share a row: odds of about
V**2 / 2**65 for V words.

Contract for odd input: null texts and texts without a letter are ``und`` with
score 0; rows with a null label are not learned from; with nothing to learn
every row is ``und``.  Rows are independent, so repeats and ties are harmless.
Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import scratch_dir

from .common import give_back, map_batches, stored

_WORD = re.compile(r"[^\W\d_]+")
PENALTY_MARGIN = 1.0       # above the rarest known word of a language, in log10
FLUSH = 500_000            # distinct entries a task holds before it passes partial counts on
MODEL_BYTES = 128 << 20    # hashes and scores that a task holds, at most
BLOCK_WORDS = 1 << 14      # unknown words whose n-grams are scored together


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _partial_counts(batches: Iterator[pa.RecordBatch], entries) -> Iterator[pa.RecordBatch]:
    """Counts of what ``entries(batch)`` yields as (lang, key, n), passed on in bounded pieces."""
    counts: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, k, n) for lang, c in counts.items() for k, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64())], names=["lang", "key", "n"])

    for b in batches:
        entries(b, counts)
        if sum(map(len, counts.values())) > FLUSH:
            yield flush()
    if counts:
        yield flush()


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def word_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, key = word, n) over all rows with a label."""

    def count(batches):
        def entries(b, counts):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
        return _partial_counts(batches, entries)

    narrow = df.select(df[text_col].alias("text"), df[lang_col].cast("string").alias("lang")) \
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return _summed(map_batches(narrow, count, "lang string, key string, n bigint"))


def gram_counts(words: DataFrame, n_max: int) -> DataFrame:
    """(lang, key = n-gram, n) of a word count table; a word counts as often as it occurs (n-grams as in ``grams_of``)."""
    def pieces(n: int):
        text = F.col("key") if n == 1 else F.concat(F.lit(" "), "key", F.lit(" "))
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substring(text, i, F.lit(n)))) \
            .otherwise(F.array().cast("array<string>"))

    grams = F.explode(F.concat(*[pieces(n) for n in range(1, n_max + 1)])).alias("key")
    return _summed(words.select("lang", "n", grams))


def score_table(counts: DataFrame, totals: dict, least: dict, langs: list[str], by_size: bool) -> DataFrame:
    """(key, n, s0, s1, ...): of every entry its count over all languages and its score in each.

    ``totals`` and ``least``: sum and smallest count per (language, size); the size is 0 for words.
    """
    rows = counts.groupBy("key").agg(F.sum("n").alias("n"), *[
        F.max(F.when(F.col("lang") == F.lit(lang), F.col("n"))).alias(f"n{i}") for i, lang in enumerate(langs)])
    sizes = sorted({size for _, size in totals})
    scores = []
    for i, lang in enumerate(langs):
        total, absent = F.lit(None).cast("double"), F.lit(None).cast("double")
        for size in sizes:
            t = totals.get((lang, size))
            worst = -math.log10(least[lang, size] / t) if t else 0.0
            here = F.length("key") == size if by_size else F.lit(True)
            total, absent = F.when(here, F.lit(float(t or 1))).otherwise(total), \
                F.when(here, F.lit(worst + PENALTY_MARGIN)).otherwise(absent)
        scores.append(F.coalesce(-F.log10(F.col(f"n{i}") / total), absent).alias(f"s{i}"))
    return rows.select("key", "n", *scores)


def _frequent(table: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The entries at or above the smallest count that leaves at most ``most``, and whether these are all."""
    steps = table.groupBy("n").agg(F.count("*").alias("entries")).orderBy(F.desc("n"))
    total, least = 0, None
    for r in steps.toLocalIterator():                     # one row per distinct count, from the largest
        total += r["entries"]
        if total > most:
            break
        least = r["n"]
    if total <= most:
        return table, True
    return table.filter(F.lit(False) if least is None else F.col("n") >= F.lit(least)), False


def _written(table: DataFrame, langs: int, name: str) -> str:
    """Hashes and scores as a Parquet table under the shared folder; tasks read it, the driver need not."""
    path = scratch_dir(table.sparkSession, name)
    table.select(F.xxhash64("key").alias("h"), *[f"s{i}" for i in range(langs)]).write.parquet(path)
    return path


def _arrays(path: str | None, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their rows of scores."""
    if path is None:
        return np.empty(0, dtype=np.int64), np.empty((0, langs))
    fs, folder = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    data = ds.dataset(folder, filesystem=fs, format="parquet")
    h, end = np.empty(data.count_rows(), dtype=np.int64), 0
    rows = np.empty((len(h), langs))
    for part in data.get_fragments():                     # a file at a time
        t = part.to_table(use_threads=False)
        start, end = end, end + len(t)
        h[start:end] = t.column("h").to_numpy()
        for i in range(langs):
            rows[start:end, i] = t.column(f"s{i}").to_numpy()
        del t
        give_back()
    order = np.argsort(h)
    for i in range(langs):
        rows[:, i] = rows[order, i]
    return h[order], rows


def hash_of(text: str) -> int:
    """Spark's ``xxhash64`` of a string, as an unsigned number."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)


def _found(keys: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``keys``, which texts are there)."""
    h = np.fromiter(map(hash_of, texts), dtype=np.uint64, count=len(texts)).view(np.int64)
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    return at, (keys[at] == h if len(keys) else np.zeros(len(h), dtype=bool))


class LanguageModel:
    """Where the score tables of frequent words and n-grams are (``parts``), read as arrays on first use;
    ``words`` and ``grams`` are the full tables.

    ``complete``: the arrays hold everything, so tasks need no joins.
    """

    def __init__(self, langs: list[str], n_max: int, parts: tuple, complete: bool,
                 words: DataFrame | None = None, grams: DataFrame | None = None):
        self.langs, self.n_max, self.parts, self.complete = langs, n_max, parts, complete
        self.words, self.grams = words, grams
        self._tables: dict[int, tuple] = {}

    def _table(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in self._tables:
            self._tables[which] = _arrays(self.parts[which], len(self.langs))
            give_back()
        return self._tables[which]

    @property
    def word_table(self) -> tuple[np.ndarray, np.ndarray]:
        return self._table(0)

    @property
    def gram_table(self) -> tuple[np.ndarray, np.ndarray]:
        return self._table(1)

    def for_tasks(self) -> Callable[[], LanguageModel]:
        """Each task reads the arrays (bounded by ``model_bytes``) from the shared folder."""
        langs, n_max, parts, complete = self.langs, self.n_max, self.parts, self.complete
        return lambda: LanguageModel(langs, n_max, parts, complete)

    def scores_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of scores, and which words have one: known words, others by their longest known n-grams (all zero
        without any).  Unless the model is complete, unknown words are left open."""
        keys, rows = self.word_table
        at, there = _found(keys, words)
        out = np.zeros((len(words), len(self.langs)))
        out[there] = rows[at[there]]
        if not self.complete:
            return out, there
        unknown = np.flatnonzero(~there)
        for start in range(0, len(unknown), BLOCK_WORDS):
            self._score_by_grams(words, unknown[start:start + BLOCK_WORDS], out)
        return out, np.ones(len(words), dtype=bool)

    def _score_by_grams(self, words: list[str], open_: np.ndarray, out: np.ndarray) -> None:
        """Fill the rows ``open_`` of ``out`` by the longest known n-grams of their words."""
        keys, rows = self.gram_table
        for n in range(self.n_max, 0, -1):
            if not len(open_):
                break
            pieces = [grams_of(words[i], n) for i in open_]
            owner = np.repeat(np.arange(len(open_)), [len(p) for p in pieces])
            at, known = _found(keys, [g for p in pieces for g in p])
            count = np.bincount(owner[known], minlength=len(open_))
            sums = np.zeros((len(open_), len(self.langs)))
            np.add.at(sums, owner[known], rows[at[known]])
            some = count > 0
            out[open_[some]] = sums[some] / count[some, None]
            open_ = open_[~some]

    def word_scores(self, word: str) -> tuple:
        return tuple(self.scores_of([word])[0][0])


class _WordRows(dict):
    """word -> row of a growing score matrix; new words of a batch are scored together.

    The matrix grows by doubling: one as long as the words of each batch in turn would leave holes behind.
    """

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.new = model, []
        self._rows, self._known = np.empty((0, len(model.langs))), np.empty(0, dtype=bool)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    @property
    def known(self) -> np.ndarray:
        return self._known[:len(self) - len(self.new)]

    def matrix(self) -> np.ndarray:
        if self.new:
            end, start = len(self), len(self) - len(self.new)
            if end > len(self._rows):
                rows, known = self._rows[:start], self._known[:start]
                self._rows = np.empty((max(end, 2 * start), rows.shape[1]))
                self._known = np.empty(len(self._rows), dtype=bool)
                self._rows[:start], self._known[:start] = rows, known
            self._rows[start:end], self._known[start:end] = self.model.scores_of(self.new)
            self.new = []
        return self._rows[:len(self)]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", n_max: int = 4,
        model_bytes: int = MODEL_BYTES) -> LanguageModel | None:
    """Counts over all rows of ``df``; None if there is nothing to learn."""
    words = stored(word_counts(df, text_col, lang_col), "langid-words")
    grams = stored(gram_counts(words, n_max), "langid-grams")
    facts = [F.sum("n").alias("t"), F.min("n").alias("l")]
    per_word = words.groupBy("lang", F.lit(0).alias("size")).agg(*facts).collect()
    per_gram = grams.groupBy("lang", F.length("key").alias("size")).agg(*facts).collect()
    if not per_word:
        return None
    langs = sorted(r["lang"] for r in per_word)
    tables = [stored(score_table(counts, {(r["lang"], r["size"]): r["t"] for r in per},
                                 {(r["lang"], r["size"]): r["l"] for r in per}, langs, by_size), f"langid-{name}-scores")
              for name, counts, per, by_size in (("word", words, per_word, False), ("gram", grams, per_gram, True))]
    most = model_bytes // (8 * (len(langs) + 1))                       # entries of a hash and its scores
    gram_part, all_grams = _frequent(tables[1], most // 2)
    word_part, all_words = _frequent(tables[0], most - (tables[1].count() if all_grams else 0))
    complete = all_words and all_grams
    parts = (_written(word_part, len(langs), "langid-word-part"),
             _written(gram_part, len(langs), "langid-gram-part") if complete else None)
    return LanguageModel(langs, n_max, parts, complete, *tables)


def judged(model: LanguageModel, sums: np.ndarray, count: np.ndarray) -> tuple[list, list]:
    """(languages, scores) of summed scores: score is the winner's share when means are read as log10 likelihoods."""
    mean = sums / np.maximum(count, 1)[:, None]
    best = mean.argmin(axis=1)
    share_ = 1.0 / np.power(10.0, mean[np.arange(len(mean)), best][:, None] - mean).sum(axis=1)
    some = count > 0
    return [model.langs[i] if s else "und" for i, s in zip(best.tolist(), some.tolist(), strict=True)], \
        np.where(some, share_, 0.0).tolist()


def _summed_rows(rows: _WordRows, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """(row numbers of the words of every text, sums of their scores, how many words)."""
    at = [list(map(rows.__getitem__, words_of(t))) for t in texts]
    matrix = rows.matrix()
    count = np.fromiter(map(len, at), dtype=np.int64, count=len(at))
    sums = np.zeros((len(at), matrix.shape[1]))
    some = np.flatnonzero(count)
    if len(some):
        ids = np.fromiter((k for text in at for k in text), dtype=np.int64, count=int(count.sum()))
        sums[some] = np.add.reduceat(matrix[ids], np.r_[0, np.cumsum(count[some])[:-1]], axis=0)
    return at, sums, count


def score_batch(model: LanguageModel | None, texts: list, rows: _WordRows | None) -> tuple[list, list]:
    """(languages, scores) of texts by a complete model."""
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    _, sums, count = _summed_rows(rows, texts)
    return judged(model, sums, count)


def predict(df: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``df`` with columns ``lang_pred`` and ``score`` appended (earlier columns of those names go)."""
    df = df.drop("lang_pred", "score")
    if model is not None and not model.complete:
        return _predict_by_joins(df, model, text_col)
    shared = model.for_tasks() if model else lambda: None
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        rows = _WordRows(model) if model else None
        for b in batches:
            langs, scores = score_batch(model, b.column(at).to_pylist(), rows)
            if rows is not None and len(rows) > FLUSH:
                rows = _WordRows(model)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*b.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_batches(df, run, f"{fields}, lang_pred string, score double")


def _predict_by_joins(df: DataFrame, model: LanguageModel, text_col: str) -> DataFrame:
    """The same where the full tables do not fit: words that tasks do not know are scored by joins."""
    langs = len(model.langs)
    shared = model.for_tasks()
    rows = stored(df.withColumn("__row", F.monotonically_increasing_id()), "langid-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordRows(shared())
        for b in batches:
            at, sums, count = _summed_rows(known, b.column(1).to_pylist())
            words, there = list(known), known.known
            unknown = [Counter(words[k] for k in ids if not there[k]) for ids in at]
            if len(known) > FLUSH:
                known = _WordRows(known.model)
            ends = np.r_[0, np.cumsum([len(u) for u in unknown])].astype(np.int32)
            entries = pa.StructArray.from_arrays(
                [pa.array([w for u in unknown for w in u], pa.string()),
                 pa.array([c for u in unknown for c in u.values()], pa.int64())], names=["word", "c"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count), pa.array(sums.tolist(), pa.list_(pa.float64())),
                 pa.ListArray.from_arrays(pa.array(ends), entries)], names=["__row", "count", "sums", "unknown"])

    part = stored(map_batches(rows.select("__row", F.col(text_col)), run, "__row bigint, count bigint, "
                              "sums array<double>, unknown array<struct<word:string,c:bigint>>"), "langid-part")
    uses = part.select("__row", F.explode("unknown").alias("u")).select("__row", "u.word", "u.c")
    scored = stored(_scores_by_joins(uses.select("word").distinct(), model), "langid-unknown")
    more = uses.join(scored, "word").groupBy("__row").agg(*[F.sum(F.col(f"s{i}") * F.col("c")).alias(f"s{i}")
                                                            for i in range(langs)])
    total = F.array(*[F.col("sums")[i] + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(langs)])
    means = part.join(more, "__row", "left").select("__row", "count", total.alias("sums"))
    names = model.langs

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(names, 0, (None, None), False)
        for b in batches:
            if b.num_rows:
                found, scores = judged(own, b.column(2).flatten().to_numpy().reshape(-1, langs), b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["__row", "lang_pred", "score"])

    return rows.join(map_batches(means, finish, "__row bigint, lang_pred string, score double"), "__row").drop("__row")


def _scores_by_joins(words: DataFrame, model: LanguageModel) -> DataFrame:
    """(word, s0, s1, ...) of distinct words from the full tables: known words, else the longest known n-grams."""
    names = [f"s{i}" for i in range(len(model.langs))]
    n_max = model.n_max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, g) for w in b.column(0).to_pylist() for n in range(1, n_max + 1) for g in grams_of(w, n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([r[2] for r in rows], pa.string())], names=["word", "size", "key"])

    table = model.words.withColumnRenamed("key", "word").select("word", *names)
    known = words.join(table, "word")
    pieces = map_batches(words.join(table, "word", "left_anti"), run, "word string, size int, key string")
    means = pieces.join(model.grams.select("key", *names), "key").groupBy("word", "size").agg(
        *[F.avg(s).alias(s) for s in names])
    longest = means.groupBy("word").agg(F.max_by(F.struct(*names), "size").alias("m")).select("word", "m.*")
    return known.unionByName(longest)


def held_out(id_col):
    """True for rows that training must not see; a null id is neither learned from nor held out."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2
