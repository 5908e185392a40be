"""Language identification: known words first, then ever shorter character n-grams.

A word that the training texts hold at least ``least`` times scores its log frequency in
each language. Another word scores the mean log frequencies of its n-grams of the greatest
length of which any is known, from ``longest`` down to single characters. A document's
language is the one of the largest sum over all its words, and its score that language's
share of the likelihoods. Words are runs of letters and of the marks on them, by Unicode
category, in lower case; a run of marks alone is none.

Every language that occurs is learned, from a bounded sample of its documents, in the order
of a hash of the id: at most ``per_lang`` of each, and at most ``sample`` of all, shared
evenly. Words and n-grams are counted in Spark; the driver gets hashes and counts of the
``entries`` most frequent ones. The model is sorted hashes with one row of gains over a
floor for each, so its size follows from ``entries`` and not from the number of languages.
Prediction is one pass without a shuffle; words are looked up once for each worker process,
all new ones of a run of rows together.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every
text if there is nothing to learn from; ties go to the language first by name; repeated
rows are predicted alike, and of several texts under one id the smallest is learned from;
rows with a null id are predicted but never learned from; a text of any length counts
whole; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, mix64, release, runs

GAP = r"[^\pL\pM]+"  # what lies between words
UNKNOWN = "und"
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, the words of each text as numbers of these, and how many each has."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), GAP)
    counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    lettered = pc.match_substring_regex(coded.dictionary, r"\pL").to_numpy(zero_copy_only=False)
    number = np.cumsum(lettered) - 1
    flat = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ok = lettered[flat] if len(flat) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)[ok]
    return coded.dictionary.filter(pa.array(lettered)), number[flat[ok]], np.bincount(owner, minlength=len(counts))


def word_keys(words: list[str]) -> np.ndarray:
    import xxhash

    return mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


class Letters:
    """The characters of many words, a blank before and after each, and hashes of their n-grams."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length + 2) - self.length - 2
        self.chars = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)

    def grams(self, size: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all n-grams of some words, and which of those words each is of."""
        n = self.length[which] if size == 1 else np.maximum(self.length[which] + 3 - size, 0)
        first = self.start[which] + (size == 1)
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        h = np.full(len(at), size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = h * _STEP + self.chars[at + k]
            return mix64(h), np.repeat(np.arange(len(which)), n)


class Model:
    """Sorted keys, each with gains over the floor of its table for the languages that have it.

    Table 0 holds words, table n the n-grams. An entry of count c scores
    log((c + 1/2) / total), a missing one log((1/2) / total), which is the floor.
    """

    def __init__(self, langs: list[str], table: np.ndarray, key: np.ndarray, lang: np.ndarray, count: np.ndarray, longest: int = 5):
        order = np.lexsort((lang, key, table))
        table, key, lang, count = table[order], key[order], lang[order], count[order]
        self.langs, self.longest, self.name = langs, longest, uuid.uuid4().hex
        self.lang, self.gain = lang.astype(np.int32), np.log(2.0 * count + 1.0).astype(np.float32)
        self.floor = np.zeros((longest + 1, len(langs)))
        self.keys, self.rows = [], []  # of each table: its keys, and where the gains of each begin and end
        for t in range(longest + 1):
            lo, hi = np.searchsorted(table, [t, t + 1])
            new = np.flatnonzero(np.append(True, key[lo + 1 : hi] != key[lo : hi - 1])) if hi > lo else np.zeros(0, np.int64)
            self.keys.append(key[lo:hi][new])
            self.rows.append(np.append(lo + new, hi))
            total = np.bincount(lang[lo:hi], weights=count[lo:hi], minlength=len(langs)) + 0.5 * len(new) + 1
            self.floor[t] = np.log(0.5 / total)

    def find(self, table: int, keys: np.ndarray) -> np.ndarray:
        """The row of each key in a table, -1 where it has none."""
        known = self.keys[table]
        if not len(known) or not len(keys):
            return np.full(len(keys), -1)
        each, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(known, each), len(known) - 1)
        return np.where(known[at] == each, at, -1)[back]

    def entries(self, table: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All entries of some rows, one row after another, and how many each row has."""
        begin, end = self.rows[table][rows], self.rows[table][rows + 1]
        n = end - begin
        return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


class Scorer:
    """What words add to each language, remembered up to ``limit`` words and ``pool`` gains."""

    def __init__(self, model: Model, limit: int = 300_000, pool: int = 4_000_000):
        self.model, self.limit, self.most = model, limit, pool
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table, self.first, self.number = np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.lang, self.gain = np.zeros(0, np.int32), np.zeros(0, np.float32)

    def _add(self, words: list[str]) -> None:
        m, n = self.model, len(self.model.langs)
        table = np.ones(len(words), np.int8)  # a word without any known n-gram scores the floor of single characters
        owner, lang, gain = [], [], []

        def take(which: np.ndarray, t: int, rows: np.ndarray, of: np.ndarray, share: np.ndarray) -> None:
            table[which] = t
            at, k = m.entries(t, rows)
            cell = np.repeat(which[of], k) * n + m.lang[at]
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], (m.gain[at] * np.repeat(share[of], k))[order]
            new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
            owner.append(cell[new] // n)
            lang.append((cell[new] % n).astype(np.int32))
            gain.append(np.add.reduceat(value, new) if len(new) else value)

        row = m.find(0, word_keys(words))
        known = np.flatnonzero(row >= 0)
        take(known, 0, row[known], np.arange(len(known)), np.ones(len(known)))
        left, letters = np.flatnonzero(row < 0), Letters(words)
        for size in range(m.longest, 0, -1):
            keys, of = letters.grams(size, left)
            row = m.find(size, keys)
            of, row = of[row >= 0], row[row >= 0]
            found = np.bincount(of, minlength=len(left))
            share = 1.0 / np.maximum(found, 1)
            here = np.flatnonzero(found)
            place = np.cumsum(found > 0) - 1
            take(left[here], size, row, place[of], share[here])
            left = left[found == 0]
        owner, lang, gain = np.concatenate(owner), np.concatenate(lang), np.concatenate(gain)
        order = np.argsort(owner, kind="stable")
        number = np.bincount(owner, minlength=len(words))
        self.first = np.append(self.first, len(self.lang) + np.cumsum(number) - number)
        self.number, self.table = np.append(self.number, number.astype(np.int32)), np.append(self.table, table)
        self.lang, self.gain = np.append(self.lang, lang[order]), np.append(self.gain, gain[order].astype(np.float32))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))

    def predict(self, texts: pa.Array, cells: int = 4_000_000) -> tuple[list[str], np.ndarray]:
        names, score, n = [UNKNOWN] * len(texts), np.zeros(len(texts)), len(self.model.langs)
        distinct, flat, counts = words_of(texts)
        if not n or not len(flat):
            return names, score
        distinct = distinct.to_pylist()
        new = [w for w in distinct if w not in self.index]
        if len(self.index) + len(new) > self.limit or len(self.lang) > self.most:
            self._clear()
            new = distinct
        self._add(new)
        word = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        has = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[has]
        k = self.number[word].astype(np.int64)
        at = np.repeat(self.first[word] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        of, lang, gain = np.repeat(np.arange(len(word)), k), self.lang[at], self.gain[at]
        best, top, rest = np.zeros(len(has), np.int64), np.full(len(has), -np.inf), np.zeros(len(has))
        block = max(1, cells // max(len(flat), len(word)))  # languages at a time
        for lo in range(0, n, block):
            each = self.model.floor[self.table[word], lo : lo + block]
            here = slice(None) if block >= n else np.flatnonzero((lang >= lo) & (lang < lo + block))
            each[of[here], lang[here] - lo] += gain[here]
            sums = np.add.reduceat(each[flat], starts, axis=0)
            most = sums.max(axis=1)
            best = np.where(most > top, lo + sums.argmax(axis=1), best)
            rest = rest * np.exp(np.minimum(top - most, 0)) + np.exp(sums - np.maximum(top, most)[:, None]).sum(axis=1)
            top = np.maximum(top, most)
        score[has] = 1 / rest
        for d, b in zip(has.tolist(), best.tolist(), strict=True):
            names[d] = self.model.langs[b]
        return names, score


_scorers: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """One scorer for each worker process, so that later tasks find its words."""
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, to in runs(b.column(1), 1_000_000):
            distinct, flat, counts = words_of(b.column(1).slice(at, to - at))
            lang = pa.array(np.repeat(np.arange(to - at), counts))
            rows = pa.table({"lang": b.column(0).slice(at, to - at).take(lang), "word": distinct.take(pa.array(flat))}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from rows.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()
    give_back()


def _keyed(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in runs(b.column(1), 200_000):
                words, n = b.column(1).slice(at, to - at).to_pylist(), b.column(2).slice(at, to - at).to_numpy()
                letters, every = Letters(words), np.arange(len(words))
                parts = [(0, word_keys(words), every), *((size, *letters.grams(size, every)) for size in range(1, longest + 1))]
                of = np.concatenate([p[2] for p in parts])
                table = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(np.int32)
                rows = pa.table({"lang": b.column(0).slice(at, to - at).take(pa.array(of)), "tab": table, "key": np.concatenate([p[1] for p in parts]).view(np.int64), "n": n[of]}).group_by(["lang", "tab", "key"]).aggregate([("n", "sum")])
                yield from rows.select(["lang", "tab", "key", "n_sum"]).rename_columns(["lang", "tab", "key", "n"]).combine_chunks().to_batches()
        give_back()

    return run


def sample_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, sample: int) -> tuple[list[str], DataFrame]:
    """The languages by name, and (lang, text) of the documents to learn from."""
    usable = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and doc_id is not null and text is not null")
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    langs = [r["lang"] for r in sizes.select("lang").orderBy("lang").limit(sample + 1).collect()]
    if len(langs) > sample:
        raise ValueError(f"more than {sample} languages")
    each = min(per_lang, sample // max(1, len(langs)))
    # of a language with many documents, only the few whose hash is small are ranked at all
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    small = usable.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(place * F.col("n") < F.lit(4.0 * each) * (1 << 30)).select("lang", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    chosen = small.withColumn("k", rank).where(F.col("k") <= each).select("lang", "doc_id")
    # at most `sample` ids are broadcast; of the rows of one id one text is taken
    return langs, usable.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_lang: int = 1000, sample: int = 1_000_000, entries: int = 2_000_000, least: int = 2, longest: int = 5) -> Model:
    """Learn every language that occurs; at most ``sample`` may.

    per_lang, sample: most documents of a language, and of all. entries: most words and
    n-grams that the model keeps, the most frequent first. least: how often one must occur.
    """
    langs, texts = sample_of(docs, id_col, text_col, lang_col, per_lang, sample)
    words = texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    keys = words.mapInArrow(_keyed(longest), "lang string, tab int, key long, n long").groupBy("tab", "key", "lang").agg(F.sum("n").alias("n"))
    kept = keys.groupBy("tab", "key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("each")).where(F.col("total") >= least)
    kept = materialize(kept, "entries")
    most = kept.orderBy(F.desc("total"), "tab", "key").limit(entries) if kept.count() > entries else kept
    got = most.select("tab", "key", F.explode("each").alias("e")).select("tab", "key", "e.lang", "e.n").toArrow()
    release(kept)
    lang = pc.index_in(got["lang"].combine_chunks(), value_set=pa.array(langs, pa.string()))
    column = lambda c, t: got[c].to_numpy().astype(t)
    return Model(langs, column("tab", np.int64), column("key", np.int64).view(np.uint64), lang.to_numpy(zero_copy_only=False).astype(np.int64), column("n", np.float64), longest)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by ``entries``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for b in batches:
            for at, to in runs(b.column(1), 1_000_000):
                names, share = scorer.predict(b.column(1).slice(at, to - at))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(names, pa.string()), pa.array(share)], names=["id", "lang_pred", "score"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
