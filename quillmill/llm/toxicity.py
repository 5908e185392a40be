r"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Labels mark documents, so tokens get theirs by distant supervision. A word, or its first
four to eight letters, marks toxic documents if at least ``least`` of them hold it once, or
hold it twice, each in a context that no earlier one has (copies count once), if the share
of them is ``lift`` times that of clean ones, and if labels dealt by chance would seldom
give it as many (Fisher's test, at most ``false`` of the marking stems by chance). This is
asked among all documents, and among those of each group that shares its commonest words,
as those of a language do, so that a rare language has words of its own. The chain has two
labels; a token's features are its word, two prefixes and a suffix, of itself and of the
words on either side, hashed. It is trained by likelihood on windows around marked tokens
and on windows of clean documents, then again with those windows of clean documents that
it took for the most toxic.

Scoring computes forward-backward marginals over every token of the whole text. A
document's score is a logistic function, fitted on all training documents, of the sum of
its marginals, those under a tenth left out so that length is no evidence; runs of tokens
whose marginal is at least 1/2 are the toxic spans.

Training uses a bounded sample: at most ``per_class`` labelled documents of each class, in
the order of a hash of the id, and of them as many whole ones, in that order, as hold
``chars`` characters together. Scoring is one pass without a shuffle, documents vectorised
by length within batches of bounded size; a worker remembers words between tasks.

Defined cases: a null or empty text has no token, no span and the score of no evidence; a
label for no document, a null label or id and a repeated label (the largest counts) are
allowed; of several texts under one id the smallest is learned from, and rows without an id
are scored but never learned from; without toxic labels all scores are 0; ties do not
arise, a score of exactly 1/2 is toxic; repeated rows are scored alike; a text of any length
counts whole; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, portions

TOKEN = re.compile(r"\w+")
BUCKETS = 1 << 18
SIDES = 3  # own word, word before, word after
EDGE = ""  # the word outside a text


def _slots(word: str) -> list[int]:
    w = word.lower()
    names = (f"w{w}", f"p{w[:4]}", f"q{w[:5]}", f"s{w[-5:]}")
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


class Chain:
    """Weights of a two-label chain, label 0 as the reference of every emission."""

    def __init__(self):
        self.w = np.zeros((SIDES, BUCKETS))
        self.bias = -3.0
        self.trans = np.zeros((2, 2))
        self.scale, self.shift = 0.0, -50.0  # of the document score
        self.name = uuid.uuid4().hex

    # --- training ---------------------------------------------------------------

    def fit(self, windows: list[tuple[list[str], list[int]]], epochs: int = 40, rate: float = 0.2, l2: float = 3e-5) -> Chain:
        length = max(len(ws) for ws, _ in windows)
        n = len(windows)
        memo: dict[str, list[int]] = {}
        slots = np.zeros((n, length + 2, 4), dtype=np.int64)
        mask, y = np.zeros((n, length), bool), np.zeros((n, length), np.int64)
        edge = _slots(EDGE)
        for k, (ws, ys) in enumerate(windows):
            for t, w in enumerate([EDGE, *ws, EDGE]):
                slots[k, t] = edge if not w else memo.get(w) or memo.setdefault(w, _slots(w))
            slots[k, len(ws) + 2 :] = edge
            mask[k, : len(ws)], y[k, : len(ws)] = True, ys
        views = [slots[:, 1:-1], slots[:, :-2], slots[:, 2:]]
        theta = [self.w, np.array([self.bias]), self.trans]
        m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
        for step in range(1, epochs + 1):
            emit = sum(self.w[s][v].sum(-1) for s, v in enumerate(views)) + theta[1][0]
            p, pairs = _expect(emit, mask, self.trans)
            d = np.where(mask, y - p, 0.0) / n
            grads = [np.stack([np.bincount(v.ravel(), weights=np.repeat(d.ravel(), 4), minlength=BUCKETS) for v in views]) - l2 * self.w, np.array([d.sum()])]
            seen = np.zeros((2, 2))
            both = mask[:, 1:] & mask[:, :-1]
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1.0)
            grads.append((seen - pairs) / n)
            for x, g, a, b in zip(theta, grads, m1, m2, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            self.bias = float(theta[1][0])
        return self

    def calibrate(self, evidence: np.ndarray, label: np.ndarray) -> Chain:
        """Logistic regression of the label on the evidence, classes of equal weight."""
        x = np.stack([evidence, np.ones(len(evidence))], axis=1)
        weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
        ridge = np.array([1e-3, 0.0])

        def loss(w):
            return float(weight @ np.logaddexp(0, np.where(label == 1, -1, 1) * (x @ w)) + 0.5 * ridge @ (w * w))

        w = np.array([0.5, -0.5])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - label)) + ridge * w
            h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge + 1e-9)
            step, t = np.linalg.solve(h, g), 1.0
            while t > 1e-4 and loss(w - t * step) > loss(w):
                t /= 2
            w = w - t * step
        self.scale, self.shift = float(max(w[0], 0.0)), float(w[1])
        return self

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * evidence + self.shift, -50, 50)))


def _expect(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 and expected transition counts of windows padded at the end."""
    n, length = emit.shape
    e = np.exp(np.clip(np.where(mask, emit, 0.0), -30, 30))
    a = np.exp(trans)
    alpha, beta = np.zeros((length, n, 2)), np.ones((length, n, 2))
    alpha[0] = np.stack([np.ones(n), e[:, 0]], 1)
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, length):
        v = alpha[t - 1] @ a
        v[:, 1] *= e[:, t]
        v /= v.sum(1, keepdims=True)
        alpha[t] = np.where(mask[:, t, None], v, alpha[t - 1])
    for t in range(length - 2, -1, -1):
        v = beta[t + 1].copy()
        v[:, 1] *= e[:, t + 1]
        v = v @ a.T
        v /= v.sum(1, keepdims=True)
        beta[t] = np.where(mask[:, t + 1, None], v, 1.0)
    p = alpha * beta
    p = p[:, :, 1] / p.sum(2)
    pairs = np.zeros((2, 2))
    for t in range(1, length):
        ok = mask[:, t]
        q = alpha[t - 1][ok][:, :, None] * a[None] * (beta[t][ok] * np.stack([np.ones(ok.sum()), e[ok, t]], 1))[:, None, :]
        pairs += (q / q.sum((1, 2), keepdims=True)).sum(0)
    return p.T, pairs


class Tagger:
    """Log odds of label 1 for every token of many texts."""

    def __init__(self, chain: Chain, limit: int = 200_000):
        self.chain, self.limit = chain, limit
        self.index: dict[str, int] = {}
        self.parts = np.zeros((1024, SIDES))
        self._add([EDGE])

    def _add(self, words: list[str]) -> None:
        if not words:
            return
        need = len(self.index) + len(words)
        if need > len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros((max(need, len(self.parts)), SIDES))])
        slots = np.asarray([_slots(w) for w in words])
        self.parts[len(self.index) : need] = np.stack([self.chain.w[s][slots].sum(1) for s in range(SIDES)], 1)
        self.index.update(zip(words, range(len(self.index), need), strict=True))

    def log_odds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat log odds of all tokens, and how many tokens each text has."""
        words = [TOKEN.findall(t) for t in texts]
        new = set().union(*words) - self.index.keys() if words else set()
        if len(self.index) + len(new) > self.limit:
            self.index.clear()
            self._add([EDGE])
            new = set().union(*words) - {EDGE}
        self._add(sorted(new))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        get = self.index.__getitem__
        flat = np.fromiter((k for ws in words for k in map(get, ws)), np.int64, int(counts.sum()))
        emit = self.parts[flat, 0] + self.chain.bias
        before, after = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)  # 0 is the edge
        before[1:], after[:-1] = flat[:-1], flat[1:]
        ends = np.cumsum(counts)
        has = counts > 0
        before[(ends - counts)[has]], after[ends[has] - 1] = 0, 0
        emit += self.parts[before, 1] + self.parts[after, 2]
        return self._chain(np.exp(np.clip(emit, -30, 30)), counts, ends - counts), counts

    def _chain(self, e: np.ndarray, counts: np.ndarray, starts: np.ndarray, cells: int = 1_000_000) -> np.ndarray:
        a = np.exp(self.chain.trans)
        out = np.empty(len(e))
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        while len(order):
            longest = int(counts[order[0]])
            take, order = order[: max(1, cells // longest)], order[max(1, cells // longest) :]
            n, s = counts[take], starts[take]
            active = np.searchsorted(-n, -np.arange(longest), side="left")  # texts of more than t tokens
            f: list[np.ndarray] = []
            for t in range(longest):
                k = active[t]
                x = e[s[:k] + t]
                if t:
                    r = f[-1][:k]
                    x = x * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)
                f.append(x)
            g = np.ones(len(take))
            for t in range(longest - 1, -1, -1):
                k = active[t]
                at = s[:k] + t
                out[at] = np.log(f[t] * g[:k])
                h = e[at] * g[:k]
                g[:k] = (a[1, 0] + a[1, 1] * h) / (a[0, 0] + a[0, 1] * h)
        return out


_taggers: dict[str, Tagger] = {}


def tagger_of(chain: Chain) -> Tagger:
    """One tagger for each worker process, so that later tasks find its words."""
    if chain.name not in _taggers:
        _taggers.clear()
        _taggers[chain.name] = Tagger(chain)
    return _taggers[chain.name]


STEM = 8  # longest beginning of a word that may mark it


def _stems(word: str) -> set[str]:
    """What a word may be marked by: itself and its beginnings."""
    return {word, *(f"{word[:n]}-" for n in range(4, min(STEM, len(word)) + 1))}


def _groups(docs: list[list[str]], top: int = 300, alike: float = 0.5) -> list[np.ndarray]:
    """Documents that share their commonest words, such as those of one language; each is in one group."""
    spread = Counter(w for ws in docs for w in set(ws))
    column = {w: k for k, (w, _) in enumerate(sorted(spread.items(), key=lambda x: (-x[1], x[0]))[:top])}
    x = np.zeros((len(docs), max(1, len(column))), np.float32)
    for k, ws in enumerate(docs):
        for w, n in Counter(ws).items():
            if w in column:
                x[k, column[w]] = n**0.5
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    heads: list[np.ndarray] = []
    for k in np.argsort([-len(ws) for ws in docs], kind="stable"):  # long documents open groups
        at = [float(h @ x[k]) / max(float(np.linalg.norm(h)), 1e-9) for h in heads]
        if at and max(at) >= alike:
            heads[int(np.argmax(at))] = heads[int(np.argmax(at))] + x[k]
        else:
            heads.append(x[k].copy())
    unit = np.stack([h / max(float(np.linalg.norm(h)), 1e-9) for h in heads])
    nearest = (x @ unit.T).argmax(axis=1)
    return [np.flatnonzero(nearest == g) for g in range(len(heads))]


def _by_chance(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Chance that a or more of the a + b documents with a stem are toxic if labels do not matter."""
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, toxic + clean + 1)))])
    n = a + b

    def term(k):
        ok = (k <= toxic) & (k <= n) & (n - k <= clean)
        k = np.where(ok, k, a)
        return np.where(ok, np.exp(log[toxic] - log[k] - log[toxic - k] + log[clean] - log[n - k] - log[clean - n + k] - (log[toxic + clean] - log[n] - log[toxic + clean - n])), 0.0)

    return np.minimum(sum(term(a + j) for j in range(int((np.minimum(n, toxic) - a).max()) + 1)), 1.0)


def _lexicon(toxic: list[list[str]], clean: list[list[str]], least: int, lift: float, false: float) -> dict[str, int]:
    """Stems that mark toxic documents, and how often one must occur in a document to do so."""
    out: dict[str, int] = {}
    number: dict[str, int] = {}
    of: dict[str, np.ndarray] = {}  # the stems of a word
    stem, context, doc = [], [], []
    for k, ws in enumerate(toxic):
        for before, w, after in zip([EDGE, *ws], ws, [*ws[1:], EDGE], strict=False):
            if w not in of:
                of[w] = np.array([number.setdefault(s, len(number)) for s in sorted(_stems(w))], np.int32)
            stem.append(of[w])
            context.append(zlib.crc32(f"{before} {w} {after}".encode()) << 32 | zlib.crc32(f"{after} {before}".encode()))
            doc.append(k)
    times = [len(x) for x in stem]
    stem = np.concatenate(stem) if stem else np.zeros(0, np.int32)
    context, doc = np.repeat(np.array(context, np.uint64), times), np.repeat(np.array(doc, np.int32), times)
    del times
    # a copy has no context of its own: a context counts for the first document that holds it
    order = np.lexsort((doc, context, stem))
    first = np.ones(len(order), bool)
    first[1:] = (stem[order[1:]] != stem[order[:-1]]) | (context[order[1:]] != context[order[:-1]])
    new = np.unique(stem[order[first]].astype(np.int64) << 32 | doc[order[first]])
    held, often = np.unique(stem.astype(np.int64) << 32 | doc, return_counts=True)
    often = often[np.searchsorted(held, new)]
    name = list(number)
    fresh = {need: Counter({name[s]: int(n) for s, n in zip(*np.unique(new[often >= need] >> 32, return_counts=True), strict=True)}) for need in (1, 2)}
    del stem, context, doc, order, first, held
    tried = {s for s, n in fresh[1].items() if n >= least}
    in_clean: dict[int, Counter] = {1: Counter(), 2: Counter()}
    for ws in clean:
        times = Counter()
        for w, n in Counter(ws).items():
            for s in _stems(w) & tried:
                times[s] += n
        for need, count in in_clean.items():
            count.update(s for s, n in times.items() if n >= need)
    for need in (1, 2):
        stems = sorted(s for s in tried if fresh[need][s] >= least)
        if not stems:
            continue
        a, b = (np.array([c[s] for s in stems]) for c in (fresh[need], in_clean[need]))
        chance = _by_chance(a, b, len(toxic), len(clean))
        order = np.argsort(chance, kind="stable")
        fits = np.flatnonzero(chance[order] <= false * np.arange(1, len(stems) + 1) / len(stems))
        often = a / len(toxic) >= lift * ((b + 0.5) / max(1, len(clean)))
        for k in order[: fits[-1] + 1 if len(fits) else 0]:
            if often[k]:
                out.setdefault(stems[k], need)
    return out


def _marks(ws: list[str], marked: dict[str, int]) -> list[int]:
    """Which words of a toxic document hold a stem that marks it, as often as it must."""
    stems = [_stems(w) & marked.keys() for w in ws]
    times = Counter(s for found in stems for s in found)
    return [int(any(times[s] >= marked[s] for s in found)) for found in stems]


def _marked(toxic: list[list[str]], clean: list[list[str]], least: int, lift: float, false: float) -> list[dict[str, int]]:
    """The lexicon of each toxic document: that of its group and that of all documents."""
    every = _lexicon(toxic, clean, least, lift, false)
    out = [every] * len(toxic)
    for group in _groups([*toxic, *clean]):
        own, others = group[group < len(toxic)], group[group >= len(toxic)] - len(toxic)
        if len(own) >= least and len(others) and len(group) < len(toxic) + len(clean):
            here = dict(every)
            for s, n in _lexicon([toxic[k] for k in own], [clean[k] for k in others], least, lift, false).items():
                here[s] = min(n, here.get(s, n))
            for k in own:
                out[k] = here
    return out


def train(texts: list[str], labels: list[int], *, least: int = 3, lift: float = 8.0, false: float = 0.05, reach: int = 10, rounds: int = 2, seed: int = 5) -> Chain:
    """A calibrated chain from whole labelled texts."""
    one: dict[str, str] = {}  # of equal words one object
    words = [[one.setdefault(w, w) for w in TOKEN.findall(t.lower())] for t in texts]
    del one
    toxic, clean = ([w for w, y in zip(words, labels, strict=True) if y == k and w] for k in (1, 0))
    chain = Chain()
    rng = np.random.default_rng(seed)
    windows = []
    for ws, marked in zip(toxic, _marked(toxic, clean, least, lift, false) if toxic else [], strict=True):
        marks = _marks(ws, marked)
        at = np.flatnonzero(marks)
        for t in rng.permutation(at)[:3]:
            part = slice(max(0, t - reach), t + reach + 1)
            windows.append((ws[part], marks[part]))
    if not windows:
        return chain
    for ws in clean:
        for t in rng.integers(0, len(ws), size=2):
            part = ws[max(0, t - reach) : t + reach + 1]
            windows.append((part, [0] * len(part)))
    chain.fit(windows)
    for _ in range(rounds):  # what it takes for toxic in clean documents is learned next
        tagger = Tagger(chain)
        odds, counts = tagger.log_odds([" ".join(ws) for ws in clean])
        ends = np.cumsum(counts)
        for ws, lo, hi in zip(clean, ends - counts, ends, strict=True):
            for t in np.argsort(-odds[lo:hi], kind="stable")[:2]:
                part = ws[max(0, t - reach) : t + reach + 1]
                windows.append((part, [0] * len(part)))
        chain = Chain().fit(windows)
    return chain.calibrate(evidence_of(Tagger(chain), texts), np.asarray(labels, dtype=np.float64))


def evidence_of(tagger: Tagger, texts: list[str]) -> np.ndarray:
    """Each text's sum of marginals of at least a tenth."""
    return _evidence(*tagger.log_odds(texts))


def _evidence(odds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-odds))
    out = np.zeros(len(counts))
    has = counts > 0
    if has.any():
        out[has] = np.add.reduceat(np.where(p >= 0.1, p, 0.0), (np.cumsum(counts) - counts)[has])
    return out


def sample(docs: DataFrame, labels: DataFrame, per_class: int, chars: int) -> tuple[list[str], list[int]]:
    """At most ``per_class`` labelled texts of each class, of at most ``chars`` characters, one for each id."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.xxhash64("doc_id")
    chosen = None
    for k in (0, 1):
        part = one.where(F.col("toxic") == k).orderBy(place, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(chosen)  # two rows of a few bytes for each of per_class
    once = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(place, "doc_id"))
    rows = once.withColumn("upto", upto).where(F.col("upto") <= chars // 2).orderBy("toxic", place, "doc_id").select("text", "toxic").toPandas()
    return rows["text"].tolist(), rows["toxic"].tolist()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, chars: int = 40_000_000) -> Chain:
    """Train on a bounded sample of the labelled documents."""
    texts, ys = sample(docs, labels, per_class, chars)
    chain = train(texts, ys)
    give_back()
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("score", "spans")) -> DataFrame:
    """The id and ``keep`` columns, a score and the toxic spans as (start, stop, log odds).

    names: of the two new columns, for inputs that keep columns of these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few MB whatever the corpus
    kept = list(dict.fromkeys([id_col, *keep]))
    columns = list(dict.fromkeys([*kept, text_col]))
    source = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*kept).schema) + f", `{names[0]}` double, `{names[1]}` array<struct<start:bigint,stop:bigint,odds:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = tagger_of(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("odds", pa.float64())]))
        for b in batches:
            for at, to, part in portions(b, columns.index(text_col), 2_000_000):
                odds, counts = tagger.log_odds(part)
                ends = np.cumsum(counts)
                evidence = _evidence(odds, counts)
                spans = [[] for _ in part]
                for k in np.unique(np.searchsorted(ends, np.flatnonzero(odds >= 0), side="right")):
                    spans[k] = _spans(part[k], odds[ends[k] - counts[k] : ends[k]])
                rest = [b.column(columns.index(c)).slice(at, to - at) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(tagger.chain.score(evidence)), pa.array(spans, kind)], names=[*kept, *names])
        give_back()

    return source.mapInArrow(run, schema)


def _spans(text: str, odds: np.ndarray) -> list[dict]:
    out: list[dict] = []
    last = -2
    for k, m in enumerate(TOKEN.finditer(text)):
        if odds[k] >= 0:
            if k == last + 1:
                out[-1] |= {"stop": m.end(), "odds": max(out[-1]["odds"], float(odds[k]))}
            else:
                out.append({"start": m.start(), "stop": m.end(), "odds": float(odds[k])})
            last = k
    return out
