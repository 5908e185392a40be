"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to tiers of window sizes (powers of two up to the longest). A
document longer than the longest window gives whole windows first and its rest is
routed. Each tier, longest first, opens a window for its longest waiting document and
fills the gap with the longest waiting pieces of that and the shorter tiers that fit;
where none fits, one is cut to close the gap and its rest waits on. So every window is
full. What remains at the end of a partition goes into ever smaller windows. Windows of
one tier are dealt to step groups of equal token counts, in snake order of attention
cost (the sum of squared piece lengths), so that the groups of a step take equally long.

The operator is one pass over the input partitions without a shuffle: a task holds at
most ``pool_tokens`` waiting tokens, whatever the partition's size.

Defined cases: null and empty texts are one piece with the closing id alone; repeated
rows and ids are packed as often as they come; an empty table gives an empty result;
extra columns are ignored; any text length is cut into windows as it is tokenised.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, portions

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in "start length ids_crc32 doc_tokens sequence_id offset".split()), ("tier", pa.int32()), ("step_group", pa.int64())])
LOCAL_BITS = 36  # a sequence's number within its partition; the bits above are the partition


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose words never span white space.

    Such a tokenizer gives a text the ids of its blank-separated chunks, one after
    another, so chunks are looked up and only new ones are encoded, many in one call.
    A chunk that is a word and closing punctuation is looked up in its two halves, which
    the tokenizer also separates. Both caches are emptied at ``limit`` entries. A chunk
    with anything unusual is encoded alone.
    """

    # letters that are the same under NFC, lower-cased one by one; no apostrophes after them
    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._limit = limit
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, new: list[str]) -> None:
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            e = self._tokenizer.encode(" ".join(part), add_special_tokens=False)
            of = np.asarray(e.word_ids, dtype=np.int64)
            ids = np.asarray(e.ids, dtype="<u4")
            if len(of) and of[-1] == len(part) - 1:
                edges = np.searchsorted(of, np.arange(len(part) + 1))
                self._words.update((w, ids[edges[k] : edges[k + 1]].tobytes()) for k, w in enumerate(part))
            else:
                self._words.update((w, self._alone(w)) for w in part)

    def learn(self, chunks: set[str]) -> None:
        if len(self._words) > self._limit:
            self._words.clear()
        halves = []
        for c in chunks:
            m = self._plain.match(c)
            if m:
                halves.append((c, m[1].lower(), m[2]))
            else:
                self._chunks[c] = self._alone(c)
        words = {w for _, w, _ in halves if w not in self._words}
        self._learn_words(sorted(words))
        for p in {p for _, _, p in halves if p and p not in self._words}:
            self._words[p] = self._alone(p)
        words = self._words
        self._chunks.update((c, words[w] + words[p] if p else words[w]) for c, w, p in halves)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self._chunks)
        if len(self._chunks) + len(new) > self._limit:
            self._chunks.clear()
            new = set().union(*split)
        self.learn(new)
        of = self._chunks.__getitem__
        return [b"".join(map(of, parts)) for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str, limit: int = 1_000_000) -> WordTokenizer:
    """One tokenizer for each worker process, so that later tasks find the caches filled."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path, limit)
    _tokenizers[path]._limit = limit
    return _tokenizers[path]


class _Tiers:
    """Waiting pieces by length; each is (length, number, start, doc_id, doc_tokens, ids)."""

    def __init__(self, top: int, group_tokens: int, spread: int, base: int):
        self.top, self.group_tokens, self.spread = top, group_tokens, spread
        self.waiting: list[tuple] = []  # ascending in length, then arrival
        self.tokens = self.number = 0
        self.next_sequence = self.next_group = base
        self.closed: dict[int, list[list[tuple]]] = {}  # windows of a tier that no step group has yet
        self.out: list[tuple] = []

    def add(self, doc_id, tokens: bytes) -> None:
        n = len(tokens) // 4
        whole = n - n % self.top
        for start in range(0, whole, self.top):
            self._close(self.top, [(self.top, 0, start, doc_id, n, tokens[4 * start : 4 * (start + self.top)])])
        if n > whole:
            self._wait((n - whole, 0, whole, doc_id, n, tokens[4 * whole :]))

    def _wait(self, piece: tuple) -> None:
        self.number += 1
        insort(self.waiting, (piece[0], self.number, *piece[2:]))
        self.tokens += piece[0]

    def _take(self, longest: int) -> tuple | None:
        """The longest waiting piece of at most that many tokens."""
        k = bisect_right(self.waiting, (longest + 1,)) - 1
        if k < 0:
            return None
        self.tokens -= self.waiting[k][0]
        return self.waiting.pop(k)

    def fill(self, window: int) -> None:
        """Close one window of that size; at least as many tokens wait."""
        pieces, gap = [], window
        while gap:
            p = self._take(gap)
            if p is None:
                p = self.waiting.pop(0)
                self.tokens -= p[0]
                n, _, start, doc, total, ids = p
                self._wait((n - gap, 0, start + gap, doc, total, ids[4 * gap :]))
                p = (gap, 0, start, doc, total, ids[: 4 * gap])
            pieces.append(p)
            gap -= p[0]
        self._close(window, pieces)

    def drain(self, left: int) -> None:
        """Fill windows until at most ``left`` tokens wait, each in the tier of the longest waiting piece."""
        while self.tokens > left:
            window = 1 << (self.waiting[-1][0] - 1).bit_length()
            while window > self.tokens:
                window >>= 1
            self.fill(window)

    def _close(self, window: int, pieces: list[tuple]) -> None:
        held = self.closed.setdefault(window, [])
        held.append([(n, start, doc, total, zlib.crc32(ids)) for n, _, start, doc, total, ids in pieces])
        if len(held) >= self.spread * max(1, self.group_tokens // window):
            self.deal(window)

    def deal(self, window: int) -> None:
        """Deal the closed windows of a tier to step groups, in snake order of attention cost."""
        held = sorted(self.closed.pop(window, []), key=lambda ps: -sum(p[0] * p[0] for p in ps))
        groups = -(-len(held) // max(1, self.group_tokens // window)) or 1
        for i, pieces in enumerate(held):
            lap, k = divmod(i, groups)
            group = self.next_group + (k if lap % 2 == 0 else groups - 1 - k)
            offset = 0
            for n, start, doc, total, crc in pieces:
                self.out.append((doc, start, n, crc, total, self.next_sequence, offset, window, group))
                offset += n
            self.next_sequence += 1
        self.next_group += groups

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, top: int = 4096,
         pool_tokens: int = 2_000_000, group_tokens: int = 65536, spread: int = 16, cache: int = 1_000_000) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    tokenizer_path: a file every executor has, of a tokenizer whose words end at blanks.
    end_id closes each document. top: longest window, a power of two. pool_tokens: tokens
    that wait in a task before windows are filled. group_tokens: tokens of a step group.
    spread: step groups dealt at a time. cache: words a worker remembers, about 350 bytes
    each, also between tasks. Sequence numbers are unique and hold the
    partition's number above ``LOCAL_BITS`` bits.
    """
    if top & (top - 1):
        raise ValueError("top must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        tiers = _Tiers(top, group_tokens, spread, (context.partitionId() if context else 0) << LOCAL_BITS)
        encode = tokenizer_at(tokenizer_path, cache).encode_all
        end = np.asarray([end_id], dtype="<u4").tobytes()

        def batch() -> pa.RecordBatch:
            rows = tiers.rows()
            columns = list(zip(*rows, strict=True)) or [[] for _ in _ARROW]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        for b in batches:
            for at, to, texts in portions(b, 1, 60_000):
                for doc, ids in zip(b.column(0).slice(at, to - at).to_pylist(), encode(texts), strict=True):
                    tiers.add(doc, ids + end)
                    if tiers.tokens > pool_tokens:
                        tiers.drain(pool_tokens // 2)
                if len(tiers.out) > 20_000:
                    yield batch()
        tiers.drain(0)
        for window in sorted(tiers.closed, reverse=True):
            tiers.deal(window)
        yield batch()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
