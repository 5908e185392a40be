"""Nearest neighbours by a block matrix join with quantised products and exact finishing.

Queries and candidates are dealt to blocks and every tile of a query block and a candidate
block is one task. A tile multiplies int8 codes (as exact small floats), which gives each
inner product up to a bound known from the vectors' quantisation errors:
|x.y - ax.ay| <= |ax||ey| + |ex||y|, with a the decoded code and e the error. A candidate
whose upper bound lies below the k-th best lower bound cannot be among the k nearest; the
others are recomputed in double precision from the original vectors. Each tile merges its
pieces by heaps to the k best of each query, and the tiles' lists are merged by rank. The
result is exact, so its recall is 1.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part; a candidate of another length than the query is none of its candidates;
repeated rows of an id are one vector, the first by value; ties go to the smaller id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrix, usable

OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the decoded vectors and of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = code * scale[:, None]
    return code, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(x - decoded, axis=1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on: equal vectors score equally."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def nearest_in_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, piece: int = 2048, rows: int = 256) -> list[list[tuple[float, int]]]:
    """For each query its k nearest candidates as (-score, id), nearest first."""
    best: list[list[tuple[float, int]]] = [[] for _ in qid]
    qc, qs, qd, qe = quantise(q)
    qn = np.linalg.norm(q, axis=1)
    exact = np.float32 if q.shape[1] <= 1024 else np.float64  # holds sums of int8 products exactly
    for at in range(0, len(cid), piece):
        ids, y = cid[at : at + piece], c[at : at + piece]
        yc, ys, yd, ye = quantise(y)
        yf = yc.astype(exact).T
        for lo in range(0, len(qid), rows):
            part = slice(lo, lo + rows)
            near = (qc[part].astype(exact) @ yf).astype(np.float64) * qs[part][:, None] * ys[None, :]
            err = (qd[part][:, None] * ye[None, :] + qe[part][:, None] * (yd + ye)[None, :]) * (1 + 1e-9) + 1e-12 * (qn[part][:, None] * yd[None, :])
            own = qid[part][:, None] == ids[None, :]
            low = np.where(own, -np.inf, near - err)
            if len(ids) > k:
                bar = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
            else:
                bar = np.full(len(low), -np.inf)
            bar = np.maximum(bar, [-b[k - 1][0] if len(b := best[lo + r]) >= k else -np.inf for r in range(len(low))])
            i, j = np.nonzero((near + err >= bar[:, None]) & ~own)
            score = products(q[lo + i], y[j]) if len(i) else np.zeros(0)
            cut = np.searchsorted(i, np.arange(len(low) + 1))
            for r in range(len(low)):
                s, v = score[cut[r] : cut[r + 1]], ids[j[cut[r] : cut[r + 1]]]
                if len(s):
                    order = np.lexsort((v, -s))[:k]
                    best[lo + r] = [x for x, _ in zip(heapq.merge(best[lo + r], zip((-s[order]).tolist(), v[order].tolist(), strict=True)), range(k), strict=False)]
    return best


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            a, b = (t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) for t in (left, right))
            for dim in np.unique(a):
                l, r = left.filter(pa.array(a == dim)), right.filter(pa.array(b == dim))
                if r.num_rows:
                    qid = l["id"].to_numpy()
                    for q, found in zip(qid.tolist(), nearest_in_tile(qid, matrix(l["v"]), r["id"].to_numpy(), matrix(r["v"]), k), strict=True):
                        rows += [(q, v, -s) for s, v in found]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(OUT, columns, strict=True)}, schema=OUT)

    return run


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 20, query_block: int = 4096, candidate_block: int = 8192, components: int = 1 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product of every query.

    is_query: a condition on ``id``. query_block, candidate_block: most vectors of a tile's
    sides; components: most vector components of a side, so long vectors come in fewer.
    """
    every = materialize(usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    counts = every.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("dim")).first()
    fit = max(1, components // (counts["dim"] or 1))
    nc, nq = (max(1, math.ceil(n / min(size, fit))) for n, size in ((counts["n"], candidate_block), (counts["q"], query_block)))
    block = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(n)).alias(name)
    # every query block meets every candidate block in a tile of its own
    left = every.where(is_query).select("id", "v", block("qb", nq), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nc - 1).cast("long"))).alias("cb"))
    right = every.select("id", "v", block("cb", nc), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))
    tiles = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tiles.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
