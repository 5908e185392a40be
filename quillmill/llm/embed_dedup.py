"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components.

Each table hashes a vector to the signs of its products with ``bits`` random hyperplanes.
Bits grow with the logarithm of the number of vectors, which keeps buckets alike in size,
and the number of tables follows from the wanted probability that a pair at the threshold
shares a bucket. Vectors with equal components are first collapsed into one representative
with a count.

What goes to a bucket is an id and 128 signs of further hyperplanes. Members that differ
from all others there in more signs than a pair at the threshold does but once in a hundred
times 1/``miss`` have no link in it; only the others' vectors follow, each once for each
bucket where it has company, and their cosines are computed. Buckets of at most ``block``
vectors are compared in tasks of many buckets; larger ones in tiles of two blocks, so no
bucket meets in one task. A tile returns the number of links of each vector and a spanning
forest of its links, never the pairs; a pair that shares several tables counts in the first
of them only.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are kept; vectors of different lengths link with nothing either;
repeated rows of an id are one vector, the first by a hash of its value; a null id gives no
row; ties do not arise, since a link is a matter of the threshold alone; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release
from .minhash import _forest
from .vectors import matrix, usable

OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
NEAR = pa.schema([(n, pa.int64()) for n in ("code", "i", "j", "block", "id")])
MOST_TABLES = 1024  # a code's lowest digits are its table
SIGNS = 128


def tables_for(bits: int, threshold: float, miss: float) -> int:
    """Tables that lose a pair at ``threshold`` with probability at most ``miss``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(miss) / math.log1p(-same)))
    if tables > MOST_TABLES:
        raise ValueError(f"a threshold of {threshold} with a miss of {miss} takes {tables} tables of {bits} bits, of at most {MOST_TABLES}")
    return tables


def signs_apart(threshold: float, miss: float) -> int:
    """Of ``SIGNS`` signs, as many as a pair at ``threshold`` differs in at most, but with probability ``miss``."""
    p = math.acos(threshold) / math.pi
    above, k = 1.0, -1
    while above > miss:
        k += 1
        above -= math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
    return k


def _signed(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Vectors with their codes in all tables as packed bits, their length, and further signs as two numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            v = b.column(2)
            lengths = v.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits + SIGNS))
                signs = matrix(v.take(at)) @ planes[dim] > 0
                packed = np.packbits(signs[:, : tables * bits], axis=1)
                more = np.packbits(signs[:, tables * bits :], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), v.take(at).cast(pa.list_(pa.float32())), pa.array(list(map(bytes, packed)), pa.binary()), pa.array(np.full(len(at), dim, np.int32)), pa.array(more[:, 0]), pa.array(more[:, 1])],
                    names=["id", "times", "v", "codes", "dim", "s1", "s2"])

    return vectors.select("id", "times", "v").mapInArrow(run, "id long, times long, v array<float>, codes binary, dim int, s1 long, s2 long")


def _numbers(packed: list[bytes], bits: int, tables: int) -> np.ndarray:
    """Codes of vectors, a column for each table."""
    flat = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return np.unpackbits(flat, axis=1, count=tables * bits).reshape(len(flat), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _placed(signed: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row for each vector and table: the bucket's code, the id, the further signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                dims = b.column(2).to_numpy()[:, None].astype(np.int64)
                code = (_numbers(b.column(1).to_pylist(), bits, tables) * 65536 + dims % 65536) * MOST_TABLES + np.arange(tables)
                again = pa.array(np.repeat(np.arange(len(b)), tables))
                yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), *(b.column(k).take(again) for k in (0, 3, 4))], names=["code", "id", "s1", "s2"])

    return signed.select("id", "codes", "dim", "s1", "s2").mapInArrow(run, "code long, id long, s1 long, s2 long")


def _buckets(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of each bucket of two or more, and which of them are its left and its right side."""
    code, block = table["code"].to_numpy(), table["block"].to_numpy()
    order = np.lexsort((block, code))
    cut = np.flatnonzero(np.diff(code[order])) + 1
    for rows in np.split(order, cut):
        if len(rows) > 1:
            first = block[rows] == block[rows[0]]
            yield rows, np.flatnonzero(first), np.flatnonzero(~first) if not first.all() else np.arange(len(rows))


def _filter(apart: int):
    def run(table: pa.Table) -> pa.Table:
        signs = np.stack([table["s1"].to_numpy(), table["s2"].to_numpy()], axis=1).view(np.uint64)
        kept = []
        for rows, left, right in _buckets(table):
            a, b = signs[rows[left]], signs[rows[right]]
            near = sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.int16) for k in (0, 1)) <= apart
            if left[0] == right[0]:
                np.fill_diagonal(near, False)
                kept.append(rows[near.any(axis=1)])
            else:
                kept += [rows[left[near.any(axis=1)]], rows[right[near.any(axis=0)]]]
        at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return table.select(NEAR.names).take(pa.array(at)).cast(NEAR)

    return run


def _compare(threshold: float, bits: int, tables: int):
    def run(table: pa.Table) -> pa.Table:
        ids, code, times = (table[c].to_numpy() for c in ("id", "code", "times"))
        dims = table["v"].combine_chunks().value_lengths().to_numpy()
        numbers = _numbers(table["codes"].to_pylist(), bits, tables)
        vectors = table["v"].combine_chunks()
        links = np.zeros(len(ids), np.int64)
        forest: list[tuple[int, int]] = []
        for rows, left, right in _buckets(table):
            if len(set(dims[rows])) > 1:  # lengths that agree modulo 65,536; those are no links
                continue
            y = matrix(vectors.take(pa.array(rows)))
            y = y / np.linalg.norm(y, axis=1)[:, None]
            i, j = np.nonzero(y[left] @ y[right].T >= threshold)
            i, j = left[i], right[j]
            ok = i < j if left[0] == right[0] else np.ones(len(i), bool)
            i, j = rows[i[ok]], rows[j[ok]]
            table_no = int(code[rows[0]] % MOST_TABLES)
            new = ~(numbers[i, :table_no] == numbers[j, :table_no]).any(axis=1)
            i, j = i[new], j[new]
            np.add.at(links, i, times[j])
            np.add.at(links, j, times[i])
            forest += _forest(i, j, len(ids)) if len(i) else []
        has = np.flatnonzero(links)
        a = [*ids[has].tolist(), *(int(ids[p]) for p, _ in forest)]
        b = [*[None] * len(has), *(int(ids[q]) for _, q in forest)]
        n = [*links[has].tolist(), *[None] * len(forest)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())}, schema=OUT)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.95, miss: float = 1e-4,
                    bucket: int = 256, block: int = 1024, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id, kept), one row per id.

    miss: most probability of losing a pair exactly at the threshold. bucket: wanted mean
    size of a bucket. block: vectors that a task compares with each other at once.
    """
    ids = vectors.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    every = usable(vectors, id_col, vector_col).select("id", "v", F.xxhash64("v").alias("p1"), F.xxhash64(F.lit("second"), "v").alias("p2"))
    # vectors themselves move once, to be one of each; everything before and after works on hashes
    printed = materialize(every.groupBy("id").agg(F.min(F.struct("p1", "p2")).alias("p")).select("id", "p.p1", "p.p2"), "prints")
    same = materialize(printed.groupBy("p1", "p2").agg(F.min("id").alias("rep"), F.count("*").alias("times")), "same")
    member = printed.join(same, ["p1", "p2"]).select("id", "rep", "times")
    first = same.select(F.col("rep").alias("id"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "times")
    reps = every.join(first, "id").where("p1 = q1 and p2 = q2").groupBy("id").agg(F.first("times").alias("times"), F.first("v").alias("v"))
    total = printed.count()
    bits = max(4, math.ceil(math.log2(max(total, 1) / bucket + 1)))
    tables = tables_for(bits, threshold, miss)
    signed = materialize(_signed(reps, bits, tables, seed), "signed")
    placed = _placed(signed, bits, tables)
    hot = materialize(placed.groupBy("code").agg(F.count("*").alias("m")).where(F.col("m") > block), "hot")
    placed = placed.join(hot, "code", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int")).withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    # many small buckets share a task's group; a large one has a group for each two blocks

    def grouped(rows: DataFrame, blocks: str, size: int) -> DataFrame:
        own = F.when(F.col(blocks), F.pmod(F.xxhash64("code"), F.lit(max(1, size)))).otherwise(-1 - F.col("code"))
        return rows.withColumn("g", own).groupBy("g", "i", "j")

    tiles = placed.withColumn("other", F.expr("explode(sequence(0L, blocks - 1L))")).select(
        "id", "s1", "s2", "code", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("blocks") == 1).alias("small"))
    near = grouped(tiles, "small", total * tables // 8192).applyInArrow(_filter(signs_apart(threshold, miss / 100)), "code long, i long, j long, block long, id long")
    near = materialize(near, "near")
    followed = near.join(signed.select("id", "times", "v", "codes"), "id").withColumn("small", (F.col("i") == 0) & (F.col("j") == 0))
    found = materialize(grouped(followed, "small", near.count() // 4096).applyInArrow(_compare(threshold, bits, tables), "a long, b long, n long"), "found")
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    component = parts.select(F.col("id").alias("rep"), "component")
    linked = (member.join(counts, "rep", "left").join(component, "rep", "left")
              .select("id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = ids.join(linked, "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col("id") == F.col("component_id"))
    out = materialize(out, "classes")
    for done in (signed, hot, near, printed, same, found, parts):
        release(done)
    return out
