"""Shared helpers: durable intermediate tables, hashing, connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back
    to a temporary folder; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quillmill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a
    lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmill_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a ``materialize`` result that nothing reads any more."""
    path = getattr(df, "_quillmill_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [w for w in _written if w[1] != path]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns, each lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


# --- Arrow batches -----------------------------------------------------------------


def runs(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows with about so many characters. A longer text is a run of its own."""
    upto = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + chars, side="right")))
        yield at, to
        at = to


def portions(batch: pa.RecordBatch, column: int, chars: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, texts) of such runs, null as empty; only one run's texts are Python objects at a time."""
    texts = batch.column(column)
    for at, to in runs(texts, chars):
        yield at, to, [t or "" for t in texts.slice(at, to - at).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and their
    allocator would keep its pages. Does nothing where the C library has no such call."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# --- hashing ---------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """uint64 hashes to doubles in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingle_hashes(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words for many documents at once.

    words: word hashes of all documents, one after another; starts, counts: where each
    lies. A document of fewer than ``width`` words, but at least one, is one shingle of
    all its words. Returns the shingle hashes and how many each document has.
    """
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(starts - (np.cumsum(per) - per), per) + np.arange(per.sum())
    left = np.repeat(np.minimum(counts, width), per)
    out = np.full(len(at), _GOLD, dtype=np.uint64)
    last = len(words) - 1
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = left > k
            out = np.where(inside, mix64(out * np.uint64(31) + words[np.minimum(at + k, max(last, 0))]), out)
    return out, per


# --- connected components -----------------------------------------------------------


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """Smallest reachable id of every id that occurs in ``edges``, as (id, component).

    Alternating large-star and small-star contraction: each round is two grouped minima
    and two joins on ids, so no task ever holds a component, and the number of rounds
    grows with the logarithm of the longest path. Each round's edges are written out.
    Self links and nulls are ignored; an empty input gives an empty result, which ``release``
    deletes like a table.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct(),
        "edges",
    )
    mark = None
    for _ in range(rounds):
        # the minima are tables of their own, so that a join with them can split a hub's links
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges")
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v")))
        after = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
        for done in (least, large, below):
            release(done)
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        release(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
    out._quillmill_path = now._quillmill_path
    return out
