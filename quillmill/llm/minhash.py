"""Near-duplicate documents by weighted Jaccard similarity of their word shingles.

Signatures follow BagMinHash (Ertl, KDD 2018). The weight of a shingle is how often it
occurs; weights are discretised at the whole numbers. Each shingle owns one Poisson
process per dyadic root interval (0,1], (1,2], (2,4], ... of weight, of a rate equal to
its length. A point carries a time and one of the signature's components. In a root that
lies within the weight every point counts; in the one that the weight cuts a point goes
down into halves, drawn one after the other, until its half lies within the weight or
beyond it. Component j of the signature is the smallest time among the points that count,
so two documents agree there with probability equal to their weighted Jaccard similarity,
whatever else they hold. Points are drawn in time order, and no more of a document's once
they are later than the largest component of its signature. A horizon bounds the first
draws; documents with components unset by then get one twice as far, so neither of the two
stops ever changes a signature.

Signatures are cut into bands. Documents with the same words are first collapsed into one
representative. Representatives that share a band are compared, whatever the size of the
cluster they are in; others never count as linked. Clusters of candidates of at most
``block`` documents are compared in tasks of many clusters, which hold about as many
documents or half a block's characters. In larger ones, round after
round, a document that is not of its bucket's main class is compared with a member of
that class, in one bucket a round, until a round links few. A class needs no comparison
within itself: all others of a cluster are compared with each other and with its main
class in tiles of two blocks, bucket by bucket or over the whole cluster, whichever sends
fewer texts. So a large tight group costs about as much as its size, neither it nor a hot
bucket meets in one task, and no pair is emitted that fails: a tile returns a spanning
forest of its verified links. The verified overlap is exact, over multisets of 64-bit
shingle hashes. Classes are connected components of the links.

Defined cases: a null or empty text, or one of white space only, has no shingle and is its
own class; a text of fewer than ``width`` words is one shingle of all of them, and one of
any length counts whole; repeated rows of one id are one document, of several texts under
one id the one of the smallest fingerprint; a null id is dropped from comparison and keeps
itself; ties do not arise, a class is named by its smallest id; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, give_back, materialize, mix64, portions, release, shingle_hashes, uniform

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 6


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of characters between white space."""
    return text.lower().split() if text else []


def hashed_shingles(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, how many each has, and two hashes of each text's words."""
    import xxhash

    split = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    words = np.fromiter((h for ws in split for h in map(xxhash.xxh3_64_intdigest, ws)), dtype=np.uint64, count=int(counts.sum()))
    starts = np.cumsum(counts) - counts
    shingles, per = shingle_hashes(words, starts, counts, width)
    prints = [xxhash.xxh3_128_digest("\x1f".join(ws)) for ws in split]
    both = np.frombuffer(b"".join(prints), dtype=np.int64).reshape(-1, 2) if prints else np.zeros((0, 2), dtype=np.int64)
    return shingles, per, both[:, 0], both[:, 1]


def units(shingles: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: owner, hash, weight."""
    order = np.lexsort((shingles, owner))
    s, o = shingles[order], owner[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], s[at], np.diff(np.append(at, len(s)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures, a row of ``size`` times for each document; rows without shingles are infinite."""
    out = np.full(docs * size, np.inf)
    total = np.bincount(owner, weights=weight, minlength=docs)
    procs = [(owner, shingle, np.zeros(len(owner)), np.ones(len(owner)))]  # root (0, 1]
    low = 1.0
    more = weight > 1
    while more.any():  # roots (low, 2 low]
        o, s, w = owner[more], shingle[more], weight[more]
        with np.errstate(over="ignore"):
            procs.append((o, mix64(s + np.uint64(int(low) * 0x9E3779B97F4A7C15 & (2**64 - 1))), np.full(len(o), low), w.astype(np.float64)))
        low *= 2
        more = weight > low
    own, seed, lo, wt = (np.concatenate(x) for x in zip(*procs, strict=True))
    length = np.maximum(lo, 1.0).astype(np.int64)  # the root's length is its lower end, but for the first
    within = np.minimum(wt - lo, length).astype(np.int64)  # whole units of the root within the weight
    horizon = np.zeros(docs)
    has = total > 0
    horizon[has] = size * (np.log(size) + 3.0) / total[has]
    todo = has
    while todo.any():
        _points(own, seed, length, within, todo, horizon, size, out)
        unset = np.isinf(out.reshape(docs, size)).any(axis=1) & has
        horizon[unset] *= 2
        todo = unset
    return out.reshape(docs, size)


def descend(bits: np.ndarray, length: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Whether points of cut roots lie within the weight: half by half, by one bit each."""
    counts = np.zeros(len(bits), bool)
    open_ = np.arange(len(bits))
    low, half = np.zeros(len(bits), np.int64), length.astype(np.int64)
    level = 0
    while len(open_):
        inside = low[open_] + half[open_] <= within[open_]
        counts[open_[inside]] = True
        open_ = open_[~inside & (low[open_] < within[open_])]
        half[open_] >>= 1
        upper = (bits[open_] >> np.uint64(63 - level)) & np.uint64(1)
        low[open_] += np.where(upper == 1, half[open_], 0)
        level += 1
    return counts


def _points(own, seed, length, within, todo, horizon, size, out) -> None:
    alive = np.flatnonzero(todo[own])
    o, s, rate, part, end = own[alive], seed[alive], length[alive], within[alive], horizon[own[alive]]
    t = np.zeros(len(o))
    step = 0
    with np.errstate(over="ignore"):
        while len(o):
            step += 1
            h = mix64(s + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
            t = t - np.log(uniform(h)) / rate
            if step % 8 == 0:  # no later point can lower a component
                end = np.minimum(end, out.reshape(-1, size).max(axis=1)[o])
            keep = t <= end
            if not keep.all():
                o, s, rate, part, end, t, h = o[keep], s[keep], rate[keep], part[keep], end[keep], t[keep], h[keep]
            g = mix64(h ^ np.uint64(0x2545F4914F6CDD1D))
            component = (g % np.uint64(size)).astype(np.int64)
            cut = np.flatnonzero(part < rate)
            if len(cut):
                counts = np.ones(len(o), bool)
                counts[cut] = descend(mix64(g[cut] + np.uint64(1)), rate[cut], part[cut])
                np.minimum.at(out, o[counts] * size + component[counts], t[counts])
            else:
                np.minimum.at(out, o * size + component, t)


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), bands)).copy()
        for k in range(rows):
            h = mix64(h * np.uint64(31) + bits[:, :, k])
    return h.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, *, width: int, bands: int, rows: int) -> DataFrame:
    """id, two fingerprint halves of the words, number of shingles, characters, band keys."""
    schema = "id long, fp1 long, fp2 long, shingles long, chars long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in portions(batch, 1, 2_000_000):
                sh, per, fp1, fp2 = hashed_shingles(part, width)
                own, s, w = units(sh, np.repeat(np.arange(len(part)), per))
                keys = _bands(signatures(own, s, w, len(part), bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(fp1), pa.array(fp2), pa.array(per), pa.array([len(t) for t in part], pa.int64()), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["id", "fp1", "fp2", "shingles", "chars", "keys"],
                )
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null").mapInArrow(run, schema)


def overlaps(sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, dense: int = 24) -> np.ndarray:
    """Multiset overlaps of each document of ``left`` with each of ``right``.

    sets: hashes and weights of each document's distinct shingles. Shingles in few of the
    documents are joined through their postings, the others by products of 0/1 matrices
    of bounded width, one column for each occurrence.
    """
    rows = np.full(len(sets), -1)
    rows[left] = np.arange(len(left))
    cols = np.full(len(sets), -1)
    cols[right] = np.arange(len(right))
    out = np.zeros((len(left), len(right)))
    who = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    h = np.concatenate([h for h, _ in sets]) if sets else np.zeros(0, np.uint64)
    w = np.concatenate([w for _, w in sets]) if sets else np.zeros(0, np.int64)
    if len(h) and w.max() > 1:  # k-th occurrence as a unit of its own
        times = np.repeat(np.arange(len(h)), w)
        nth = np.arange(len(times)) - np.repeat(np.cumsum(w) - w, w)
        with np.errstate(over="ignore"):
            h, who = mix64(h[times] + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), who[times]
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(h)))
    for size in np.unique(n[(n > 1) & (n <= dense)]):
        post = who[new[n == size][:, None] + np.arange(size)]
        for i in range(size):
            for j in range(size):
                a, b = rows[post[:, i]], cols[post[:, j]]
                ok = (a >= 0) & (b >= 0)
                if ok.any():
                    out += np.bincount(a[ok] * len(right) + b[ok], minlength=out.size).reshape(out.shape)
    many = np.flatnonzero(n > dense)
    for at in range(0, len(many), 4096):
        some = many[at : at + 4096]
        take = np.repeat(new[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(n[some].sum())
        column, doc = np.repeat(np.arange(len(some)), n[some]), who[take]
        a, b = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
        ok = rows[doc] >= 0
        a[rows[doc[ok]], column[ok]] = 1
        ok = cols[doc] >= 0
        b[cols[doc[ok]], column[ok]] = 1
        out += a @ b.T
    return out


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links i-j."""
    top = list(range(n))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            top[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _tile(width: int, threshold: float):
    """Verified links of clusters: those of a task of many, or of two blocks of one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sh, per, fp1, fp2 = hashed_shingles(pdf["text"].tolist(), width)
        own, s, w = units(sh, np.repeat(np.arange(len(pdf)), per))
        cut = np.searchsorted(own, np.arange(len(pdf) + 1))
        # of several texts under one id, the one that was sketched
        meant = pdf[(fp1 == pdf["fp1"]) & (fp2 == pdf["fp2"])].assign(at=lambda d: d.index.map({k: n for n, k in enumerate(pdf.index)})).drop_duplicates(["c", "id"])
        found: list[tuple[int, int, int]] = []
        for c, part in meant.groupby("c", sort=False):
            at, side = part["at"].to_numpy(), part["block"].to_numpy()
            ids, keys = part["id"].to_numpy(), np.stack(part["keys"].to_numpy())
            sets, n = [(s[cut[k] : cut[k + 1]], w[cut[k] : cut[k + 1]]) for k in at], per[at]
            across = side.min() != side.max()
            left = np.flatnonzero(side == side.min())
            right = np.flatnonzero(side != side.min()) if across else left
            both = overlaps(sets, left, right)
            # o / (p + q - o) >= threshold, without division
            sim = both * (1 + threshold) >= threshold * (n[left][:, None] + n[right][None, :]) - 1e-9
            i, j = np.nonzero(sim & (both > 0))
            i, j = left[i], right[j]
            ok = np.ones(len(i), bool) if across else i < j
            i, j = i[ok], j[ok]
            shared = (keys[i] == keys[j]).any(axis=1)  # in a small cluster not all pairs share a band
            found += [(c, ids[a], ids[b]) for a, b in _forest(i[shared], j[shared], len(ids))]
        return pd.DataFrame(found, columns=["c", "a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, block: int = 256, block_chars: int = 4_000_000) -> DataFrame:
    """Class of each document: (id, class_id, representative), one row per id.

    class_id is the smallest id of the class, and representative the smallest id among
    documents with the same words. Classes are connected by verified links of weighted
    Jaccard similarity of at least ``threshold``. With 24 bands of 6 a pair at 0.8 shares
    a band with probability 0.9993, one at 0.85 with 0.99999. block, block_chars: most
    documents and characters of a block of a large cluster; classes do not depend on them.
    """
    every = sketch(docs, id_col, text_col, width=width, bands=bands, rows=rows)
    # one sketch for each id; of several texts under one id, one is taken
    sk = materialize(every.groupBy("id").agg(F.min(F.struct("fp1", "fp2", "shingles", "chars", "keys")).alias("s")).select("id", "s.*"), "sketch")
    whole = sk.where("shingles > 0")
    exact = materialize(whole.groupBy("fp1", "fp2").agg(F.min("id").alias("rep")), "exact")  # a table of its own, so that the joins can split a hot text
    member = whole.select("id", "fp1", "fp2").join(exact, ["fp1", "fp2"]).select("id", "rep")
    reps = whole.join(exact, ["fp1", "fp2"]).where("id = rep").drop("rep", "shingles")
    keyed = materialize(reps.select("id", "chars", F.explode("keys").alias("key")), "bands")
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("mix")).where("n > 1")
    bucket = materialize(keyed.join(shared, "key"), "buckets")
    linked = connected_components(bucket.select(F.col("id").alias("a"), F.col("least").alias("b")).where("a != b"))
    cluster = materialize(linked.withColumnRenamed("component", "c"), "clusters")
    sizes = materialize(cluster.join(bucket.select("id", "chars").dropDuplicates(["id"]), "id").groupBy("c").agg(F.count("*").alias("size"), F.sum("chars").alias("size_chars")), "sizes")
    fits = (F.col("size") <= block) & (F.col("size_chars") <= block_chars)
    placed = reps.join(cluster.join(sizes, "c").select("id", "c", fits.alias("fits")), "id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = materialize(texts.join(placed, "id"), "texts")  # of candidates only
    done = [linked, exact, keyed, bucket, cluster, sizes, texts]
    zero = F.lit(0)

    def compared(rows: DataFrame, name: str) -> DataFrame:
        """rows: c, i and j, which name a tile, block, chars, own (whether it is a task of its own), and what a tile reads."""
        several, n = rows.where(~F.col("own")).agg(F.coalesce(F.sum("chars"), zero), F.count("*")).first()
        task = F.when(F.col("own"), F.col("c")).otherwise(F.pmod(F.xxhash64("c"), F.lit(max(1, several // (block_chars // 2), n // block))))
        if "text" not in rows.columns:
            rows = rows.drop("chars").join(texts.where(~F.col("fits")).drop("c", "chars"), "id")
        links = rows.withColumn("g", task).groupBy("own", "g", "i", "j").applyInPandas(_tile(width, threshold), "c long, a long, b long")
        done.append(materialize(links, name))
        return done[-1]

    links = compared(texts.where("fits").withColumns({"own": F.lit(False), "i": zero, "j": zero, "block": zero}), "links")
    # large clusters: a bucket with the same members as another is compared once
    split = bucket.join(texts.where(~F.col("fits")).select("id", F.col("c").alias("cluster")).distinct(), "id")
    once = split.groupBy("least", "n", "mix").agg(F.min("key").alias("key"))
    members = materialize(split.join(once.select("key"), "key").select("id", F.col("key").alias("c"), "cluster", "chars", "n"), "members")
    done.append(members)
    if not members.isEmpty():
        labelled, stars = _stars(members, compared, done, block, block_chars)
        tiles = _tiles(labelled.drop("shared"), block, block_chars)
        links = links.unionByName(stars).unionByName(compared(tiles, "tiles"))
    classes = connected_components(links.select("a", "b"))
    labelled = member.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("representative"))
    alone = sk.where("shingles = 0").select("id", F.col("id").alias("class_id"), F.col("id").alias("representative")).distinct()
    out = materialize(labelled.unionByName(alone), "classes")
    for part in (*done, sk, classes):
        release(part)
    return out


def _blocks(n: str, chars: str, block: int, block_chars: int) -> Column:
    """Blocks for so many documents and characters."""
    return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(chars) / block_chars)).cast("int")


def _stars(members: DataFrame, compared, done: list, block: int, block_chars: int, few: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Members with labels such that equal ones are one class, and the links that make them so.

    Each round compares a document that has not its bucket's commonest label with a member
    that has, in the largest bucket where that is so: at first the one that shares most
    buckets with most others, then one by a hash.
    """
    # a text that others derive from shares more with them than they do with each other
    at = members.select("id", "c", "cluster", "chars", F.sum("n").over(Window.partitionBy("id")).alias("shared"), F.col("id").alias("label"))
    at = materialize(at, "labelled")
    stars, turn = None, 0
    while True:
        turn += 1
        rank = F.struct("shared", -F.col("id")) if turn == 1 else F.struct(F.xxhash64("id", F.lit(turn)), "id")
        counts = at.groupBy("c", "label").agg(F.count("*").alias("n"), F.max_by("id", rank).alias("hub"), F.max("shared").alias("shared"))
        main = counts.groupBy("c").agg(F.max_by(F.struct("label", "hub"), F.struct("n", "shared", -F.col("label"))).alias("m"), F.sum("n").alias("members")).select("c", "m.*", "members")
        main = materialize(main.withColumnRenamed("label", "main"), "main")
        rays = at.join(main, "c").where("label != main").groupBy("id", "chars").agg(F.max(F.struct("members", "c", "hub", "main")).alias("m")).select("id", "chars", "m.c", "m.hub", "m.main")
        rays = materialize(rays, "rays")
        n = rays.count()
        done += [main, rays]
        if not n:
            break
        parts = materialize(rays.groupBy("c", "hub").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars")).select("c", "hub", "all_chars", _blocks("n", "all_chars", block, block_chars).alias("parts")), "parts")
        done.append(parts)
        own = (F.col("parts") > 1).alias("own")
        others = rays.join(parts, ["c", "hub"]).select("id", "c", "chars", own, F.expr("cast(pmod(xxhash64(id), parts) as int)").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("block"))
        hubs = parts.select(F.col("hub").alias("id"), "c", F.lit(0).cast("long").alias("chars"), own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"))
        star = compared(others.unionByName(hubs), "star")
        stars = star if stars is None else stars.unionByName(star)
        caught = star.join(rays.select("c", "id", "main"), (star["c"] == rays["c"]) & (star["b"] == rays["id"])).select("id", "main")
        now = at.join(caught.withColumnRenamed("main", "now"), "id", "left").withColumn("label", F.coalesce("now", "label")).drop("now")
        done.append(at)
        at = materialize(now, "labelled")
        if star.count() < few * n:
            break
    done.append(at)
    return at, stars if stars is not None else members.sparkSession.createDataFrame([], "c long, a long, b long")


def _tiles(labelled: DataFrame, block: int, block_chars: int) -> DataFrame:
    """Tiles of every bucket, or of every cluster where that sends fewer texts, of those not all of one label."""

    def cut(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("c", "label").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        best = F.max(F.struct("n", "chars", "label")).alias("m")
        both = counts.groupBy("c").agg(best, F.sum("n").alias("all_n"), F.sum("chars").alias("all_chars")).where("m.n < all_n")
        both = both.select("c", F.col("m.label").alias("main"), F.col("m.n").alias("nc"), F.col("m.chars").alias("cc"), (F.col("all_n") - F.col("m.n")).alias("nr"), (F.col("all_chars") - F.col("m.chars")).alias("cr"), "all_n", "all_chars")
        both = both.withColumns({"bc": _blocks("nc", "cc", block, block_chars), "br": _blocks("nr", "cr", block, block_chars), "own": (F.col("all_n") > block) | (F.col("all_chars") > block_chars)})
        return both.withColumn("sent", F.when(F.col("own"), F.expr("nc * br + nr * (bc + br)")).otherwise(F.col("all_n")))

    buckets, clusters = cut(labelled), cut(labelled.select("id", F.col("cluster").alias("c"), "label", "chars").distinct())
    of = labelled.select("c", "cluster").distinct()
    cost = buckets.join(of, "c").groupBy("cluster").agg(F.sum("sent").alias("by_bucket"))
    whole = clusters.join(cost.withColumnRenamed("cluster", "c"), "c")
    keys = [k for k in clusters.columns if k != "c"]
    way = materialize(
        whole.where("sent <= by_bucket").select("c", F.col("c").alias("cluster"), *keys, F.lit(True).alias("one"))
        .unionByName(buckets.join(of, "c").join(whole.where("sent > by_bucket").select(F.col("c").alias("cluster")), "cluster").select("c", "cluster", *keys, F.lit(False).alias("one"))), "way")
    rows = labelled.join(way.where("not one").drop("cluster", "one"), "c").drop("cluster")
    rows = rows.unionByName(labelled.select("id", F.col("cluster").alias("c"), "label", "chars").distinct().join(way.where("one").drop("cluster", "one"), "c"))
    rows = rows.withColumn("core", F.col("label") == F.col("main"))
    rows = rows.withColumn("block", F.expr("if(own, if(core, cast(pmod(xxhash64(id), bc) as int), bc + cast(pmod(xxhash64(id), br) as int)), 0)"))
    rows = rows.withColumn("other", F.expr("explode(if(own, sequence(if(core, bc, 0), bc + br - 1), array(0)))"))
    return rows.select("id", "c", "chars", "own", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but the smallest id of each class; of repeated rows of an id one
    stays. Rows without an id stay. Only the ids to remove are joined, not those to keep."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = materialize(found.where("id != class_id").select(F.col("id").alias(id_col)), "gone")
    release(found)
    again = materialize(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "again")
    left = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    once = left.join(again, id_col, "left_anti").select(*docs.columns)
    return once.unionByName(left.join(again, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col]))
