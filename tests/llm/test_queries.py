"""The ten queries and the pipeline against SQL, brute force, round trips and held-out labels."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from quillmill.llm import queries as Q

NAMES = {**Q.queries()}
SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def results(spark, data):
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = NAMES[name](spark, data).toPandas()
        return kept[name]

    return of


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(results, data, name):
    assert oracle.rows(results(name)) == oracle.rows(oracle.by_sql(SQL[name], data))


def packed_whole(rows, texts):
    """Each text's ids are cut into pieces without gap or overlap; sequences have none either."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(Q.tokenizer_path()).encode
    for doc, pieces in rows.groupby("doc_id"):
        ids = np.array([*encode(texts[doc] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for p in pieces.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    lengths = rows.groupby("sequence_id").length.sum()
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == list(np.cumsum(s.length) - s.length)
    assert lengths.max() <= 4096
    padded = lengths[(lengths & (lengths - 1)) != 0]
    assert (4096 - padded).sum() <= 0.02 * lengths.sum()
    assert (rows.groupby("sequence_id").tier.first() == lengths).all()


def test_packing_round_trip(results, documents):
    rows = results("op1_packing")
    assert set(rows.doc_id) == set(documents.index)
    packed_whole(rows, documents.text)
    tokens = rows.groupby(["tier", "step_group"]).length.sum()
    assert (tokens <= 65536).all()


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts, threshold=0.8):
    bags = {d: shingles(t) for d, t in texts.items()}
    sizes = {d: sum(b.values()) for d, b in bags.items()}
    held = defaultdict(list)
    for d, b in bags.items():
        for s, n in b.items():
            held[s].append((d, n))
    both = Counter()
    for post in held.values():
        for i, (a, n) in enumerate(post):
            for b, m in post[:i]:
                both[min(a, b), max(a, b)] += min(n, m)
    top = {d: d for d in texts}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), o in both.items():
        if o >= threshold * (sizes[a] + sizes[b] - o):
            ra, rb = root(a), root(b)
            top[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in texts}


def test_near_duplicates_by_brute_force(results, documents):
    rows = results("op2_bagminhash").set_index("doc_id")
    assert rows.class_id.to_dict() == brute_classes(documents.text.to_dict())


def test_toxicity_held_out(results, spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id").toxic
    rows = results("op7_toxicity_crf").set_index("doc_id")
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in rows.held_out.items())
    held = rows[rows.held_out].join(labels, how="inner")
    assert (held.predicted == held.toxic).mean() >= 0.85


def test_language_held_out(results, documents):
    rows = results("op8_word_backoff").set_index("doc_id").join(documents.lang)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in rows.held_out.items())
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.97


def test_pipeline_stage_by_stage(spark, data):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before, out = docs.toPandas(), stage(spark, docs, data)
        if name != "packing":
            assert out.columns == docs.columns
        after = out.toPandas()
        seen[name] = (before, after)
        docs = spark.createDataFrame(after, out.schema)
    before, after = seen["toxicity"]
    assert len(before) * 0.7 < len(after) < len(before)
    before, after = seen["near_duplicates"]
    classes = brute_classes(before.set_index("doc_id").text.to_dict())
    assert sorted(after.doc_id) == sorted(set(classes.values()))
    before, after = seen["personal_data"]
    assert sorted(after.doc_id) == sorted(before.doc_id) and not after.text.str.contains(r"[a-z0-9]@[a-z0-9]+\.[a-z]").any()
    before, after = seen["mixing"]
    tokens = before.text.str.split().str.len().sum()
    assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique and 0.3 * tokens < after.text.str.split().str.len().sum() <= 0.9 * tokens
    before, after = seen["packing"]
    packed_whole(after, before.set_index("doc_id").text)
