import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.operators import chunk, fold, infer, retrieve, segment, state


def plain_fold(sizes, limit, overlap):
    """The rule item by item."""
    out, current, total = [], [], 0
    for k, n in enumerate(sizes):
        if total + n > limit and current:
            out.append((current[0], current[-1] + 1))
            kept, kept_total = [], 0
            for i in reversed(current):
                if kept_total + sizes[i] > overlap:
                    break
                kept.insert(0, i)
                kept_total += sizes[i]
            current, total = kept, kept_total
        current.append(k)
        total += n
    return out + ([(current[0], current[-1] + 1)] if current else [])


@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 60), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_ranges_follow_the_rule(sizes, limit, overlap):
    assert list(fold.ranges(sizes, limit, overlap)) == plain_fold(sizes, limit, overlap)


def test_golden_groups(spark):
    assert list(fold.ranges([60, 30, 20, 100], 100, 50)) == [(0, 2), (1, 3), (1, 4)]
    frame = spark.createDataFrame([([3, 4, 5, 2, 9],), ([],)], "s array<int>")
    assert [r[0] for r in frame.select(fold.group_numbers(F.col("s"), 7)).collect()] == [[0, 0, 1, 1, 2], []]
    assert [r[0] for r in frame.select(fold.group_sums(F.col("s"), 7)).collect()] == [[7, 7, 9], []]


def chunks_of(spark, text, strategy, name="content/a.md", **options):
    docs = spark.createDataFrame([("m", name, text, strategy)], "module string, source_file string, content string, strategy string")
    return sorted(chunk.chunk(docs, **options).collect(), key=lambda r: r.metadata.chunk_index)


def words(n, start=0):
    return " ".join(f"w{k}" for k in range(start, start + n))


def test_heading_chunks(spark):
    text = "# Title\n\nintro\n\n## Set up\n\nbody\n\n```bash\nx\n```\n\n## Use it\n\nmore"
    found = chunks_of(spark, text, "heading", "content/overview.md")
    assert [r.id for r in found] == ["m/overview", "m/overview/set-up", "m/overview/use-it"]
    assert [r.section_path for r in found] == [[], ["Set up"], ["Use it"]]
    assert [r.metadata.heading_level for r in found] == [0, 1, 1]
    assert {r.metadata.doc_title for r in found} == {"Title"}
    assert [(r.metadata.has_code, r.metadata.language) for r in found] == [(False, None), (True, "bash"), (False, None)]
    assert [(r.metadata.prev_chunk_id, r.metadata.next_chunk_id) for r in found] == [(None, found[1].id), (found[0].id, found[2].id), (found[1].id, None)]
    assert {r.metadata.total_chunks for r in found} == {3}


def test_headings_alone_give_nothing_and_orphans_go(spark):
    assert chunks_of(spark, "# Title\n\n## A\n\n## B\n", "heading") == []
    assert len(chunks_of(spark, "# Title\n\n## A\n\nx\n\n## B\n\ny", "heading")) == 2


def test_long_sections_are_cut_one_level_down_then_by_budget(spark):
    text = f"## Parent\n\n### S1\n\n{words(300)}\n\n### S2\n\n{words(300)}"
    found = chunks_of(spark, text, "heading")
    assert [r.section_path for r in found] == [["Parent", "S1"], ["Parent", "S2"]]
    assert [r.metadata.parent_section for r in found] == ["Parent", "Parent"]
    found = chunks_of(spark, f"## P\n\n{words(1200)}", "heading")
    assert [r.id for r in found] == [f"m/a/p/{k}" for k in range(4)]
    assert all(r.metadata.heading_level is None and r.metadata.parent_section == "P" for r in found)


def test_budget(spark):
    assert chunks_of(spark, "", "fixed") == []
    found = chunks_of(spark, "# H1\n\none", "fixed", "content/overview.md")
    assert [(r.id, r.metadata.doc_title) for r in found] == [("m/overview/0", "Overview")]
    for text in ("\n".join(words(60, k) for k in range(20)), " ".join(words(60, k) + "." for k in range(15)), words(3000)):
        found = chunks_of(spark, text, "fixed")
        assert len(found) > 1 and max(r.metadata.token_count for r in found) <= 550


def test_definitions(spark):
    text = "# T\n\nintro\n\n### A\n\none\n\n### B\n\ntwo"
    found = chunks_of(spark, text, "definition")
    assert [(r.id, r.section_path, r.content) for r in found] == [("m/a/a", ["A"], "### A\n\none\n\n### B\n\ntwo")]
    found = chunks_of(spark, "x\n**Foo**: one\nmore\n**Bar** — two", "definition", limit=3)
    assert [(r.section_path, r.content) for r in found] == [(["Foo"], "**Foo**: one\nmore"), (["Bar"], "**Bar** — two")]
    assert [r.id for r in chunks_of(spark, "nothing here", "definition")] == ["m/a/0"]


def test_failures_stay_with_their_document(spark):
    def broken(cutter, text):
        raise ValueError("no")

    chunk.register("broken", broken)
    docs = spark.createDataFrame([("m", "a.md", "x", "broken"), ("m", "b.md", "y", None)], "module string, source_file string, content string, strategy string")
    rows = chunk.chunk(docs, keep_errors=True).collect()
    assert sorted((r.source_file, r.error) for r in rows) == [("a.md", "ValueError: no"), ("b.md", None)]


@pytest.mark.parametrize(("h2", "h34", "bold", "want"), [(0, 0, 3, "definition"), (4, 0, 3, "heading"), (1, 6, 0, "definition"), (3, 4, 0, "heading"), (1, 0, 0, "fixed"), (0, 0, 0, "fixed")])
def test_strategy(spark, h2, h34, bold, want):
    text = words(600) + "\n" + "\n".join(["## h"] * h2 + ["### h"] * h34 + ["**b**: x"] * bold)
    frame = spark.createDataFrame([(text,), ("## a\n## b",)], "t string")
    assert [r[0] for r in frame.select(infer.strategy_of("t")).collect()] == [want, "fixed"]


def test_inference(spark):
    docs = spark.createDataFrame([
        (0, "# 0f0e0d0c-0000-1111-2222-333344445555\n**Alpha beta**", "fixed"), (1, "# Remote Playbook\n## alpha beta gamma\n#### delta", "heading"), (2, "## gamma delta the", "heading"), (3, "x", "fixed")],
        "file_ord int, content string, strategy string")
    assert infer.description(docs, "d").first()[0] == "Remote Playbook"
    assert infer.description(docs.where("file_ord in (0, 3)"), "d").first()[0] == "d"
    assert infer.tags(docs) == ["alpha", "beta", "gamma"]
    assert infer.tags(docs.where("file_ord = 3")) == [] and infer.tags(docs, override=" a, ,b") == ["a", "b"]
    assert infer.majority_strategy(docs).first()[0] == "fixed"
    assert sorted(r.file_ord for r in infer.overrides(docs).collect()) == [1, 2]
    assert infer.majority_strategy(docs.limit(0)).first()[0] == "heading"


def test_state(spark):
    files = spark.createDataFrame([("a", "x/b.md", "1"), ("a", "x/a.md", "2"), ("b", "y", "3")], "module string, rel_path string, content string")
    one = {r.module: r.source_hash for r in state.module_hashes(files).collect()}
    assert one == {r.module: r.source_hash for r in state.module_hashes(files.repartition(3)).collect()}
    meta = spark.createDataFrame([("a", one["a"], "t", 1), ("b", "old", "t", 1)], "module string, source_hash string, built_at string, chunk_count long")
    assert [r.module for r in state.stale(state.module_hashes(files), meta).collect()] == ["b"]
    built = spark.createDataFrame([("b", one["b"], 5)], "module string, source_hash string, chunk_count int")
    assert {(r.module, r.source_hash, r.chunk_count) for r in state.record(meta, built).collect()} == {("a", one["a"], 1), ("b", one["b"], 5)}


def test_contexts(spark):
    chunks = spark.createDataFrame([("d", "one"), ("d", "two")], "document string, content string")
    empty = spark.createDataFrame([], "key string, context string, model string")
    out, new = state.contextualize(chunks, empty, "m", lambda d, c: f"{d}:{c}")
    assert sorted(r.content for r in out.collect()) == ["d:one\n\none", "d:two\n\ntwo"]
    kept = spark.createDataFrame(new.collect(), new.schema)
    out, new = state.contextualize(chunks, kept, "m")
    assert new.count() == 0 and all(r.contextualized and r.token_count == 2 for r in out.collect())


def test_retrieval(spark):
    rows = spark.createDataFrame([("m", 1, "a TION"), ("m", 2, "tion"), ("n", 3, "x")], "module string, id int, content string")
    assert [r.id for r in retrieve.search(rows, "Tion", order=["id"]).collect()] == [1, 2]
    assert [r.id for r in retrieve.search(rows, "x", order=["id"], module="m").collect()] == []
    assert [r.around for r in retrieve.neighbours(rows, ["module"], "id").orderBy("id").collect()] == ["a TION\n\ntion", "a TION\n\ntion", "x"]
    new = rows.where("id > 1").withColumn("content", F.when(F.col("id") == 2, "changed").otherwise(F.col("content"))).unionByName(rows.where("id = 1").withColumn("id", F.lit(9)))
    assert {(r.id, r.change) for r in retrieve.changes(rows, new).collect()} == {(1, "removed"), (2, "changed"), (9, "added")}


def test_native_splits_agree_with_the_cutter(spark):
    text = "# T\n\nintro\n## A\nx\n## B\n\n### C\ny"
    frame = spark.createDataFrame([(text,), ("none",), ("",)], "text string")
    got = [(r.text, r.heading, r.content) for r in segment.heading_sections(frame).orderBy("text", "ord").collect()]
    cut = chunk.Cutter(10, 0)
    assert sorted(map(str, got)) == sorted(str((t, p[0] if p else None, c)) for t in (text, "none", "") for p, c in cut._sections(t, 2))
