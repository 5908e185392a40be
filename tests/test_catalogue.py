import oracle
import pytest

from quillmill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, name):
    found = catalogue.QUERIES[name](spark, data).toPandas()
    if name in catalogue.ORACLES:
        assert oracle.rows(found) == oracle.rows(oracle.by_sql(catalogue.ORACLES[name], data))
    else:
        assert len(found)


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_chunk_invariants(spark, data):
    rows = catalogue.packed_chunks(spark, data).toPandas()
    for _, doc in rows.groupby(["module", "source_file"]):
        doc = doc.sort_values("chunk_index")
        assert list(doc.chunk_index) == list(range(len(doc))) and set(doc.total_chunks) == {len(doc)}
        assert list(doc.next_chunk_id[:-1]) == list(doc.id[1:]) and list(doc.prev_chunk_id[1:]) == list(doc.id[:-1])
        assert doc.prev_chunk_id.iloc[0] is None and doc.next_chunk_id.iloc[-1] is None
        assert doc.doc_title.nunique() == doc.file_id.nunique() == 1
    assert rows.token_count.max() <= 550 + 1


def test_streamed_changes_are_cut_once(spark, tmp_path):
    from quillmill.streaming import incremental

    docs = spark.createDataFrame([("m", "a.md", "x"), ("m", "b.md", "y")], "module string, source_file string, content string")
    at = {k: str(tmp_path / k) for k in ("in", "out", "state", "done")}
    for part in (docs, docs.where("source_file = 'a.md'").unionByName(spark.createDataFrame([("m", "c.md", "z")], docs.schema))):
        part.write.mode("append").parquet(at["in"])
        incremental.chunk_changes(spark, at["in"], docs.schema, at["out"], at["state"], done=at["done"])
    assert sorted(r.source_file for r in spark.read.parquet(at["out"]).collect()) == ["a.md", "b.md", "c.md"]
