import hashlib

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions import tokens as K
from quillmill.sources import files, git


def value(spark, expression, *texts):
    frame = spark.createDataFrame([tuple(texts)], ", ".join(f"c{k} string" for k in range(len(texts))))
    return frame.select(expression(*[F.col(f"c{k}") for k in range(len(texts))])).first()[0]


@pytest.mark.parametrize(("text", "slug"), [("GET /users", "get-users"), ("API Endpoints", "api-endpoints"), ("  Hello World  ", "hello-world"), ("a - b", "a---b"), ("Été là", "été-là"), ("", "")])
def test_slug(spark, text, slug):
    assert value(spark, T.slug, text) == slug


@pytest.mark.parametrize(("text", "kebab"), [("API Knowledge Base", "api-knowledge-base"), ("My_Docs", "my-docs"), ("v2_api_specs", "v2-api-specs"), ("  hello--world  ", "hello-world")])
def test_kebab(spark, text, kebab):
    assert value(spark, T.kebab, text) == kebab


@pytest.mark.parametrize(("path", "title"), [("notes.md", "Notes"), ("a/api_reference.md", "Api Reference"), ("kebab-case-doc.md", "Kebab Case Doc"), ("v2api it's.md", "V2Api It'S")])
def test_title_of_path(spark, path, title):
    assert value(spark, T.title_of_path, path) == title


@pytest.mark.parametrize(("text", "orphan"), [
    ("# Title", True), ("## A\n\n### B", True), ("#Not a heading (no space)", False), ("", True), ("  \n ", True), ("# T\n\nbody", False), ("body\n# T", False), ("####### seven", False), ("# A\nb\n# C", False)])
def test_orphan(spark, text, orphan):
    from quillmill.operators import chunk

    assert value(spark, T.is_orphan, text) is orphan
    assert chunk._orphan(text) is orphan


@pytest.mark.parametrize(("text", "has", "language"), [
    ("```python\nx\n```", True, "python"), ("```\nx\n```", True, None), ("```Python title=x\nx\n```", True, "python"), ("```objective-c\nx\n```", True, "objective-c"),
    ("```python\nx\n```\n```sql\ny\n```", True, "python"), ("none", False, None), ("```python\nx", False, None)])
def test_code(spark, text, has, language):
    assert value(spark, T.has_code, text) is has
    assert value(spark, T.code_language, text) == language


def test_file_id_and_cache_key(spark):
    assert value(spark, T.file_id, "content/overview.md") == "539e3e4250da"
    keys = {value(spark, T.cache_key, *t) for t in (("m", "ab", "c"), ("m", "a", "bc"), ("ma", "b", "c"))}
    assert len(keys) == 3
    assert hashlib.sha256(b"m\0ab\0c").hexdigest() in keys


@pytest.mark.parametrize(("text", "body"), [("---\ntags: [a]\n---\n\nx", "x"), ("---\nopen\nx", "---\nopen\nx"), ("x\n---\ny\n---\n", "x\n---\ny\n---\n"), ("", "")])
def test_frontmatter(spark, text, body):
    assert value(spark, T.strip_frontmatter, text) == body


@pytest.mark.parametrize(("text", "shown"), [("", '""'), ("plain", "plain"), ("a: b", '"a: b"'), (' "q" ', '" \\"q\\" "')])
def test_yaml_scalar(spark, text, shown):
    assert value(spark, T.yaml_scalar, text) == shown


@pytest.mark.parametrize("ref", ["https://h.example/o/r.git", "https://h.example/o/r.git#m/x", "https://h.example/o/r.git#m/x@v1", "https://h.example/o/r.git@main", "git@h.example"])
def test_git_reference_in_both_forms(spark, ref):
    assert tuple(value(spark, T.parse_git_ref, ref)) == (git.parse(ref)[0], git.parse(ref)[2], git.parse(ref)[1])


@pytest.mark.parametrize(("dep", "parts"), [("name", ("name", None)), ("name@1.0", ("name", "1.0")), ("na me", None), ("@1", None)])
def test_dependency(spark, dep, parts):
    found = value(spark, T.parse_dependency, dep)
    assert (tuple(found) if found else None) == parts


@pytest.mark.parametrize(("url", "stem"), [("https://x.example/a/b.html?q=1", "b.html"), ("https://x.example/", "x.example"), ("https://x.example/a b/", "a-b"), ("junk", "page")])
def test_url_stem(spark, url, stem):
    assert value(spark, T.url_stem, url) == stem


def test_paths(spark):
    paths = ["a/b.MD", "a/.git/x.md", "a/_x/y.md", "a/~$k.docx", "Thumbs.db", "x.tmp", "x~", "d/e.boxnote", "noext", "l.PPT"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.is_hidden("p").alias("h"), files.is_temporary("p").alias("t"), files.classify("p").alias("c"), files.flat_name("p").alias("f")).collect()
    got = {r["p"]: r for r in rows}
    assert [p for p in paths if got[p]["h"]] == ["a/.git/x.md", "a/_x/y.md"]
    assert [p for p in paths if got[p]["t"]] == ["a/~$k.docx", "Thumbs.db", "x.tmp", "x~"]
    assert got["a/b.MD"]["c"] == "markdown" and got["d/e.boxnote"]["c"] == "boxnote" and got["noext"]["c"] == got["l.PPT"]["c"] == "unsupported"
    assert got["d/e.boxnote"]["f"] == "d__e.md" and got["noext"]["f"] == "noext.md"


def test_windows():
    words = " ".join(map(str, range(1200)))
    cut = K.windows(words, 500, 450)
    assert [len(c.split()) for c in cut] == [500, 500, 300]
    assert cut[1].split()[0] == "450" and cut[2].split()[-1] == "1199"
    assert K.windows("a b", 500, 450) == ["a b"]
    assert "".join(K.PIECE.findall(" a\n b  ")) == " a\n b  "


def test_bpe_round_trip():
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    text = "Überall <|endoftext|> tokens, everywhere."
    assert "".join(K.windows("plain words only", 2, 2, path)) == "plain words only"
    assert K.windows(text, 1000, 900, path) == [text]
    assert K.counter(path)(text) > 5
