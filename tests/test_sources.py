import io
import json
import zipfile

import pytest

from quillmill import cli
from quillmill.plans import modules
from quillmill.sources import files, git, manifest, render, wiring


def note(*nodes):
    return json.dumps({"doc": {"type": "doc", "content": list(nodes)}}).encode()


def text(t, *marks):
    return {"type": "text", "text": t, "marks": [{"type": m} for m in marks]}


def para(*inline):
    return {"type": "paragraph", "content": list(inline)}


def test_box_notes():
    assert render.box_note("empty.boxnote", note()) == "# empty\n"
    shown = render.box_note("n.boxnote", note({"type": "heading", "attrs": {"level": 1}, "content": [text("H")]}, {"type": "heading", "content": []}, para(text("b", "bold"), text("i", "italic"), text("c", "code"), text("x", "author_id"))))
    assert shown == "# n\n\n\n## H\n**b***i*`c`x\n"
    item = {"type": "list_item", "content": [para(text("x")), {"type": "bullet_list", "content": [{"type": "list_item", "content": [para(text("y"))]}]}]}
    assert render.box_note("n", note({"type": "ordered_list", "content": [item]})).endswith("1. x\n  - y\n")
    assert "inside" in render.box_note("n", note({"type": "odd", "content": [para(text("inside"))]}))
    with pytest.raises(ValueError):
        render.box_note("n", b"{")


def test_html():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><h1>Head</h1><p>a <b>bold</b> <a href='/x'>link</a><br>next<ul><li>one<li>two</ul><pre>c  d</pre></body>"
    shown = render.page(page)
    assert "# Head" in shown and "**bold**" in shown and "[link](/x)" in shown and "* one\n* two" in shown and "c  d" in shown
    assert "menu" not in shown and "p{}" not in shown and "menu" in render.html(page)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files():
    slide = '<p xmlns:a="urn:a"><sp><nvPr><ph type="title"/></nvPr><a:p><a:r><a:t>Hello</a:t></a:r></a:p></sp><sp><a:p><a:r><a:rPr b="1"/><a:t>Bold</a:t></a:r></a:p><a:p><a:r><a:t>Plain</a:t></a:r></a:p></sp></p>'
    shown = render.slides("s.pptx", zipped({"ppt/slides/slide1.xml": slide}))
    assert shown == "# s\n\n\n## Slide 1\n\n### Hello\n\n**Bold**\n- Plain\n"
    doc = '<d xmlns:w="urn:w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Some longer text</w:t></w:r></w:p></w:body></d>'
    assert render.word_document("d.docx", zipped({"word/document.xml": doc})) == "## Top\n\nSome longer text"


def folder(at):
    (at / "sub").mkdir(parents=True)
    (at / ".git").mkdir()
    (at / ".git" / "x.md").write_text("no")
    (at / "overview.md").write_text("---\ntags: [a]\n---\n# Overview\n\ntext\n\n## Authentication\n\ntext")
    (at / "glossary.md").write_text("**Term**: text\n**Other**: text")
    (at / "notes.txt").write_text("one sentence")
    (at / "sub" / "config.json").write_text('{"a": 1}')
    (at / "bad.boxnote").write_text("{")
    (at / "old.doc").write_text("x")
    (at / "~$lock.docx").write_text("x")
    return at


def test_scan_takes_names_as_they_are(spark, tmp_path):
    at = tmp_path / "o dd+%41"
    (at / "b c").mkdir(parents=True)
    for name in ("b c/x%20y+z.md", "ü.txt"):
        (at / name).write_text("x")
    assert [r.rel_path for r in files.scan(spark, f"{at}/").orderBy("rel_path").collect()] == ["b c/x%20y+z.md", "ü.txt"]
    assert [r.rel_path for r in files.scan(spark, f"file://{at}").orderBy("rel_path").collect()] == ["b c/x%20y+z.md", "ü.txt"]


def test_pack(spark, tmp_path):
    packed = modules.Packed(spark, str(folder(tmp_path / "My Docs")))
    assert packed.name == "my-docs" and packed.description == "notes" and packed.tags == []
    assert packed.counts() == {"scanned": 6, "supported": 5, "skipped": 1, "failed": 1, "extracted": 4, "chunks": 4}
    assert sorted(r.id for r in packed.chunks.collect()) == ["my-docs/config.json/0", "my-docs/glossary/0", "my-docs/notes.txt/0", "my-docs/overview/0"]
    assert {r.source_file: (r.metadata.has_code, r.metadata.language) for r in packed.chunks.collect()}["sub/config.json"] == (True, "json")
    out = modules.write_module(packed, tmp_path / "out")
    assert sorted(p.name for p in (out / "content").iterdir()) == ["glossary.md", "notes.md", "overview.md", "sub__config.md"]
    assert len((out / "chunks" / "my-docs.jsonl").read_text().splitlines()) == 4
    assert "— Overview" in (out / "skills" / "my-docs" / "SKILL.md").read_text()
    assert manifest.issues_of(out) == []
    with pytest.raises(FileExistsError):
        modules.write_module(packed, tmp_path / "out")


def test_build_is_incremental_and_honours_overrides(spark, tmp_path):
    at = manifest.create_module("mod", tmp_path)
    module = manifest.load_module(at)
    module.chunking.overrides = [manifest.Override("content/fix*.md", "fixed")]
    module.depends_on = ["other@1"]
    manifest.save_module(module, at)
    (at / "content" / "fixed.md").write_text("# F\n\nx\n\n## S\n\ny")
    manifest.init_project(tmp_path)
    assert manifest.add_reference(tmp_path, "mod") and not manifest.add_reference(tmp_path, "mod") and manifest.add_reference(tmp_path, "gone")
    first = dict(x for x in modules.build(spark, tmp_path) if "warning" not in x[1])
    assert first["mod"] == "2 chunks" and first["gone"].startswith("skipped")
    assert ("mod", "warning: it depends on other@1, which is not installed") in list(modules.build(spark, tmp_path))
    assert dict(modules.build(spark, tmp_path))["mod"] == "fresh"
    lines = [json.loads(x) for x in (tmp_path / ".context/chunks/mod.jsonl").read_text().splitlines()]
    assert {x["id"] for x in lines} == {"mod/overview", "mod/fixed/0"} and all(len(x["metadata"]["source_hash"]) == 64 for x in lines)
    assert files.read_jsonl(spark, str(tmp_path / ".context/chunks")).count() == 2
    (at / "content" / "fixed.md").write_text("# F\n\nz")
    assert dict(modules.build(spark, tmp_path))["mod"] == "2 chunks"


def test_jsonl_sink(spark, tmp_path):
    packed = modules.Packed(spark, str(folder(tmp_path / "d")))
    files.write_jsonl(packed.chunks, str(tmp_path / "out"))
    back = files.read_jsonl(spark, str(tmp_path / "out"))
    assert sorted(r.id for r in back.collect()) == sorted(r.id for r in packed.chunks.collect())


def test_wiring(tmp_path):
    at = manifest.create_module("mod", tmp_path)
    (at / "skills" / "s").mkdir(parents=True)
    (at / "rules").mkdir()
    (at / "rules" / "r.md").write_text("x")
    (at / "CLAUDE.md").write_text("x")
    (at / ".cursorrules").write_text("x")
    root = tmp_path / "project"
    (root / ".cursor").mkdir(parents=True)
    done = wiring.install(at, root)
    assert sorted(done.links) == [".claude/rules/r.md", ".claude/skills/s", ".cursorrules"] and done.imported
    assert not wiring.install(at, root).imported
    assert sorted(wiring.remove(at, root).links) == sorted(done.links) and not (root / ".cursorrules").exists()
    (root / ".cursorrules").write_text("mine")
    with pytest.raises(FileExistsError):
        wiring.install(at, root)


def test_manifests(tmp_path):
    with pytest.raises(ValueError):
        manifest.Reference(path="a", git="b")
    with pytest.raises(ValueError):
        manifest.Chunking(strategy="odd")
    assert manifest.issues_of(tmp_path / "no") and manifest.issues_of(tmp_path) == ["module.yaml is missing"]
    assert manifest.frontmatter_tags("---\ntags: [a, b]\n---\nx") == ["a", "b"] and manifest.frontmatter_tags("---\ntags: a\n---\n") == ["a"] and manifest.frontmatter_tags("---\nopen") == []
    assert manifest.read_json(tmp_path / "none") == {}
    assert git.cache_folder("u", None, tmp_path) != git.cache_folder("u", "v", tmp_path)


def test_command_line(tmp_path, capsys):
    assert cli.main(["create", "mod", "--path", str(tmp_path)]) == 0
    assert cli.main(["validate", str(tmp_path / "mod")]) == 0
    (tmp_path / "x.md").write_text("---\na: 1\n---\nbody")
    assert cli.main(["extract", str(tmp_path / "*.md"), "--into", str(tmp_path / "mod")]) == 0
    assert (tmp_path / "mod/content/x.md").read_text() == "body"
    assert cli.main(["extract", str(tmp_path / "none.md"), "--into", str(tmp_path / "mod")]) == 1
    assert cli.main(["init", str(tmp_path)]) == 0
    assert cli.main(["add", str(tmp_path / "mod"), "--project", str(tmp_path)]) == 0
    assert cli.main(["list", "--project", str(tmp_path)]) == 0 and "mod 0.1.0" in capsys.readouterr().out
    assert cli.main(["remove", "mod", "--project", str(tmp_path)]) == 0
    assert cli.main(["sync", str(tmp_path / "mod")]) == 1


def test_files_that_flatten_to_one_name_stay_apart(spark, tmp_path):
    at = tmp_path / "d"
    (at / "b").mkdir(parents=True)
    for name, text in (("a.md", "# one"), ("a.txt", "two"), ("b/c.md", "# three"), ("b__c.md", "# four")):
        (at / name).write_text(text)
    packed = modules.Packed(spark, str(at), description="told")
    assert packed.description == "told" and [r.rel_path for r in packed.documents.orderBy("file_ord").collect()] == ["a.md", "a.txt", "b/c.md", "b__c.md"]
    out = modules.write_module(packed, tmp_path / "out")
    texts = sorted(p.read_text() for p in (out / "content").iterdir())
    assert texts == ["# a\n\ntwo", "# four", "# one", "# three"]
    assert modules.read_module(spark, out)[1].count() == 4
    packed.close()


def test_a_broken_line_is_an_error(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\n{"id": "b\n{"id": "c"}\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_jsonl(spark, str(tmp_path)).collect()
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\n{"id": "c"}\n')
    assert [r.id for r in files.read_jsonl(spark, str(tmp_path)).orderBy("id").collect()] == ["a", "c"]


def test_overrides_have_limits_of_their_own(spark, tmp_path):
    at = manifest.create_module("mod", tmp_path)
    module = manifest.load_module(at)
    module.chunking = manifest.Chunking("fixed", 500, 0, overrides=[manifest.Override("content/s*.md", max_tokens=5, overlap_tokens=1), manifest.Override("content/sh*.md", "heading")], contextualize=True)
    manifest.save_module(module, at)
    for name in ("short.md", "other.md"):
        (at / "content" / name).write_text("\n\n".join(f"w{k} x" for k in range(10)))
    found = modules.chunk_module(*modules.read_module(spark, at)).collect()
    sizes = {f: sorted(r.metadata.token_count for r in found if r.source_file == f"content/{f}.md" or r.source_file == f"{f}.md") for f in ("short", "other")}
    assert max(sizes["short"]) <= 6 and len(sizes["short"]) == 5 and sizes["other"] == [20]
    manifest.init_project(tmp_path)
    manifest.add_reference(tmp_path, "mod")
    assert any("nobody to ask" in what for _, what in modules.build(spark, tmp_path))
    done = dict(modules.build(spark, tmp_path, force=True, ask=lambda document, text: "said"))
    assert done["mod"].endswith("chunks") and "said" in (tmp_path / ".context/chunks/mod.jsonl").read_text()


def test_addresses_and_clones(tmp_path, capsys):
    import functools
    import http.server
    import subprocess
    import threading

    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "page.html").write_text("<html><body><nav>menu</nav><h1>Head</h1><p>text</p></body></html>")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path / "site"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = manifest.create_module("mod", tmp_path)
        url = f"http://127.0.0.1:{server.server_port}/page.html"
        module = manifest.load_module(at)
        module.sources = [manifest.Source("url", url=url, refresh="weekly")]
        manifest.save_module(module, at)
        assert cli.main(["sync", str(at)]) == 0
        text = next(p for p in (at / "content").iterdir() if "page" in p.name).read_text()
        assert f"source_url: {url}" in text and "refresh: weekly" in text and "# Head" in text and "menu" not in text
    finally:
        server.shutdown()
    run = functools.partial(subprocess.run, check=True, capture_output=True, cwd=at)
    run(["git", "init", "-q", "-b", "main"])
    run(["git", "add", "-A"])
    run(["git", "-c", "user.name=n", "-c", "user.email=e@x.y", "commit", "-qm", "m"])
    clone = git.module_folder(f"file://{at}#content@main", tmp_path / "home")
    assert sorted(p.name for p in clone.iterdir()) == sorted(p.name for p in (at / "content").iterdir())
    assert git.module_folder(f"file://{at}#content@main", tmp_path / "home") == clone
    with pytest.raises(RuntimeError, match="failed"):
        git.module_folder(f"file://{at}@gone", tmp_path / "home")


def test_a_tool_with_a_folder_of_its_own(tmp_path):
    at = manifest.create_module("mod", tmp_path)
    (at / "other" / "modes").mkdir(parents=True)
    (at / "other" / "modes" / "m.yaml").write_text("x")
    (at / "OTHER.md").write_text("x")
    root = tmp_path / "project"
    root.mkdir()
    assert sorted(wiring.install(at, root, ["other"]).links) == [".other/modes/m.yaml", "OTHER.md"]


def test_word_files_say_title_and_author(tmp_path):
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A: b</dc:title><dc:creator>N. N.</dc:creator></c>')
    assert render.word_properties(held.getvalue()) == 'title: "A: b"\nauthor: "N. N."\n'
