"""Command line: python -m quillmill.cli COMMAND."""

from __future__ import annotations

import argparse
import sys
import urllib.request
from pathlib import Path

from .sources import manifest, render, wiring


def spark_session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def extract(source: str, into: str, kind: str | None = None, refresh: str | None = None) -> list[Path]:
    """A file, a pattern of files or an address into a module's content folder."""
    import datetime
    import re

    content = Path(into) / "content"
    content.mkdir(parents=True, exist_ok=True)
    kind = kind or ("url" if re.match("https?://", source) else "pdf" if source.lower().endswith(".pdf") else "pptx" if source.lower().endswith(".pptx") else "docx" if source.lower().endswith(".docx") else "markdown")
    if kind == "url":
        with urllib.request.urlopen(source, timeout=30) as r:  # noqa: S310
            html = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        path, host = re.match(r"https?://([^/?#]*)([^?#]*)", source)[2], re.match(r"https?://([^/?#]*)", source)[1]
        name = re.sub(r"[^\w.\-]", "-", path.rstrip("/").rpartition("/")[2] or host).strip("-")[:80] or "page"
        head = f"---\nsource_url: {source}\nfetched_at: {datetime.datetime.now(datetime.UTC):%Y-%m-%dT%H:%M:%SZ}\n" + (f"refresh: {refresh}\n" if refresh else "") + "---\n\n"
        out = content / f"{name}.md"
        out.write_text(head + render.page(html))
        return [out]
    at = Path(source)
    found = sorted(at.parent.glob(at.name)) if "*" in at.name else [at]
    if not found or not all(p.exists() for p in found):
        raise FileNotFoundError(source)
    turn = {"pdf": render.pdf, "pptx": render.slides, "docx": render.word_document}.get(kind)
    written = []
    for p in found:
        out = content / (p.name if kind == "markdown" else f"{p.stem}.md")
        text = turn(p.name, p.read_bytes()) if turn else re.sub(r"(?s)\A---.*?\n---\n*", "", p.read_text(errors="replace"))
        out.write_text(text)
        written.append(out)
    return written


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillmill")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *options):
        c = sub.add_parser(name)
        for names, kw in options:
            c.add_argument(*names, **kw)

    project = (("--project", "-p"), {"default": "."})
    tool = (("--tool",), {"action": "append"})
    command("init", (("path",), {"nargs": "?", "default": "."}))
    command("create", (("name",), {}), (("--path", "-p"), {"default": "."}))
    command("build", project, (("--force",), {"action": "store_true"}), (("--ask",), {"help": "package.module:function that gives a context for (document, chunk)"}))
    command("chunks", (("module",), {}), (("--format", "-f"), {"choices": ["jsonl", "text"], "default": "jsonl"}))
    command("list", project)
    command("extract", (("source",), {}), (("--into",), {"required": True}), (("--type",), {"choices": list(manifest.SOURCES)}))
    command("sync", (("module",), {}))
    command("add", (("module",), {}), project, tool)
    command("remove", (("name",), {}), project, tool)
    command("validate", (("module",), {}))
    command("pack", (("folder",), {}), (("--output", "-o"), {}), (("--name",), {}), (("--description", "-d"), {}), (("--tags",), {}), (("--strategy",), {"choices": list(manifest.STRATEGIES)}), (("--max-tokens",), {"type": int, "default": 500}),
            (("--overlap",), {"type": int, "default": 50}), (("--format", "-f"), {"choices": ["jsonl", "text"], "default": "jsonl"}), (("--install",), {"action": "store_true"}), project, tool)
    a = p.parse_args(args)
    try:
        return _run(a)
    except (OSError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a) -> int:
    from .plans import modules
    from .sources import files

    if a.command == "init":
        manifest.init_project(a.path)
    elif a.command == "create":
        print(manifest.create_module(a.name, a.path))
    elif a.command == "build":
        ask = None
        if a.ask:
            import importlib

            where, _, function = a.ask.partition(":")
            ask = getattr(importlib.import_module(where), function)
        for name, what in modules.build(spark_session(), a.project, force=a.force, ask=ask):
            print(f"{name}: {what}")
    elif a.command == "chunks":
        found = modules.chunk_module(*modules.read_module(spark_session(), a.module))
        for r in (files.as_json(found) if a.format == "jsonl" else files.as_text(found)).toLocalIterator():
            print(r[0])
    elif a.command == "list":
        for ref in manifest.load_project(a.project).modules:
            try:
                m = manifest.load_module(manifest.resolve(ref, a.project))
                print(f"{m.name} {m.version} {m.description}")
            except (OSError, ValueError, RuntimeError) as e:
                print(f"{ref.path or ref.git}: {e}")
    elif a.command == "extract":
        print(*extract(a.source, a.into, a.type), sep="\n")
    elif a.command == "sync":
        sources = manifest.load_module(a.module).sources
        if not sources:
            raise ValueError("the module declares no sources")
        for s in sources:
            print(*extract(s.url or s.path or "", a.module, s.type, s.refresh), sep="\n")
    elif a.command == "add":
        print(*wiring.install(a.module, a.project, a.tool).links, sep="\n")
        manifest.add_reference(a.project, a.module)
    elif a.command == "remove":
        conf = manifest.load_project(a.project)
        for ref in conf.modules:
            at = manifest.resolve(ref, a.project)
            if not manifest.issues_of(at) and manifest.load_module(at).name == a.name:
                wiring.remove(at, a.project, a.tool)
                conf.modules.remove(ref)
                manifest.save_project(conf, a.project)
                return 0
        raise ValueError(f"{a.name} is not configured")
    elif a.command == "validate":
        found = manifest.issues_of(a.module)
        print(*found or ["valid"], sep="\n")
        return 1 if found else 0
    elif a.command == "pack":
        import shutil

        packed = modules.Packed(spark_session(), str(Path(a.folder).resolve()), name=a.name, description=a.description, tags=a.tags, strategy=a.strategy, limit=a.max_tokens, overlap=a.overlap)
        print(packed.counts(), file=sys.stderr)
        if a.install:
            at = Path(a.project) / ".context" / "packed" / packed.name
            shutil.rmtree(at, ignore_errors=True)
            modules.write_module(packed, at)
            wiring.install(at, a.project, a.tool)
            manifest.add_reference(a.project, str(at.resolve()))
        elif a.output:
            print(modules.write_module(packed, a.output))
        else:
            for r in (files.as_json(packed.chunks) if a.format == "jsonl" else files.as_text(packed.chunks)).toLocalIterator():
                print(r[0])
        packed.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
