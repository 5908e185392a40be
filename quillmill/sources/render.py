"""Markdown from HTML, note trees, slides, word files and PDF, with the standard library."""

from __future__ import annotations

import io
import json
import posixpath
import re
import shutil
import subprocess
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

HIDDEN = {"script", "style", "nav", "footer", "header"}  # left out of fetched pages


def stem(name: str) -> str:
    return posixpath.splitext(name)[0]


class _Markdown(HTMLParser):
    """A stack of open elements, each with the text it has so far."""

    BLOCKS = {"p", "div", "section", "article", "main", "body", "html", "ul", "ol", "table", "blockquote", "pre", "title", "head"}
    VOID = {"br", "hr", "img", "meta", "link", "input"}

    def __init__(self, drop: set[str]):
        super().__init__(convert_charrefs=True)
        self.drop = drop
        self.stack: list[tuple[str, dict, list[str]]] = [("", {}, [])]

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            at = dict(attrs)
            self._put({"br": "  \n", "hr": "\n\n---\n\n", "img": f"![{at.get('alt') or ''}]({at.get('src') or ''})"}.get(tag, ""))
            return
        if tag in ("p", "li") and self.stack[-1][0] == tag:
            self.handle_endtag(tag)
        self.stack.append((tag, dict(attrs), []))

    def handle_data(self, data):
        inside = any(t in ("pre", "code", "script", "style") for t, _, _ in self.stack)
        self._put(data if inside else re.sub(r"\s+", " ", data))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.stack[1:]):
            return
        while len(self.stack) > 1:
            top = self._pop()
            if top == tag:
                return

    def _put(self, text: str) -> None:
        self.stack[-1][2].append(text)

    def _pop(self) -> str:
        tag, at, parts = self.stack.pop()
        if tag not in self.drop:
            self._put(self._shown(tag, at, "".join(parts)))
        return tag

    def _shown(self, tag: str, at: dict, text: str) -> str:
        inner = text.strip()
        if m := re.fullmatch(r"h([1-6])", tag):
            return f"\n\n{'#' * int(m[1])} {' '.join(inner.split())}\n\n" if inner else ""
        marks = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}
        if tag in marks and not any(t == "pre" for t, _, _ in self.stack):
            lead, tail = (" " if text[:1].isspace() else ""), (" " if text[-1:].isspace() else "")
            return f"{lead}{marks[tag]}{inner}{marks[tag]}{tail}" if inner else text
        if tag == "a":
            return f"[{inner}]({at['href']})" if inner and at.get("href") else text
        if tag == "li":
            lists = [t for t, _, _ in self.stack if t in ("ul", "ol")]
            mark = f"{sum(p.startswith(chr(10)) for p in self.stack[-1][2]) + 1}." if lists[-1:] == ["ol"] else "*"
            return f"\n{mark} " + inner.replace("\n", "\n  ")
        if tag == "pre":
            return f"\n\n```\n{text.strip(chr(10))}\n```\n\n"
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {line}" for line in inner.split("\n")) + "\n\n"
        if tag in ("td", "th"):
            return f" {inner} |"
        if tag == "tr":
            head = any(t == "thead" for t, _, _ in self.stack)
            return f"\n|{text.strip(chr(10))}" + (f"\n|{' --- |' * text.count(' |')}" if head else "")
        if tag in self.BLOCKS:
            return f"\n\n{text}\n\n" if inner else ""
        return text

    def finished(self) -> str:
        self.close()
        while len(self.stack) > 1:
            self._pop()
        text = re.sub(r"[ \t]+\n", lambda m: "  \n" if m[0] == "  \n" else "\n", "".join(self.stack[0][2]))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+(?=\S)", lambda m: m[0] if "  " in m[0] else "\n", text)).strip()


def html(text: str, drop: set[str] | None = None) -> str:
    """HTML as markdown with ``#`` headings; elements of ``drop`` vanish with their text."""
    parser = _Markdown(drop or set())
    parser.feed(text)
    return parser.finished()


def html_file(name: str, content: bytes) -> str:
    return html(content.decode("utf-8", "replace"))


def page(text: str) -> str:
    """A fetched page, without scripts, styles and navigation."""
    return html(text, HIDDEN)


# --- note trees ----------------------------------------------------------------------


def _inline(nodes: list) -> str:
    out = ""
    for n in nodes:
        if isinstance(n, dict) and n.get("type") == "text":
            text = n.get("text", "")
            kinds = {m.get("type") for m in n.get("marks", []) if isinstance(m, dict)}
            for kind, mark in (("bold", "**"), ("italic", "*"), ("code", "`")):
                text = f"{mark}{text}{mark}" if kind in kinds else text
            out += text
        elif isinstance(n, dict) and n.get("type") == "hard_break":
            out += "\n"
    return out


def _note_lines(node: object, depth: int, mark: str):
    """Lines of one node: a generator that recurses with the list depth and the item's mark."""
    if not isinstance(node, dict):
        return
    kind, inside = node.get("type", ""), node.get("content") or []
    if kind == "heading":
        if text := _inline(inside):
            yield f"\n{'#' * ((node.get('attrs') or {}).get('level', 2) + 1)} {text}"
    elif kind == "paragraph":
        yield _inline(inside)
    elif kind == "horizontal_rule":
        yield "\n---"
    elif kind in ("list_item", "check_list_item"):
        lead = f"{mark} "
        for child in inside:
            if isinstance(child, dict) and child.get("type") == "paragraph":
                if text := _inline(child.get("content") or []):
                    yield f"{'  ' * depth}{lead}{text}"
                    lead = "  "
            else:
                yield from _note_lines(child, depth + 1, "-")
    else:
        numbered = kind == "ordered_list"
        for k, child in enumerate(inside, 1):
            yield from _note_lines(child, depth, f"{k}." if numbered else "-")


def box_note(name: str, content: bytes) -> str:
    tree = json.loads(content.decode("utf-8", "replace"))
    lines = [f"# {stem(name)}", ""]
    for node in (tree.get("doc") or {}).get("content") or []:
        lines += _note_lines(node, 0, "-")
    kept = [line for k, line in enumerate(lines) if line.strip() or k == 0 or lines[k - 1].strip()]
    return "\n".join(kept).strip() + "\n"


# --- office files: zipped XML ----------------------------------------------------------


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _all(e, name: str) -> list:
    return [x for x in e.iter() if _local(x) == name]


def _text(e) -> str:
    return "".join(x.text or "" for x in _all(e, "t"))


def slides(name: str, content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        found = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = [f"# {stem(name)}\n"]
        for k, (number, part) in enumerate(found, 1):
            out.append(f"\n## Slide {k}")
            shapes = _all(ElementTree.fromstring(z.read(part)), "sp")
            titles = [s for s in shapes if any(p.get("type") in ("title", "ctrTitle") for p in _all(s, "ph"))][:1]
            out += [f"\n### {t}" for s in titles if (t := " ".join(_text(p) for p in _all(s, "p")).strip())]
            for para in (p for s in shapes if s not in titles for p in _all(s, "p")):
                if text := _text(para).strip():
                    bold = any(r.get("b") in ("1", "true") for r in _all(para, "rPr"))
                    out.append(f"\n**{text}**" if bold else f"- {text}")
            rels = f"ppt/slides/_rels/slide{number}.xml.rels"
            notes = [posixpath.normpath(posixpath.join("ppt/slides", r.get("Target", ""))) for r in ElementTree.fromstring(z.read(rels)) if r.get("Type", "").endswith("/notesSlide")] if rels in names else []
            for part in (n for n in notes if n in names):
                bodies = [s for s in _all(ElementTree.fromstring(z.read(part)), "sp") if any(p.get("type") == "body" for p in _all(s, "ph"))]
                said = [t for s in bodies for p in _all(s, "p") if (t := _text(p).strip())]
                out += ["", *(f"> {t}" for t in said)] if said else []
    return "\n".join(out) + "\n"


def word_document(name: str, content: bytes) -> str:
    """Headings, paragraphs, list items and tables of a word file; under ten characters is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _all(ElementTree.fromstring(z.read("word/document.xml")), "body")[0]
    out = []
    for e in body:
        if _local(e) == "p":
            style = next((v for s in _all(e, "pStyle") for k, v in s.attrib.items() if k.endswith("val")), "")
            text = _text(e).strip()
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style)
            lead = "#" * int(level[1]) + " " if level else "# " if style.lower() == "title" else "- " if _all(e, "numPr") else ""
            out += [lead + text] if text else []
        elif _local(e) == "tbl":
            rows = [[_text(c).strip() for c in r if _local(c) == "tc"] for r in _all(e, "tr")]
            lines = [f"| {' | '.join(r)} |" for r in rows]
            out.append("\n".join([*lines[:1], *(["|" + " --- |" * len(rows[0])] if rows else []), *lines[1:]]))
    text = "\n\n".join(out)
    if len(text.strip()) < 10:
        raise ValueError("the document has next to no text")
    return text


def word_properties(content: bytes) -> str:
    """Title and author of a word file as lines of a leading block, where they are set."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "docProps/core.xml" not in z.namelist():
            return ""
        core = ElementTree.fromstring(z.read("docProps/core.xml"))
    said = {_local(e): (e.text or "").strip() for e in core}
    return "".join(f"{name}: {json.dumps(said[tag], ensure_ascii=False)}\n" for name, tag in (("title", "title"), ("author", "creator")) if said.get(tag))


def pdf(name: str, content: bytes) -> str:
    """Text of a PDF by the ``pdftotext`` tool where it is installed; an error where not."""
    tool = shutil.which("pdftotext")
    if not tool:
        raise RuntimeError("pdftotext is not installed")
    done = subprocess.run([tool, "-layout", "-", "-"], input=content, capture_output=True, timeout=60, check=False)
    text = done.stdout.decode("utf-8", "replace")
    if done.returncode or not text.strip():
        raise RuntimeError("no text could be read")
    lines = [line.strip() for line in text.split("\n")]
    return f"# {stem(name)}\n\n" + re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() + "\n"
