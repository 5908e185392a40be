"""Documents to chunks by heading, by definition or by a token budget.

The order-dependent part, which pieces a text is cut into, is one Arrow function over the
texts; it returns an array of pieces for each document. All else (ids, titles, code flags,
neighbours) are column expressions over that array, so chunking is one pass over the
documents without a shuffle, and a document's chunks never depend on another's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from .fold import ranges

ORPHAN_LINE = re.compile(r"#{1,6}\s+\S")
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")
BOLD_LINE = re.compile("\\*\\*(.+?)\\*\\*[:\\s—–-]\\s*(.*)")
PIECES = "array<struct<path:array<string>,content:string,number:int,tokens:int>>"
Piece = tuple[list[str], str, int | None]  # section path, content, running number of a budget piece


def _orphan(text: str) -> bool:
    return all(ORPHAN_LINE.match(line.strip()) for line in text.split("\n") if line.strip())


class Cutter:
    """Cuts one text after the other; counts are remembered within a text."""

    def __init__(self, limit: int, overlap: int, level: int = 2, bpe: str | None = None):
        self.limit, self.overlap, self.level, self.bpe = limit, overlap, level, bpe
        self.count = K.counter(bpe)

    # --- by budget -----------------------------------------------------------------

    def budget(self, text: str, path: list[str] | None = None) -> list[Piece]:
        out: list[str] = []
        run: list[str] = []
        sizes: list[int] = []

        def flush() -> None:
            out.extend("\n\n".join(run[a:b]) for a, b in ranges(sizes, self.limit, self.overlap))
            run.clear()
            sizes.clear()

        for p in filter(None, map(str.strip, text.split("\n\n"))):
            n = self.count(p)
            if n > self.limit:  # a barrier: nothing overlaps across it
                flush()
                out.extend(self._split_long(p))
            else:
                run.append(p)
                sizes.append(n)
        flush()
        return [(path or [], c, k) for k, c in enumerate(out)]

    def _split_long(self, text: str) -> list[str]:
        """A paragraph over the limit: by lines, else by sentences, else by token windows."""
        for parts, joiner in ((text.split("\n"), "\n"), (SENTENCE_GAP.split(text), " ")):
            sizes = [self.count(p) if p.strip() else 0 for p in parts]
            if sum(1 for p in parts if p.strip()) > 1 and max(sizes) <= self.limit:
                joined = (joiner.join(parts[a:b]).strip() for a, b in ranges(sizes, self.limit, self.overlap))
                return [c for c in joined if c]
        return K.windows(text, self.limit, max(self.limit - self.overlap, 1), self.bpe)

    # --- by heading ----------------------------------------------------------------

    def _sections(self, text: str, level: int) -> list[tuple[list[str], str]]:
        found = list(re.finditer(rf"^#{{{level}}}\s+(.+)$", text, re.MULTILINE))
        if not found:
            return [([], text)]
        ends = [*(m.start() for m in found[1:]), len(text)]
        before = text[: found[0].start()].strip()
        head = [] if _orphan(before) else [([], before)]
        return head + [([m[1].strip()], text[m.start() : end].strip()) for m, end in zip(found, ends, strict=True)]

    def heading(self, text: str) -> list[Piece]:
        out: list[Piece] = []
        for path, section in self._sections(text, self.level):
            if _orphan(section):
                continue
            parts = [([], section)]
            if self.count(section) > self.limit:
                parts = self._sections(section, self.level + 1)
                if len(parts) == 1:  # nothing to cut at: the section as it is
                    parts = [([], section)]
            for more, part in parts:
                if _orphan(part):
                    continue
                if self.count(part) <= self.limit:
                    out.append((path + more, part, None))
                else:
                    out.extend(self.budget(part, path + more))
        return out

    # --- by definition -------------------------------------------------------------

    def definition(self, text: str) -> list[Piece]:
        found = self._headed(text)
        if len(found) < 2:
            found = self._bold(text)
        if not found:
            return self.budget(text)
        out: list[Piece] = []
        for a, b in ranges([self.count(block) for _, block in found], self.limit):
            term, joined = found[a][0], "\n\n".join(block for _, block in found[a:b])
            out.extend(self.budget(joined, [term]) if self.count(joined) > self.limit else [([term], joined, None)])
        return out

    @staticmethod
    def _headed(text: str) -> list[tuple[str, str]]:
        found = list(re.finditer(r"^#{3,4}\s+(.+)$", text, re.MULTILINE))
        ends = [*(m.start() for m in found[1:]), len(text)]
        return [(m[1].strip(), text[m.start() : e].strip()) for m, e in zip(found, ends[: len(found)], strict=True)]

    @staticmethod
    def _bold(text: str) -> list[tuple[str, str]]:
        found: list[tuple[str, list[str]]] = []
        for line in text.splitlines():
            m = BOLD_LINE.match(line)
            if m:
                found.append((m[1].strip(), [line]))
            elif found:
                found[-1][1].append(line)
        return [(term, "\n".join(block).strip()) for term, block in found]


#: Strategies by name; ``register`` adds to them.
STRATEGIES: dict[str, Callable[[Cutter, str], list[Piece]]] = {"fixed": Cutter.budget, "heading": Cutter.heading, "definition": Cutter.definition}


def register(name: str, strategy: Callable[[Cutter, str], list[Piece]]) -> None:
    """Make a strategy of one's own available: (cutter, text) -> [(path, content, number)]."""
    STRATEGIES[name] = strategy


def _cut(limit: int, overlap: int, level: int, bpe: str | None):
    known = dict(STRATEGIES)

    @F.pandas_udf(f"struct<pieces:{PIECES},error:string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cutter = Cutter(limit, overlap, level, bpe)
        for texts, names in batches:
            rows = []
            for text, name in zip(texts, names, strict=True):
                try:  # a document that cannot be cut is reported, the others go on
                    found = known[name](cutter, text or "")
                    rows.append(([{"path": p, "content": c, "number": k, "tokens": cutter.count(c)} for p, c, k in found], None))
                except Exception as e:  # noqa: BLE001
                    rows.append(([], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["pieces", "error"])

    return cut


def chunk(docs: DataFrame, *, limit: int = 500, overlap: int = 50, level: int = 2, bpe: str | None = None, version: str = "0.1.0", tags: Column | None = None, keep_errors: bool = False) -> DataFrame:
    """Chunks of ``docs(module, source_file, content[, strategy])``, a row for each.

    Columns: id, module, source_file, section_path, content and a struct ``metadata``. With
    ``keep_errors`` a row with ``error`` stands for a document that could not be cut.
    """
    strategy = F.coalesce("strategy", F.lit("fixed")) if "strategy" in docs.columns else F.lit("fixed")
    cut = docs.withColumn("strategy", strategy).withColumn("_cut", _cut(limit, overlap, level, bpe)("content", "strategy"))
    stem, head = T.file_stem("source_file"), F.concat(F.col("module"), F.lit("/"))
    title = F.when(F.col("strategy") != "fixed", T.first_h1("content"))
    cut = cut.select(
        "module", "source_file", "strategy", "_cut", F.concat(head, stem).alias("_base"), T.file_id("source_file").alias("_fid"), F.coalesce(title, T.title_of_path("source_file")).alias("_title"), (tags if tags is not None else F.array().cast("array<string>")).alias("_tags"))
    # a generator over the finished array, so that the Arrow function runs once
    named = cut.withColumn("_ids", F.transform("_cut.pieces", lambda p: F.concat_ws("/", F.array(F.col("_base")), F.transform(p.path, T.slug), p.number.cast("string"))))
    each = named.select("*", F.posexplode("_cut.pieces").alias("_k", "_p"))
    content, depth = F.col("_p.content"), F.size("_p.path")
    by_heading = F.col("strategy") == "heading"
    plain = F.col("_p.number").isNull()
    last, above = F.get("_p.path", depth - 1), F.get("_p.path", depth - 2)
    metadata = F.struct(
        F.col("_tags").alias("tags"), F.lit(version).alias("version"), F.when(by_heading & plain, depth).alias("heading_level"),
        F.when(~plain, last).when(by_heading, above).alias("parent_section"), F.col("_title").alias("doc_title"), F.col("_fid").alias("file_id"),
        T.has_code(content).alias("has_code"), T.code_language(content).alias("language"), F.col("_p.tokens").alias("token_count"),
        F.col("_k").alias("chunk_index"), F.size("_ids").alias("total_chunks"),
        F.get("_ids", F.col("_k") - 1).alias("prev_chunk_id"), F.get("_ids", F.col("_k") + 1).alias("next_chunk_id"))
    chunks = each.select(F.get("_ids", F.col("_k")).alias("id"), "module", "source_file", F.col("_p.path").alias("section_path"), content.alias("content"), metadata.alias("metadata"))
    if not keep_errors:
        return chunks
    failed = cut.where("_cut.error is not null").select("module", "source_file", F.col("_cut.error").alias("error"))
    return chunks.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)
