"""Directories as tables of files, and their contents as markdown.

Classification reads paths alone: the file source does not open a file whose content no
column asks for, so unsupported files cost a listing entry.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import render

# fixed values: classes by extension; others are unsupported
CLASSES = {
    "md": "markdown", "markdown": "markdown", "txt": "plaintext", "pdf": "pdf", "pptx": "pptx", "docx": "docx", "docm": "docx",
    "boxnote": "boxnote", "html": "html", "htm": "html", "yaml": "structured", "yml": "structured", "json": "structured",
}


def is_hidden(rel_path: Column | str) -> Column:
    return T.col(rel_path).rlike(r"(^|/)[._]")


def is_temporary(rel_path: Column | str) -> Column:
    name = T.base_name(rel_path)
    return name.rlike(r"^(~\$|\._)|^\.DS_Store$|\.(tmp|swp|swo)$|~$") | (F.lower(name) == "thumbs.db")


def classify(rel_path: Column | str) -> Column:
    """Class by the lower-cased extension of the file name."""
    ext = F.lower(F.regexp_extract(T.base_name(rel_path), r"(?s)^.+\.([^.]+)$", 1))
    classes = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(classes, ext), F.lit("unsupported"))


def flat_name(rel_path: Column | str) -> Column:
    """``a/b.pdf`` as ``a__b.md``."""
    return F.concat(F.replace(T.sub(rel_path, r"(?<=[^/])\.[^./]*\z", ""), F.lit("/"), F.lit("__")), F.lit(".md"))


def below(path: Column, folder: str) -> Column:
    """What follows the folder in a full path, with or without a scheme and host on either."""
    inside = re.sub("^[a-z]+:/*", "/", folder.rstrip("/")) + "/"
    plain = F.regexp_replace(path, "^[a-z]+:/*", "/")
    return F.substring(plain, F.instr(plain, F.lit(inside)) + F.lit(len(inside)), F.length(plain))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """rel_path, name, classification, length, modified and content of every file that counts, in no order: contents are never sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("rel_path", below(F.col("path"), folder))
    kept = files.where(~is_hidden("rel_path") & ~is_temporary("rel_path"))
    return kept.select(
        "rel_path", T.base_name("rel_path").alias("name"), classify("rel_path").alias("classification"), "length", F.col("modificationTime").alias("modified"), "content"
    )


def source_type(source: Column | str) -> Column:
    c = T.col(source)
    return F.when(c.rlike("^https?://"), "url").when(F.lower(c).endswith(".pdf"), "pdf").when(F.lower(c).endswith(".pptx"), "pptx").otherwise("markdown")


#: What turns bytes of a class into markdown in Python: (name, content) -> text. ``register`` adds to them.
CONVERTERS: dict[str, Callable[[str, bytes], str]] = {"html": render.html_file, "boxnote": render.box_note, "pptx": render.slides, "docx": render.word_document, "pdf": render.pdf}
NATIVE = ("markdown", "plaintext", "structured")


def register(classification: str, converter: Callable[[str, bytes], str]) -> None:
    CONVERTERS[classification] = converter


def to_markdown(files: DataFrame) -> DataFrame:
    """rel_path, md_name, classification, content, error for all supported files.

    Text classes are column expressions; the others go through one Arrow function that
    turns a failure into ``error``, so that no file stops the rest.
    """
    known = dict(CONVERTERS)

    @F.pandas_udf("struct<markdown:string,error:string,about:string>")
    def convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, names, contents in batches:
            rows = []
            for kind, name, content in zip(kinds, names, contents, strict=True):
                try:
                    rows.append((known[kind](name, content), None, render.word_properties(content) if kind == "docx" else ""))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=["markdown", "error", "about"])

    base = files.where("classification != 'unsupported'")
    text = F.decode(F.col("content"), "UTF-8")
    stem = T.sub("name", r"(?s)(?<=.)\.[^.]*\z", "")
    native = F.when(F.col("classification") == "markdown", T.strip_frontmatter(text)).when(F.col("classification") == "plaintext", T.plain_as_markdown(stem, text)).otherwise(T.structured_as_markdown("name", text))
    keep = ["rel_path", flat_name("rel_path").alias("md_name"), "classification"]
    easy = base.where(F.col("classification").isin(*NATIVE)).select(*keep, native.alias("content"), F.lit(None).cast("string").alias("error"))
    hard = base.where(~F.col("classification").isin(*NATIVE)).withColumn("_c", convert("classification", "name", "content"))
    # word files carry where they come from
    when = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    origin = F.concat(F.lit("---\nfile_hash: "), F.sha2("content", 256), F.lit("\nfile_size: "), F.col("length").cast("string"), F.lit("\nmodified_at: '"), when(F.col("modified")), F.lit("'\nconverted_at: '"),
                      when(F.current_timestamp()), F.lit("'\nconverter: quillmill\nsource_type: docx\n"), F.col("_c.about"), F.lit("---\n\n"))
    shown = F.when(F.col("classification") == "docx", F.concat(origin, T.even_blank_lines(T.without_icons("_c.markdown")))).otherwise(F.col("_c.markdown"))
    return easy.unionByName(hard.select(*keep, shown.alias("content"), F.col("_c.error").alias("error")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank lines do not count, a broken one is an error when it is read."""
    from ..operators import schema

    return spark.read.schema(schema.CHUNK).option("mode", "FAILFAST").json(path)


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written, a folder for each module."""
    chunks.withColumn("_m", F.col("module")).write.mode("overwrite").partitionBy("_m").option("ignoreNullFields", "false").json(path)


def as_json(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.to_json(F.struct("id", "module", "source_file", "section_path", "content", "metadata"), {"ignoreNullFields": "false"}).alias("value"))


def as_text(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.format_string("--- [%s] (%d tokens) ---\n%s\n", "id", "metadata.token_count", "content").alias("value"))
