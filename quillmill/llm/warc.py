r"""Derived WARC records: metadata and plain-text conversion records of responses.

Each response gives two records. Both name the response in WARC-Refers-To and carry its
target, date, headers and payload digest on; each has an identifier derived from the
response's (so a rerun gives the same), a block, the block's length in bytes and its
digest. Digests are SHA-1 in base 32, as in public crawls. The conversion's block is the
visible text: comments, scripts and styles go, block elements end lines, other tags vanish,
character references are decoded, runs of blanks and of blank lines become one. A comment, a
script or a tag that is never closed goes on to the end, as in browsers, so that no scan of
the rest is ever repeated and the time is linear in any text. The metadata's block lists
fields in the application/warc-fields form. Line ends within a url are percent-encoded in
headers, those within source headers become bars.

Deriving is one pass of built-in expressions over the responses, with no shuffle.

Defined cases: a null payload counts as empty and gives an empty text; a null target gives
records without WARC-Target-URI; a null record identifier is derived from the payload; an
empty table gives an empty result; repeated responses give repeated records, with equal
identifiers; payloads of any length are converted whole; other columns are ignored.
"""

from __future__ import annotations

import gzip
import html.entities
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: base 32
# fixed values: elements that end a line
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
STEPS = (
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"(?is)<(?:script|style)(?:[ \t\r\n\f/][^>]*)?(?:>.*?(?:</(?:script|style)[ \t\r\n\f]*>|\z)|\z)", " "),
    (rf"(?i)</?(?:{BLOCKS})(?:[ \t\r\n\f][^>]*)?/?(?:>|\z)", "\n"),
    (r"<[a-zA-Z/!?][^>]*(?:>|\z)", ""),
)
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
BLANKS = (("[ \\t\\r\\f\u00a0]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))


def references() -> dict[str, str]:
    """What the standard's character references stand for, by name, and the numbers that mean Windows characters."""
    out = {name[:-1]: value for name, value in html.entities.html5.items() if name.endswith(";")}
    return out | {f"#{n}": bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decoded(text: Column) -> Column:
    """Known references as their characters; unknown names stay, impossible numbers become U+FFFD."""
    known = F.from_json(F.lit(json.dumps(references())), "map<string,string>")

    def char(n: Column) -> Column:
        possible = (n > 0) & (n < 0xD800) | (n > 0xDFFF) & (n < 0x110000)
        return F.coalesce(F.try_element_at(known, F.concat(F.lit("#"), n.cast("string"))), F.when(possible, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd"))

    def one(ref: Column) -> Column:
        return F.when(F.substring(ref, 2, 1) == "#", _let(_number(ref), char)).otherwise(F.coalesce(F.try_element_at(known, F.substring_index(F.substring(ref, 2, 40), ";", 1)), ref))

    def whole(t: Column) -> Column:
        parts = F.zip_with(F.split(t, REFERENCE, -1), F.concat(F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), one), F.array(F.lit(""))), lambda gap, c: F.array(gap, c))
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.flatten(parts), "")).otherwise(t)

    return _let(text, whole)


def _number(ref: Column) -> Column:
    """The number of a numeric reference."""
    digits = F.substring_index(ref, ";", 1)
    hexadecimal = F.lower(F.substring(digits, 3, 1)) == "x"
    return F.when(hexadecimal, F.conv(F.substring(digits, 4, 6), 16, 10)).otherwise(F.substring(digits, 3, 7)).cast("long")


def text_of(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    out = _decoded(out)
    for pattern, by in BLANKS:
        out = F.regexp_replace(out, pattern, by)
    return out


def digest_of(block: Column) -> Column:
    """``sha1:`` and the digest in base 32: each five hexadecimal digits are four letters."""
    sha = F.sha1(F.encode(block, "UTF-8"))
    letters = []
    for at in range(1, 41, 5):
        twenty = F.conv(F.substring(sha, at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(twenty, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(F.lit("sha1:"), *letters)


def uuid_of(name: Column) -> Column:
    """A version 5 style identifier from the SHA-1 of ``name``."""
    h = F.sha1(F.encode(name, "UTF-8"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages as response records: record_id, target_uri, date, http_headers, payload."""
    return pages.select(
        "page_id",
        uuid_of(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit("")))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string")).alias("http_headers"),
        F.col("html").alias("payload"),
    )


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response: record_type, record_id, refers_to, target_uri, date,
    source_headers, source_digest, content_type, content_length, block_digest, header, block."""
    payload = F.coalesce("payload", F.lit(""))
    base = responses.select(
        *keep,
        F.coalesce("record_id", uuid_of(payload)).alias("refers_to"),
        "target_uri",
        "date",
        F.coalesce("http_headers", F.lit("")).alias("source_headers"),
        payload.alias("payload"),
        digest_of(payload).alias("source_digest"),
        text_of(F.col("payload")).alias("text"),
    )
    fields = F.concat(
        F.lit("source-digest: "), F.col("source_digest"), F.lit("\r\nsource-length: "), F.octet_length("payload").cast("string"), F.lit("\r\ntext-length: "), F.octet_length("text").cast("string"),
        F.lit("\r\nsource-headers: "), F.regexp_replace("source_headers", "[\r\n]+", " | "), F.lit("\r\n"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = base.withColumn("r", F.explode(kinds)).select(*keep, "refers_to", "target_uri", "date", "source_headers", "source_digest", "r.*")
    rows = rows.withColumns({
        "record_id": uuid_of(F.concat_ws("|", "record_type", "refers_to")),
        "content_length": F.octet_length("block").cast("long"),
        "block_digest": digest_of(F.col("block")),
    })
    uri = F.replace(F.replace(F.col("target_uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    header = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")), F.coalesce(line("WARC-Date", F.col("date")), F.lit("")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("source_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n\r\n"))
    return rows.select(*keep, "record_type", "record_id", "refers_to", "target_uri", "date", "source_headers", "source_digest", "content_type", "content_length", "block_digest", header.alias("header"), "block")


def write(records: DataFrame, path: str, compression: str | None = "gzip") -> list[tuple[str, int, int]]:
    """Write records as WARC files, each record a gzip member of its own; (file, records, bytes) of each.

    path: a new folder that driver and executors reach, as a path or a uri that Arrow's file
    systems know. A task writes under a name of its attempt and renames when it is done, so
    a lost or repeated attempt leaves no file that counts; ``_SUCCESS`` comes last.
    """
    from pyarrow import fs

    at = lambda: fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system, folder = at()
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, out, n = TaskContext.get(), None, 0
        system, folder = at()
        name = f"part-{context.partitionId():06d}.warc{'.gz' if compression == 'gzip' else ''}"
        own = f"{folder}/_attempt-{context.taskAttemptId()}-{name}"
        for b in batches:
            for header, block in zip(b.column(0), b.column(1), strict=True):
                out = out or system.open_output_stream(own, compression=None)
                data = f"{header.as_py()}{block.as_py()}\r\n\r\n".encode()
                out.write(gzip.compress(data, mtime=0) if compression == "gzip" else data)
                n += 1
        if out:
            size = out.tell()
            out.close()
            system.move(own, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], names=["file", "records", "bytes"])

    done = [tuple(r) for r in records.select("header", "block").mapInArrow(run, "file string, records long, bytes long").collect()]  # a row for each file
    system.open_output_stream(f"{folder}/_SUCCESS").close()
    return done
