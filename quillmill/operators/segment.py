"""Documents to segments, natively: one generator per operator, no shuffle.

Each takes a DataFrame with a text column and adds a 0-based ``ord`` and the segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, is_orphan, strip
from ..functions.tokens import pieces

SENTENCE = r"(?U)(?<=[.!?])\s+"
BOLD_TERM = r"^\*\*(.+?)\*\*[:\s—–-]\s*(.*)"


def _exploded(df: DataFrame, parts: Column, name: str) -> DataFrame:
    return df.select("*", F.posexplode(parts).alias("ord", name))


def lines(df: DataFrame, text: str = "text", name: str = "line") -> DataFrame:
    return _exploded(df, F.split(col(text), "\n", -1), name)


def sentences(df: DataFrame, text: str = "text", name: str = "sentence") -> DataFrame:
    return _exploded(df, F.split(col(text), SENTENCE, -1), name)


def paragraphs(df: DataFrame, text: str = "text", name: str = "paragraph") -> DataFrame:
    stripped = F.transform(F.split(col(text), "\n\n", -1), strip)
    return _exploded(df, F.filter(stripped, lambda p: F.length(p) > 0), name)


def heading_parts(text: Column, level: str = "2") -> Column:
    """Array of (heading, content): a preamble with a null heading, if it says anything, and the sections."""
    head = rf"(?md)^#{{{level}}}\s+(.+)$"
    parts = F.split(text, rf"(?md)(?=^#{{{level}}}\s+.+$)", -1)
    named = F.transform(parts, lambda p: F.struct(F.nullif(strip(F.regexp_extract(p, head, 1)), F.lit("")).alias("heading"), strip(p).alias("content")))
    sections = F.filter(named, lambda s: s.heading.isNotNull() | ~is_orphan(s.content))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), text.alias("content")))
    return F.when(text.rlike(head), sections).otherwise(whole)


def heading_sections(df: DataFrame, text: str = "text", level: int = 2) -> DataFrame:
    """Sections at one heading level; a text without any is one section."""
    return _exploded(df, heading_parts(col(text), str(level)), "section").select("*", "section.heading", "section.content").drop("section")


def heading_definitions(df: DataFrame, text: str = "text") -> DataFrame:
    """Blocks under headings of level 3 and 4; what stands before the first is dropped."""
    found = F.filter(heading_parts(col(text), "3,4"), lambda s: s.heading.isNotNull())
    return _exploded(df, found, "d").select("*", F.col("d.heading").alias("term"), F.col("d.content").alias("block")).drop("d")


def bold_definitions(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Blocks from one line ``**term**: ...`` to before the next, by a running count of terms."""
    each = lines(df, text).withColumn("opens", F.col("line").rlike(BOLD_TERM).cast("int"))
    run = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    numbered = each.withColumn("n", F.sum("opens").over(run)).where("n > 0")
    blocks = numbered.groupBy(*keys, "n").agg(
        F.min_by(strip(F.regexp_extract("line", BOLD_TERM, 1)), "ord").alias("term"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x.line), "\n").alias("block"),
    )
    return blocks.select(*keys, (F.col("n") - 1).alias("ord"), "term", strip("block").alias("block"))


def token_windows(df: DataFrame, text: str = "text", width: int = 500, overlap: int = 50) -> DataFrame:
    """A window hopping over the tokens; the last one ends with the text."""
    step = max(width - overlap, 1)
    cut = df.withColumn("_p", pieces(col(text)))
    last = F.greatest(F.size("_p") - F.lit(width), F.lit(0))
    starts = F.sequence(F.lit(0), F.ceil(last / F.lit(step)).cast("int") * F.lit(step), F.lit(step))
    found = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("_p", s + 1, F.lit(width)).alias("w")))
    return (_exploded(cut.where(F.size("_p") > 0), found, "x")
            .select("*", F.col("x.start").alias("start_token"), F.size("x.w").alias("token_count"), F.array_join("x.w", "").alias("window")).drop("x", "_p"))


def without_repeats(df: DataFrame, keys: list[str], value: str = "line", order: str = "ord") -> DataFrame:
    """Rows that differ from the one before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_b", before).where(~F.col(value).eqNullSafe(F.col("_b"))).drop("_b")
