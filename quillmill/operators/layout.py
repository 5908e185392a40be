"""Markdown from lines of a page layout, by their font sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAIN, MINOR = 1.4, 1.15  # fixed values: sizes of headings in body sizes


def body_sizes(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, body): the most frequent size of each document, the smaller one in a tie."""
    counts = lines.groupBy(doc, "size").agg(F.count("*").alias("n"))
    return counts.groupBy(doc).agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def to_markdown(lines: DataFrame, doc: str = "doc", title: str = "title") -> DataFrame:
    """(doc, markdown) of ``lines(doc, title, page, ord, size, text)``.

    A line equal to the one before is a repeated header and goes. Larger lines are headings;
    the body lines up to the next heading follow on the heading's line, those before the
    first heading make a paragraph of their own.
    """
    order = Window.partitionBy(doc).orderBy("page", "ord")
    kept = lines.withColumn("_b", F.lag("text").over(order)).where(~F.col("text").eqNullSafe(F.col("_b")))
    sized = kept.join(body_sizes(lines, doc), doc)
    mark = F.when(F.col("size") >= F.col("body") * MAIN, "\n## ").when(F.col("size") >= F.col("body") * MINOR, "\n### ")
    marked = sized.withColumn("_m", mark).withColumn("_g", F.count("_m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.groupBy(doc, title, "_g").agg(
        F.concat(F.coalesce(F.min("_m"), F.lit("")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))), lambda x: x.text), " ")).alias("_t")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_g", "_t"))), lambda x: x["_t"]), "\n")
    return parts.groupBy(doc, title).agg(F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), joined, F.lit("\n")).alias("markdown")).select(doc, "markdown")
