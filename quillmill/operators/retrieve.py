"""Retrieval over chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(chunks: DataFrame, query: str, *, order: list[str], most: int | None = 5, cut: int = 500, module: str | None = None) -> DataFrame:
    """Chunks that hold the query, whatever its case, in file order; ``module`` prunes partitions."""
    found = chunks.where(F.lower("content").contains(query.lower()))
    found = found.where(F.col("module") == module) if module is not None else found
    found = found.withColumn("content", F.substring("content", 1, cut)).orderBy(*order)
    return found.limit(most) if most is not None else found


def with_code(chunks: DataFrame, language: str | None = None) -> DataFrame:
    """Chunks with code, in the language or in one that is not named."""
    m = F.col("metadata")
    return chunks.where(m.has_code & (F.lit(language is None) | m.language.isNull() | (m.language == language)))


def neighbours(rows: DataFrame, keys: list[str], order: str, text: str = "content", reach: int = 1, joiner: str = "\n\n") -> DataFrame:
    """Each row's text with those of up to ``reach`` rows on either side in its document."""
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn("around", F.array_join(F.collect_list(text).over(around), joiner))


def diversified(rows: DataFrame, document: str, score: Column, most: int, tie: str) -> DataFrame:
    """At most ``most`` rows of each document, those of the highest score."""
    rank = F.row_number().over(Window.partitionBy(document).orderBy(score.desc(), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def changes(old: DataFrame, new: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(key, change): added, removed or changed rows between two tables."""
    a, b = (t.select(key, F.sha2(content, 256).alias(h)) for t, h in ((old, "_a"), (new, "_b")))
    what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, what.alias("change"))
