"""What a corpus's documents tell about it: strategies, name, description, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import count_tokens

# fixed values: what the choice of a strategy counts
H2, H34, BOLD = r"(?md)^## .+", r"(?md)^#{3,4} .+", r"\*\*[^*]+\*\*\s*[:—–-]"


def strategy_of(text: Column | str, limit: int = 500, tokens: Column | None = None) -> Column:
    """fixed for a text that fits, else by its headings and bold definitions."""
    c = T.col(text)
    # a text without a pattern's fixed part is not searched for the pattern
    h2, h34, bold = (F.when(F.contains(c, F.lit(mark)), F.regexp_count(c, F.lit(p))).otherwise(0) for mark, p in (("## ", H2), ("### ", H34), ("**", BOLD)))
    n = tokens if tokens is not None else count_tokens(c)
    return (F.when(n <= limit, "fixed").when((bold >= 3) & (bold > h2), "definition").when((h34 >= 3) & (h34 > 2 * h2), "definition")
            .when(h2 >= 2, "heading").otherwise("fixed"))


def majority_strategy(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The most frequent strategy; ties go to the one met first in file order."""
    by = by or []
    counts = docs.groupBy(*by, "strategy").agg(F.count("*").alias("n"), F.min("file_ord").alias("first"))
    best = F.max_by("strategy", F.struct("n", -F.col("first"))).alias("strategy")
    found = counts.groupBy(*by).agg(best)
    return found if by else found.select(F.coalesce("strategy", F.lit("heading")).alias("strategy"))


def overrides(docs: DataFrame) -> DataFrame:
    """Documents whose strategy is not the majority's."""
    main = majority_strategy(docs).select(F.col("strategy").alias("main"))
    return docs.join(F.broadcast(main), F.col("strategy") != F.col("main")).drop("main")  # one row


def document_frequency(docs: DataFrame, text: str = "content") -> DataFrame:
    """term, docs: in how many documents' headings and bold spans a term stands."""
    return docs.select(F.explode(T.tag_terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


def tags(docs: DataFrame, text: str = "content", override: str | None = None, most: int = 5) -> list[str]:
    """The terms of the most documents, at least two; none if there are not two of them."""
    if override:
        return [t.strip() for t in override.split(",") if t.strip()]
    rows = document_frequency(docs, text).where("docs >= 2").orderBy(F.desc("docs"), "term").limit(most).collect()
    return [r["term"] for r in rows] if len(rows) >= 2 else []


def description(docs: DataFrame, default: str, text: str = "content") -> DataFrame:
    """The first document's level-1 heading that is no file name, or the default."""
    h1 = T.strip(F.regexp_extract(text, r"(?md)^# (.+)", 1))
    found = docs.select("file_ord", h1.alias("h1")).where((F.length("h1") > 0) & ~T.is_file_artifact("h1"))
    return found.agg(F.coalesce(F.min_by("h1", "file_ord"), F.lit(default)).alias("description"))


def chunk_statistics(chunks: DataFrame, tokens: Column | str = "token_count", small: int = 30) -> DataFrame:
    n = T.col(tokens)
    return chunks.agg(F.count("*").alias("chunks"), F.max(n).alias("max_tokens"), F.min(n).alias("min_tokens"), F.count_if(n < small).alias("small_chunks"))
