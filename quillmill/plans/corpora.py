"""Corpora of markdown derived from plain tables, for operators that need structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (module, source_file, file_ord, content): one text each."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("module"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"), F.col("doc_id").alias("file_ord"), F.col("text").alias("content"))


def _gathered(rows: DataFrame, key: str, order: str, part: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(order, part)))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[part]), "\n\n").alias("body"))


def books(spark: SparkSession, sf_dir: str, shelf: int = 50) -> DataFrame:
    """documents in books of ``shelf`` consecutive ids: a title and a section for each.

    Books are of bounded size, so grouping never gathers a whole source.
    """
    docs = table(spark, sf_dir, "documents").withColumn("book", F.expr(f"doc_id div {shelf}"))
    part = F.concat(F.lit("## Doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"))
    found = _gathered(docs.withColumn("part", part), "book", "doc_id", "part")
    return found.select(F.lit("books").alias("module"), F.concat(F.lit("book"), F.col("book").cast("string"), F.lit(".md")).alias("source_file"), F.col("book").alias("file_ord"),
                        F.concat(F.lit("# Book "), F.col("book").cast("string"), F.lit("\n\n"), F.col("body")).alias("content"))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as texts of level-3 sections, one for each turn."""
    part = F.concat(F.lit("### "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.col("text"))
    found = _gathered(table(spark, sf_dir, "conversations").withColumn("part", part), "conv_id", "turn", "part")
    return found.select(F.lit("talks").alias("module"), F.concat(F.lit("talk"), F.col("conv_id").cast("string"), F.lit(".md")).alias("source_file"), F.col("conv_id").alias("file_ord"), F.col("body").alias("content"))


def volumes(spark: SparkSession, sf_dir: str, shelf: int = 10) -> DataFrame:
    """conversations in volumes of ``shelf`` consecutive ids: a section for each, a level below for each turn."""
    turn = F.concat(F.lit("### "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.col("text"))
    talk = _gathered(table(spark, sf_dir, "conversations").withColumn("part", turn), "conv_id", "turn", "part")
    talk = talk.withColumn("volume", F.expr(f"conv_id div {shelf}")).withColumn("part", F.concat(F.lit("## Talk "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.col("body")))
    found = _gathered(talk, "volume", "conv_id", "part")
    return found.select(F.lit("volumes").alias("module"), F.concat(F.lit("volume"), F.col("volume").cast("string"), F.lit(".md")).alias("source_file"), F.col("volume").alias("file_ord"),
                        F.concat(F.lit("# Volume "), F.col("volume").cast("string"), F.lit("\n\n"), F.col("body")).alias("content"))


def glossary(spark: SparkSession, sf_dir: str, page: int = 100) -> DataFrame:
    """part as pages of bold definitions."""
    parts = table(spark, sf_dir, "part").withColumn("page", F.expr(f"p_partkey div {page}"))
    line = F.concat(F.lit("**"), F.col("p_name"), F.lit("**: "), F.col("p_type"), F.lit(" of "), F.col("p_brand"), F.lit("\nSize "), F.col("p_size").cast("string"))
    found = _gathered(parts.withColumn("part", line), "page", "p_partkey", "part")
    return found.select(F.lit("glossary").alias("module"), F.concat(F.lit("page"), F.col("page").cast("string"), F.lit(".md")).alias("source_file"), F.col("page").alias("file_ord"), F.col("body").alias("content"))


# the same in DuckDB SQL
SQL = {
    "plain": "SELECT source AS module, 'doc' || doc_id || '.md' AS source_file, doc_id AS file_ord, text AS content FROM documents",
    "books": "SELECT 'books' AS module, 'book' || (doc_id // 50) || '.md' AS source_file, doc_id // 50 AS file_ord, '# Book ' || (doc_id // 50) || chr(10) || chr(10) || string_agg('## Doc ' || doc_id || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY doc_id // 50",
    "talks": "SELECT 'talks' AS module, 'talk' || conv_id || '.md' AS source_file, conv_id AS file_ord, string_agg('### ' || role || ' ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id",
    "volumes": "SELECT 'volumes' AS module, 'volume' || (conv_id // 10) || '.md' AS source_file, conv_id // 10 AS file_ord, '# Volume ' || (conv_id // 10) || chr(10) || chr(10) || string_agg('## Talk ' || conv_id || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY conv_id) AS content FROM (SELECT conv_id, string_agg('### ' || role || ' ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id) GROUP BY conv_id // 10",
    "glossary": "SELECT 'glossary' AS module, 'page' || (p_partkey // 100) || '.md' AS source_file, p_partkey // 100 AS file_ord, string_agg('**' || p_name || '**: ' || p_type || ' of ' || p_brand || chr(10) || 'Size ' || p_size, chr(10) || chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_partkey // 100",
}
