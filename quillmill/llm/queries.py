"""The ten operators bound to the tables of the checks, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embed_dedup, langid, minhash, mixing, packing, pii, sql, toxicity, url_filter, warc

TOP, END_ID = 4096, 2
SHARE, EPOCHS, SEED = 0.5, 2, 7
# fixed values: target weights by level and name, 1 where none is given
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 1}, "source": {}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def levels():
    """Domain (a source's number modulo 4), language, source."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def _dealt(folds: int):
    """The fold of a document; a null id is in none, so it is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_ID, top=TOP)


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")), keep=("page_id",))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.select_documents(table(spark, sf_dir, "documents"), levels(), WEIGHTS, share=SHARE, epochs=EPOCHS, seed=SEED)
    return out.select("doc_id", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"), F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"))


def op6_block_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _dealt(5) == 0
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, chain).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.start, s.stop)), ",").alias("spans"))


def op8_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _dealt(4) == 2
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_packing, op2_bagminhash, op3_link_propagation, op4_warc_derivatives, op5_mixing, op6_block_matrix_join, op7_toxicity_crf, op8_word_backoff, op9_hyperplane_dedup, op10_pii)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_link_propagation": sql.link_propagation(url_filter.RULES, url_filter.LINK, damping=0.85, threshold=0.5),
        "op4_warc_derivatives": sql.warc_derivatives(),
        "op5_mixing": sql.mixing(WEIGHTS, SHARE, EPOCHS, SEED),
        "op6_block_matrix_join": sql.nearest(20),
        "op9_hyperplane_dedup": sql.embedding_duplicates(0.95),
        "op10_pii": sql.personal_data(),
    }
