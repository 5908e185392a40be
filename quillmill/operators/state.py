"""State between runs: hashes, freshness, dependencies, the cache of contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import count_tokens


def module_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    """Hash of each module over its files' paths and hashes in path order.

    Only fixed-size hashes meet in a group, so a module may hold any amount of content.
    """
    each = files.select("module", F.split("rel_path", "/").alias("p"), F.sha2(F.concat(F.col("rel_path").cast("binary"), F.lit(b"\0"), F.col(content).cast("binary")), 256).alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "h")))
    return each.groupBy("module").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x.h), ""), 256).alias("source_hash"))


def stale(hashes: DataFrame, meta: DataFrame) -> DataFrame:
    """Modules whose hash is empty or not the recorded one."""
    known = meta.where("source_hash is not null and source_hash != ''").select("module", "source_hash")
    return hashes.join(known, ["module", "source_hash"], "left_anti")


def record(meta: DataFrame, built: DataFrame) -> DataFrame:
    """``meta`` with the rows of ``built(module, source_hash, chunk_count)`` in place of theirs."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fresh = built.select("module", "source_hash", now.alias("built_at"), F.col("chunk_count").cast("long").alias("chunk_count"))
    return meta.join(built.select("module"), "module", "left_anti").select(*fresh.columns).unionByName(fresh)


def unmet_dependencies(modules: DataFrame, installed: DataFrame) -> DataFrame:
    """(module, dependency) for each entry of ``depends_on`` that names no installed module."""
    asked = modules.select("module", F.posexplode("depends_on").alias("pos", "dependency")).withColumn("name", T.parse_dependency("dependency")["name"])
    return asked.join(installed.select(F.col("module").alias("name")).distinct(), "name", "left_anti").select("module", "pos", "dependency")


def contextualize(chunks: DataFrame, cache: DataFrame, model: str, ask: Callable[[str, str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks with a situating context before their content, and what the cache lacked.

    chunks have ``document``. Contexts come from ``cache(key, context, model)``; missing ones
    from ``ask(document, chunk)``, called in Arrow batches.
    """

    @F.pandas_udf("string")
    def asked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for docs, texts in batches:
            yield pd.Series([ask(d, t) for d, t in zip(docs, texts, strict=True)], dtype=object)

    keyed = chunks.withColumn("key", T.cache_key(F.lit(model), "document", "content"))
    hit = keyed.join(cache.select("key", F.col("context").alias("situating_context")), "key", "left")
    new = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    new = new.select("key", (asked("document", "content") if ask else F.lit(None).cast("string")).alias("context"), F.lit(model).alias("model"))
    if ask:
        hit = hit.join(new.select("key", F.col("context").alias("_new")), "key", "left").withColumn("situating_context", F.coalesce("situating_context", "_new")).drop("_new")
    content = F.concat_ws("\n\n", "situating_context", "content")
    out = hit.withColumn("contextualized", F.col("situating_context").isNotNull()).withColumn("content", content)
    return out.withColumn("token_count", count_tokens(F.col("content"))), new
