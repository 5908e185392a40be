"""Incremental runs as streams: counts of events, changed documents."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk


def shared(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="quillmill-")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_counts(spark: SparkSession, sf_dir: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by window and type of all events, streamed once from the table's files.

    A batch writes the counts it changed, under its number; of each count the latest holds.
    State is dropped behind the watermark.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    at = shared(spark)
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = counts.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n")
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/out/batch={k}")
    rows.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.schema("start long, event_type string, n long, batch long").parquet(f"{at}/out")
    return changed.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def chunk_changes(spark: SparkSession, source: str, schema, out: str, checkpoint: str, *, done: str, **options) -> None:
    """Chunk documents that arrive under ``source`` and differ from their last version in ``done(source_file, hash)``.

    Each batch writes chunks under its number, partitioned by module, and then the hashes; a
    batch that is run again after a failure finds its hashes missing and repeats, so nothing
    is lost. Of several versions of a file in one batch that of the largest hash counts.
    ``current`` reads the chunks of last versions.
    """

    def run(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("hash", F.sha2("content", 256))
        one = hashed.groupBy("source_file").agg(F.max("hash").alias("hash"))
        if _exists(spark, done):
            seen = _latest(spark.read.schema(DONE).parquet(done).where(F.col("batch") != number)).drop("batch")
            one = one.join(seen, ["source_file", "hash"], "left_anti")
        new = hashed.join(one, ["source_file", "hash"]).dropDuplicates(["source_file"])
        chunk.chunk(new, **options).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "module").parquet(out)
        one.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(done)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


DONE = "source_file string, hash string, batch long"


def _latest(done: DataFrame) -> DataFrame:
    return done.groupBy("source_file").agg(F.max_by("hash", "batch").alias("hash"), F.max("batch").alias("batch"))


def current(spark: SparkSession, out: str, *, done: str) -> DataFrame:
    """Chunks of the last version of each document."""
    last = _latest(spark.read.schema(DONE).parquet(done)).select("source_file", "batch")
    return spark.read.parquet(out).join(last, ["source_file", "batch"]).drop("batch")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
