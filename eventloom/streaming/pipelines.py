"""Streams of events: deduplication, triage, session windows and daily counts.

Each query keeps its place in a checkpoint; sinks are tables that a retried batch writes again in the same place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.dedupe import QuotientTable
from eventloom.operators.triage import triaged
from eventloom.session import shared_dir


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Parquet files of events as a stream; ``files`` limits those of one batch."""
    name = path.rstrip("/").rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name[1]).parquet(name[0])


def run_once(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> DataFrame:
    """Run a stream over all that is there and read its output table.

    The table and the checkpoint lie in the shared folder. In append mode the file sink commits each batch once; in other
    modes every batch replaces the table with the newest result.
    """
    spark = stream.sparkSession
    base = path or f"{shared_dir(spark)}/tables/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    if mode == "append" and write is None:
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(write or (lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def distinct_hashes(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each ``(session_id, dedupe_hash)`` once within a delay of its receipt; the state is bounded by that delay."""
    keyed = stream.where("session_id IS NOT NULL AND dedupe_hash <> ''").select("session_id", "dedupe_hash", F.col("received_at").cast("timestamp").alias("received_at"))
    return keyed.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["session_id", "dedupe_hash"]).select("session_id", "dedupe_hash")


def session_windows(stream: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of each session with no gap as long as ``gap``, given out once the watermark has passed them."""
    timed = stream.where("session_id IS NOT NULL AND ts IS NOT NULL").select("session_id", F.col("ts").cast("timestamp").alias("ts"))
    bursts = timed.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return bursts.select("session_id", F.col("session_window.start").alias("start_at"), F.col("session_window.end").alias("end_at"), "events")


def daily_counts(stream: DataFrame) -> DataFrame:
    """Events of each type and day, for complete mode."""
    timed = stream.where("ts IS NOT NULL").select("type", F.col("ts").cast("timestamp").alias("ts"))
    return timed.groupBy("type", F.window("ts", "1 day")).agg(F.count("*").alias("events")).select("type", F.to_date("window.start").alias("day"), "events")


def triage_stream(stream: DataFrame, path: str) -> DataFrame:
    """Triage events as they come: each id once over all batches, by an exact quotient table; kept events go to a table.

    A batch writes the folder that bears its number, so a batch that is run again replaces its own output. Its new ids
    are held under its number as well, and what an earlier run of the same batch inserted does not count as seen.
    """
    spark = stream.sparkSession
    held = QuotientTable(spark, f"{path}/ids")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        new = held.insert(batch.withColumn("key", F.lower(F.btrim("id"))), "key", str(number))
        fresh = batch.withColumn("key", F.lower(F.btrim("id"))).join(new, "key").groupBy("key").agg(F.min("delivery_seq").alias("delivery_seq"))
        kept = triaged(batch.join(fresh.select("delivery_seq"), "delivery_seq", "left_semi")).where("action <> 'discard'")
        kept.select("delivery_seq", "id", "session_id", "type", "rank", "action", "tokens").write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        batch.unpersist()

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")
