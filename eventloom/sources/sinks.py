"""Writing events and state: idempotent appends, exports and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventloom.operators.dedupe import QuotientTable


def event_identity(events: DataFrame) -> Column:
    """What an event is known by in a table: its session and non-empty hash, else its id, else all that it holds."""
    by_hash = F.when(F.col("dedupe_hash") != "", F.concat(F.lit("h"), F.length("session_id").cast("string"), F.lit(":"), "session_id", "dedupe_hash"))
    whole = F.sha2(F.to_json(F.struct(*[F.col(c) for c in events.columns])), 256)
    by_id = [F.concat(F.lit("i"), "id")] if "id" in events.columns else []
    return F.coalesce(by_hash, *by_id, F.concat(F.lit("r"), whole))


def append_new_events(events: DataFrame, path: str, batch: str | None = None, order: str = "delivery_seq") -> int:
    """Append the events that the table at ``path`` lacks, in folders by batch and day; returns how many.

    An event is known by ``event_identity``, so one without hash or session is known by its id and is never folded into
    another; of several in a batch the first in ``order`` stays. Identities lie in an exact quotient table beside the events.
    Writing the same events again appends none. A batch may be run again under its name: it replaces what it wrote.
    """
    batch, seen = batch or uuid.uuid4().hex, Observation()
    named = events.withColumn("_identity", event_identity(events))
    new = QuotientTable(events.sparkSession, f"{path}/_known").insert(named, "_identity", batch).select(F.col("_identity").alias("_known"))
    fresh = named.join(new, F.col("_identity") == F.col("_known"), "left_semi")
    if order in events.columns:
        fresh = fresh.groupBy("_identity").agg(F.min_by(F.struct(*[F.col(c) for c in events.columns]), order).alias("e")).select("e.*")
    else:
        fresh = fresh.dropDuplicates(["_identity"]).drop("_identity")
    fresh = fresh.withColumn("day", F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date"))).observe(seen, F.count("*").alias("n"))
    fresh.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")
    return seen.get["n"]


def export_state(items: DataFrame, patches: DataFrame, sessions: DataFrame, path: str) -> None:
    """Items, patches and sessions as JSON lines in three folders."""
    for name, df in (("items", items), ("patches", patches), ("sessions", sessions)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def kept_by_retention(events: DataFrame, as_of: str, days: int, processed: str = "processed_at") -> DataFrame:
    """The events that stay: not yet processed, or not older than ``days``."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return events.where(F.col(processed).isNull() | F.coalesce(F.col("ts").cast("timestamp") >= limit, F.lit(True)))
