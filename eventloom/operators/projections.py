"""Views of an event feed and of memory items by session, category or key, ordered by one total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators.metrics import newest_of_each
from eventloom.operators.state import closed, protected
from eventloom.operators.triage import milestone

#: The event types that tool calls leave.
TOOL_TYPES = ("TOOL_CALL", "FILE_CHANGED", "TOOL_RESULT", "ERROR_DETECTED", "COMMAND_EXECUTED")


def oldest_first() -> list[Column]:
    return [F.col("ts").asc(), F.col("ordinal").asc_nulls_first(), F.col("delivery_seq").asc()]


def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("delivery_seq").desc()]


def pending_queue(triaged: DataFrame, n: int) -> DataFrame:
    """The first ``n`` queued events of each session: ``session_id, delivery_seq, place``. Events without time wait."""
    queued = triaged.where("action = 'persist_and_queue' AND session_id IS NOT NULL AND ts IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*oldest_first()))
    return queued.select("session_id", "delivery_seq", "ts", "ordinal").withColumn("place", place).where(F.col("place") <= n).drop("ts", "ordinal")


def recent_events(triaged: DataFrame, n: int, floor: str) -> DataFrame:
    """The newest ``n`` events of each session that are kept and have at least an importance: ``session_id, delivery_seq``."""
    kept = triaged.where((F.col("action") != "discard") & (F.col("rank") >= T.IMPORTANCE.index(floor)) & F.col("session_id").isNotNull() & F.col("ts").isNotNull())
    return newest_of_each(kept.select("session_id", "delivery_seq", "ts"), "session_id", newest_first(), n).select("session_id", "delivery_seq")


def recent_tool_events(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` tool events of each session before its newest batch, oldest first: ``session_id, delivery_seq, place``.

    Events of that batch are left out by their id, wherever they were delivered before.
    """
    tools = events.where(F.col("type").isin(*TOOL_TYPES) & F.col("session_id").isNotNull() & F.col("ts").isNotNull())
    newest = events.where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("batch_id").alias("batch_id"))
    batch = events.select("session_id", "batch_id", "id").join(newest, ["session_id", "batch_id"]).select("session_id", "id").distinct()
    before = tools.select("session_id", "delivery_seq", "ts", "id").join(batch, ["session_id", "id"], "left_anti")
    last = newest_of_each(before, "session_id", newest_first(), n)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "delivery_seq"))
    return last.select("session_id", "delivery_seq", place.alias("place"))


def tool_events_after(events: DataFrame, marks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` tool events and answers of each session after its watermark: ``session_id, delivery_seq, place``.

    ``marks`` has ``session_id, after``; a session without mark is read from its start.
    """
    wanted = events.where(F.col("type").isin(*TOOL_TYPES, "ASSISTANT_MESSAGE") & F.col("session_id").isNotNull() & F.col("ts").isNotNull())
    wanted = wanted.select("session_id", "delivery_seq", "ts", "ordinal").join(marks, "session_id", "left").where("after IS NULL OR ts > after")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*oldest_first()))
    return wanted.withColumn("place", place).where(F.col("place") <= n).select("session_id", "delivery_seq", "place")


def session_traffic(events: DataFrame, sessions: int) -> DataFrame:
    """Tool events and user messages of the newest ``sessions`` sessions: ``session_id, delivery_seq, type``."""
    timed = events.where("session_id IS NOT NULL AND ts IS NOT NULL")
    newest = timed.groupBy("session_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "session_id").limit(sessions).select("session_id")
    wanted = timed.where(F.col("type").isin(*TOOL_TYPES, "USER_MESSAGE")).select("session_id", "delivery_seq", "type")
    return wanted.join(F.broadcast(newest), "session_id", "left_semi")  # at most ``sessions`` rows


def recovery_rules(items: DataFrame) -> DataFrame:
    """Rules about a wrong path or command that may still be rewritten, by what they are about: ``kind, key, id, created_at``."""
    fields = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fields").getItem(k).alias("key")) for k in ("path", "command")])).alias("f")
    open_items = items.where(F.col("status").isin("active", "stale") & ~protected() & F.col("id").isNotNull())
    return open_items.select("id", "created_at", fields).where("f.key <> ''").select("f.kind", "f.key", "id", "created_at")


def capped_rules(items: DataFrame, most: int) -> DataFrame:
    """Active items with whether a category's list holds them back: ``id, category, held``. All that are no rules stay, and of
    the rules of a category those last validated, changed or created."""
    rule = (F.coalesce(F.col("fields").getItem("path"), F.col("fields").getItem("command"), F.lit("")) != "").alias("rule")
    rows = items.where("status = 'active' AND category IS NOT NULL").select("id", "category", rule, F.coalesce("last_validated_at", "updated_at", "created_at").alias("at"))
    kept = newest_of_each(rows.where("rule"), "category", [F.desc_nulls_last("at"), F.col("id")], most).select("id", F.lit(True).alias("kept"))
    return rows.join(kept, "id", "left").select("id", "category", (F.col("rule") & F.col("kept").isNull()).alias("held"))


def issues_of_events(items: DataFrame) -> DataFrame:
    """The first open known issue that names each event as its evidence: ``event_id, id``."""
    issues = items.where((F.col("category") == "known_issues") & (F.col("status") == "active") & ~protected() & ~F.coalesce(closed(), F.lit(False)))
    return issues.select("id", F.explode("evidence").alias("event_id")).where("event_id IS NOT NULL").groupBy("event_id").agg(F.min("id").alias("id"))


def milestones(events: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` successful milestone commands of each session: ``session_id, delivery_seq, command, subject``; the
    subject is what follows the first bracket at a line's start of the output."""
    rows = events.where((F.col("type") == "COMMAND_EXECUTED") & milestone() & F.col("session_id").isNotNull() & F.col("ts").isNotNull())
    subject = F.nullif(F.regexp_extract(F.coalesce("payload.output", F.lit("")), r"(?m)^\[[^\]]+\][ \t]*(\S.*)$", 1), F.lit(""))
    rows = rows.select("session_id", "delivery_seq", "ts", F.col("payload.command").alias("command"), subject.alias("subject"))
    return newest_of_each(rows, "session_id", newest_first(), n).drop("ts")


def active_sessions(events: DataFrame, minutes: int) -> DataFrame:
    """The session of each source's newest event, if it is within ``minutes`` of the newest of all: ``source, session_id``."""
    timed = events.where("session_id IS NOT NULL AND ts IS NOT NULL AND source IS NOT NULL")
    newest = timed.groupBy("source").agg(F.max(F.struct("ts", "delivery_seq", "session_id")).alias("e"))
    top = F.max("e.ts").over(Window.partitionBy(F.lit(1)))  # a row for each source
    seconds = F.unix_micros(top.cast("timestamp")) - F.unix_micros(F.col("e.ts").cast("timestamp"))
    return newest.withColumn("behind", seconds).where(F.col("behind") <= minutes * 60_000_000).select("source", "e.session_id")


def previews(events: DataFrame, chars: int) -> DataFrame:
    """The start of the first field of each event that has text: ``delivery_seq, preview``; null if none has."""
    parts = [F.when(F.trim(f"payload.{x}") != "", F.col(f"payload.{x}")) for x in ("text", "command", "output", "error", "path")]
    return events.select("delivery_seq", F.substring(F.coalesce(*parts), 1, chars).alias("preview"))


def trigger_verdicts(pending: DataFrame, totals: DataFrame, count: int, tokens: int, floor: str) -> DataFrame:
    """Whether a session's queue asks for work, and why: ``session_id, fire, reason``.

    ``pending`` has ``session_id, pending, tokens, highest, compaction_live``, ``totals`` ``session_id, events``. The limits
    grow with the length of the session, at 200, 1,000 and 3,000 events.
    """
    n = F.coalesce("events", F.lit(0))
    scale = F.when(n < 200, 1.0).when(n < 1000, 1.5).when(n < 3000, 2.5).otherwise(4.0)
    reason = (
        F.when(F.col("compaction_live"), "compaction")
        .when(F.col("highest") >= T.IMPORTANCE.index(floor), "importance")
        .when(F.col("pending") >= F.ceil(scale * count), "events")
        .when(F.col("tokens") >= F.ceil(scale * tokens), "tokens")
        .otherwise("below")
    )
    return pending.join(totals, "session_id", "left").select("session_id", (reason != "below").alias("fire"), reason.alias("reason"))


def merged_items(held: DataFrame, given: DataFrame) -> DataFrame:
    """Items after an upsert: ``given`` wins whole over ``held`` by id, but a count of retrievals never falls."""
    old = held.select(F.col("id").alias("_id"), F.col("retrieved_count").alias("_count"))
    new = given.join(old, F.col("id") == F.col("_id"), "left").withColumn("retrieved_count", F.greatest("retrieved_count", "_count")).drop("_id", "_count")
    return new.unionByName(held.join(given.select("id"), "id", "left_anti"))


def inert_events(triaged: DataFrame, items: DataFrame) -> DataFrame:
    """Events that are kept without a need to be read and that no item names as its evidence: ``delivery_seq, id``."""
    named = items.select(F.explode("evidence").alias("id")).where("id IS NOT NULL").distinct()
    return triaged.where("action = 'persist' AND id IS NOT NULL").select("delivery_seq", "id").join(named, "id", "left_anti").select("delivery_seq", "id")
