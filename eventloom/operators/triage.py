"""Deterministic triage of events: exclude, trim, redact, classify and route, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators.metrics import running_last

#: Characters from which the text of an assistant has substance, and from which a field is trimmed.
SUBSTANCE = 150
MOST_CHARS = 4000


def sensitive(payload: str = "payload") -> Column:
    """Whether any path of a payload must not be read."""
    one = lambda p: F.coalesce(F.replace(p, F.lit("\\"), F.lit("/")).rlike(T.SENSITIVE_PATH), F.lit(False))
    return one(F.col(f"{payload}.path")) | F.coalesce(F.exists(f"{payload}.paths", one), F.lit(False))


def milestone(payload: str = "payload") -> Column:
    command = F.coalesce(F.col(f"{payload}.command"), F.lit(""))
    return F.coalesce(F.col(f"{payload}.exit_code") == 0, F.lit(False)) & command.rlike(T.MILESTONE) & ~command.rlike(T.DRY_RUN)


def inferred_importance(kind: str = "type", payload: str = "payload") -> Column:
    """The importance of an event from its type and text."""
    text, what = T.event_text(payload), F.col(kind)
    output = F.coalesce(F.col(f"{payload}.output"), F.lit(""))
    user = F.when(text.rlike(T.CONSTRAINT) & ~text.rlike(T.PASTED_TERMINAL), "critical").otherwise("high")
    assistant = F.when(text.rlike(T.DECISION) | text.rlike(T.DISCOVERY), "high").otherwise("medium")
    failed = F.coalesce(F.col(f"{payload}.exit_code") != 0, F.lit(False))
    command = F.when(failed | milestone(payload) | text.rlike(T.ERROR), "high").when(output.rlike(T.BENIGN), "ephemeral").otherwise("low")
    result = F.when(text.rlike(T.ERROR), "medium").when((output == "") | output.rlike(T.BENIGN), "ephemeral").otherwise("low")
    return (
        F.when(what.isin("CONSTRAINT_CHANGED", "REQUIREMENT_CHANGED", "ARCHITECTURE_CHANGED", "DECISION_DETECTED"), "critical")
        .when(what == "USER_MESSAGE", user)
        .when(what == "ASSISTANT_MESSAGE", assistant)
        .when(what.isin("ERROR_DETECTED", "TASK_STARTED", "TASK_COMPLETED", "COMPACTION_REQUESTED"), "high")
        .when(what == "FILE_CHANGED", "medium")
        .when(what == "COMMAND_EXECUTED", command)
        .when(what == "TOOL_CALL", "low")
        .when(what == "TOOL_RESULT", result)
        .when(what.isin("SESSION_STARTED", "SESSION_ENDED"), "low")
        .otherwise("medium")
    )


def needs_reading(kind: str = "type", payload: str = "payload") -> Column:
    """Whether an event has meaning that rules cannot settle."""
    text, what = T.event_text(payload), F.col(kind)
    said = text.rlike(T.DECISION) | text.rlike(T.DISCOVERY) | (F.length(F.trim(text)) >= SUBSTANCE)
    return (
        what.isin(
            "USER_MESSAGE", "DECISION_DETECTED", "CONSTRAINT_CHANGED", "REQUIREMENT_CHANGED", "ARCHITECTURE_CHANGED",
            "COMPACTION_REQUESTED", "ERROR_DETECTED", "TASK_STARTED", "TASK_COMPLETED",
        )
        | ((what == "ASSISTANT_MESSAGE") & said)
        | ((what == "COMMAND_EXECUTED") & milestone(payload))
    )


def triaged(events: DataFrame) -> DataFrame:
    """Events with ``inferred``, ``rank``, ``action`` and ``tokens``.

    An adapter's claim can raise the inferred importance, never lower it. Sensitive paths and ephemeral events are
    discarded, the rest is kept, and kept and queued if it needs reading. One pass without shuffle.
    """
    events = events.withColumn("inferred", inferred_importance())
    claim = F.when(F.col("importance_source") == "adapter", T.importance_rank(F.col("importance")))
    rank = F.greatest(claim, T.importance_rank(F.col("inferred")))
    action = F.when(sensitive() | (F.col("rank") == 0), "discard").when(needs_reading(), "persist_and_queue").otherwise("persist")
    return events.withColumn("rank", rank).withColumn("action", action).withColumn("tokens", T.estimated_tokens(T.event_text()))


def first_of_hash(events: DataFrame) -> DataFrame:
    """The first delivery of each ``(session_id, dedupe_hash)`` and every event without a hash; a map-side minimum, so
    a hot hash is no hot task."""
    keyed = events.where(F.col("session_id").isNotNull() & (F.col("dedupe_hash") != ""))
    first = keyed.groupBy("session_id", "dedupe_hash").agg(F.min("delivery_seq").alias("delivery_seq")).select("delivery_seq")
    bare = events.where(F.col("session_id").isNull() | F.coalesce(F.col("dedupe_hash") == "", F.lit(True))).select("delivery_seq")
    return first.unionByName(bare)


def unchanged_files(events: DataFrame) -> DataFrame:
    """File changes that repeat the hash known for their path: ``(delivery_seq, path, content_hash)``, by delivery."""
    seen = events.where((F.col("type") == "FILE_CHANGED") & F.col("payload.path").isNotNull() & F.col("payload.content_hash").isNotNull())
    seen = seen.select("session_id", "delivery_seq", "payload.path", "payload.content_hash")
    seen = running_last(seen, ["session_id", "path"], "delivery_seq", "content_hash", "before")
    return seen.where("before = content_hash").select("delivery_seq", "path", "content_hash")


#: The text fields that are trimmed, and those whose secrets are masked.
TRIMMED = ("text", "output", "error")
MASKED = ("text", "output", "error", "command")


def cleaned(payload: Column, most: int) -> tuple[Column, Column, Column]:
    """A payload with long fields trimmed and then its secrets masked, and whether either changed it."""
    short = {n: T.trimmed(payload[n], most) for n in TRIMMED}
    cut = F.greatest(*[F.coalesce(F.length(payload[n]) > most, F.lit(False)) for n in TRIMMED])
    masked = {n: T.redact_secrets(short.get(n, payload[n])) for n in MASKED} | {"args": T.redact_json(payload["args"])}
    hidden = F.lit(False)
    for n, m in masked.items():
        hidden = hidden | ~m.eqNullSafe(short.get(n, payload[n]))
    for n, m in masked.items():
        payload = payload.withField(n, m)
    return payload, cut, hidden


def excluded_path(payload: str = "payload", ignored: str | None = None) -> Column:
    """The first path of a payload that must not be read, being sensitive or matched by a pattern; null if none is."""
    paths = F.array_compact(F.concat(F.array(f"{payload}.path"), F.coalesce(f"{payload}.paths", F.array().cast("array<string>"))))
    plain = lambda p: F.replace(p, F.lit("\\"), F.lit("/"))
    bad = lambda p: plain(p).rlike(T.SENSITIVE_PATH) | (plain(p).rlike(ignored) if ignored else F.lit(False))
    return F.get(F.filter(paths, bad), 0)


def decided(events: DataFrame, most: int = MOST_CHARS, ignored: str | None = None) -> DataFrame:
    """The whole triage in its order: events with ``action``, ``rank``, ``reasons``, ``tokens`` and the payload to keep.

    Discarded are a repeated hash of a session, then a path that must not be read, then a changed file whose content is the
    one last known for its path, then what is ephemeral. All else is kept, and queued if it needs reading. Importance and
    need are judged on the payload after trimming and masking, and the reasons name each rule that spoke.

    Nulls: an event without session or hash repeats none; missing fields are empty. Hot hashes and paths are pre-aggregated
    or run along ranges.
    """
    first = first_of_hash(events).withColumn("_first", F.lit(True))
    rows = events.join(first, "delivery_seq", "left").withColumn("_bad", excluded_path(ignored=ignored))
    payload, cut, hidden = cleaned(F.col("payload"), most)
    rows = rows.withColumn("_cut", cut).withColumn("_hidden", hidden).withColumn("payload", payload)
    seen = rows.where("_first AND _bad IS NULL AND type = 'FILE_CHANGED' AND payload.path IS NOT NULL AND payload.content_hash IS NOT NULL")
    seen = running_last(seen.select("delivery_seq", "payload.path", "payload.content_hash"), ["path"], "delivery_seq", "content_hash", "before")
    same = seen.where("before = content_hash").select("delivery_seq", F.lit(True).alias("_same"))
    rows = triaged(rows.join(same, "delivery_seq", "left"))
    repeated, unchanged = F.col("_first").isNull(), F.col("_same").isNotNull()
    level = F.get(F.array(*[F.lit(x) for x in T.IMPORTANCE]), F.col("rank"))
    trail = [F.when(F.col("_cut"), "payload_truncated"), F.when(F.col("_hidden"), "redacted")]
    judged = F.when(~level.eqNullSafe(F.col("importance")), F.concat(F.lit("reclassified:"), F.coalesce("importance", F.lit("")), F.lit("->"), level))
    reasons = (
        F.when(repeated, F.array(F.lit("duplicate_event")))
        .when(F.col("_bad").isNotNull(), F.array(F.concat(F.lit("excluded_path:"), "_bad")))
        .when(unchanged, F.array_compact(F.array(*trail, F.lit("file_unchanged"))))
        .when(F.col("rank") == 0, F.array_compact(F.array(*trail, judged, F.lit("ephemeral_no_residue"))))
        .otherwise(F.array_compact(F.array(*trail, judged, F.when(F.col("action") == "persist_and_queue", "needs_semantics").otherwise("deterministic_only"))))
    )
    early = repeated | F.col("_bad").isNotNull()
    action = F.when(early | unchanged, "discard").otherwise(F.col("action"))
    return rows.select(
        "delivery_seq", action.alias("action"), F.when(early | unchanged, 0).otherwise(F.col("rank")).alias("rank"), reasons.alias("reasons"),
        F.when(early | unchanged, F.lit(0).cast("bigint")).otherwise(F.col("tokens")).alias("tokens"), "payload",
    )
