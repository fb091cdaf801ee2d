"""Queries of event and item views and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import projections as P
from eventloom.operators import triage
from eventloom.plans.triage import _MILESTONE, _TRIAGED
from eventloom.plans.triage import pending_summary as _pending

NEWEST, PER_SESSION, TOOLS, AHEAD, SESSIONS, RULES, MINUTES, CHARS = 5, 20, 40, 100, 20, 5, 30, 200
COUNT, TOKENS, FLOOR = 40, 8000, "critical"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pending_queue(spark, sf_dir):
    """The first queued events of each session."""
    return P.pending_queue(triage.triaged(_read(spark, sf_dir, "session_events")), PER_SESSION)


def recent_events(spark, sf_dir):
    """The newest events of each session of at least medium importance."""
    return P.recent_events(triage.triaged(_read(spark, sf_dir, "session_events")), NEWEST, "medium")


def recent_tool_events(spark, sf_dir):
    """The last tool events of each session before its newest batch."""
    return P.recent_tool_events(_read(spark, sf_dir, "session_events"), TOOLS)


def tool_events_after(spark, sf_dir):
    """The first tool events and answers of each session that come over half an hour after its start."""
    sessions = _read(spark, sf_dir, "agent_sessions").where("id IS NOT NULL AND started_at IS NOT NULL")
    marks = sessions.select(F.col("id").alias("session_id"), (F.col("started_at") + F.expr("INTERVAL 30 MINUTES")).alias("after"))
    return P.tool_events_after(_read(spark, sf_dir, "session_events"), marks, AHEAD)


def session_traffic(spark, sf_dir):
    """The traffic of the newest sessions."""
    return P.session_traffic(_read(spark, sf_dir, "session_events"), SESSIONS)


def recovery_rules(spark, sf_dir):
    """Rules about paths and commands, and whether a failed command or changed path of the feed is what they are about."""
    rules = P.recovery_rules(_read(spark, sf_dir, "memory_items"))
    events = _read(spark, sf_dir, "session_events")
    seen = events.select(F.explode(F.array("payload.path", "payload.command")).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("seen"))
    return rules.join(seen, "key", "left").select("kind", "key", "id", F.coalesce("seen", F.lit(0)).alias("seen"))


def capped_rules(spark, sf_dir):
    """Active items and whether too many rules hold them back."""
    return P.capped_rules(_read(spark, sf_dir, "memory_items"), RULES)


def issues_of_events(spark, sf_dir):
    """Open issues by the events that they come from, and the type of the event where it is known."""
    kinds = _read(spark, sf_dir, "session_events").groupBy(F.col("id").alias("event_id")).agg(F.min("type").alias("type"))
    return P.issues_of_events(_read(spark, sf_dir, "memory_items")).join(kinds, "event_id", "left").select("event_id", "id", "type")


def milestones(spark, sf_dir):
    """The newest milestones of each session."""
    return P.milestones(_read(spark, sf_dir, "session_events"), 50)


def active_sessions(spark, sf_dir):
    """The session that each source is most likely in."""
    return P.active_sessions(_read(spark, sf_dir, "session_events"), MINUTES)


def event_previews(spark, sf_dir):
    """The start of each event's text."""
    return P.previews(_read(spark, sf_dir, "session_events"), CHARS)


def trigger_verdicts(spark, sf_dir):
    """Which sessions' queues ask for work."""
    totals = _read(spark, sf_dir, "session_events").where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("events"))
    return P.trigger_verdicts(_pending(spark, sf_dir), totals, COUNT, TOKENS, FLOOR)


def merged_items(spark, sf_dir):
    """Items after those with evidence are given anew with a lower or higher count of retrievals."""
    held = _read(spark, sf_dir, "memory_items").where("id IS NOT NULL")
    given = held.where("size(evidence) > 0").withColumn("retrieved_count", (F.length(F.coalesce("text", F.lit(""))) % 7).cast("int")).withColumn("status", F.lit("active"))
    return P.merged_items(held, given).select("id", "status", "retrieved_count")


def inert_events(spark, sf_dir):
    """Kept events that nothing waits for and no item comes from."""
    return P.inert_events(triage.triaged(_read(spark, sf_dir, "session_events")), _read(spark, sf_dir, "memory_items"))


QUERIES = {
    f.__name__: f
    for f in (
        inert_events, pending_queue, recent_events, recent_tool_events, tool_events_after, session_traffic, recovery_rules, capped_rules, issues_of_events, milestones,
        active_sessions, event_previews, trigger_verdicts, merged_items,
    )
}

_TOOLS = ", ".join(f"'{x}'" for x in P.TOOL_TYPES)
_OPEN = "NOT coalesce(source = 'user' AND importance = 'critical', false)"
SQL = {
    "pending_queue": f"""
        WITH {_TRIAGED}
        SELECT session_id, delivery_seq, CAST(k AS INT) AS place FROM (
            SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, ordinal NULLS FIRST, delivery_seq) AS k FROM triaged
            WHERE action = 'persist_and_queue' AND session_id IS NOT NULL AND ts IS NOT NULL) WHERE k <= {PER_SESSION}""",
    "recent_events": f"""
        WITH {_TRIAGED}
        SELECT session_id, delivery_seq FROM (
            SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, delivery_seq DESC) AS k FROM triaged
            WHERE action <> 'discard' AND rank >= 2 AND session_id IS NOT NULL AND ts IS NOT NULL) WHERE k <= {NEWEST}""",
    "recent_tool_events": f"""
        WITH newest AS (SELECT session_id, max(batch_id) AS b FROM session_events WHERE session_id IS NOT NULL GROUP BY session_id),
        ranked AS (
            SELECT e.*, row_number() OVER (PARTITION BY e.session_id ORDER BY ts DESC, delivery_seq DESC) AS k FROM session_events e
            WHERE type IN ({_TOOLS}) AND session_id IS NOT NULL AND ts IS NOT NULL AND NOT EXISTS (
                SELECT 1 FROM session_events x JOIN newest n ON n.session_id = x.session_id AND n.b = x.batch_id WHERE x.session_id = e.session_id AND x.id = e.id))
        SELECT session_id, delivery_seq, CAST(row_number() OVER (PARTITION BY session_id ORDER BY k DESC) AS INT) AS place FROM ranked WHERE k <= {TOOLS}""",
    "tool_events_after": f"""
        SELECT session_id, delivery_seq, CAST(k AS INT) AS place FROM (
            SELECT e.session_id, e.delivery_seq, row_number() OVER (PARTITION BY e.session_id ORDER BY e.ts, e.ordinal NULLS FIRST, e.delivery_seq) AS k
            FROM session_events e LEFT JOIN agent_sessions s ON s.id = e.session_id
            WHERE e.type IN ({_TOOLS}, 'ASSISTANT_MESSAGE') AND e.session_id IS NOT NULL AND e.ts IS NOT NULL
              AND (s.started_at IS NULL OR e.ts > s.started_at + INTERVAL 30 MINUTES)) WHERE k <= {AHEAD}""",
    "session_traffic": f"""
        SELECT session_id, delivery_seq, type FROM session_events WHERE type IN ({_TOOLS}, 'USER_MESSAGE') AND ts IS NOT NULL AND session_id IN (
            SELECT session_id FROM session_events WHERE session_id IS NOT NULL AND ts IS NOT NULL GROUP BY session_id
            ORDER BY max(ts) DESC, session_id LIMIT {SESSIONS})""",
    "recovery_rules": f"""
        WITH keyed AS (
            SELECT id, unnest([{{'kind': 'path', 'key': fields['path']}}, {{'kind': 'command', 'key': fields['command']}}]) AS f FROM memory_items
            WHERE status IN ('active', 'stale') AND id IS NOT NULL AND {_OPEN}),
        keys AS (SELECT payload.path AS key FROM session_events UNION ALL SELECT payload.command FROM session_events)
        SELECT f.kind AS kind, f.key AS key, id, (SELECT count(*) FROM keys k WHERE k.key = f.key) AS seen FROM keyed WHERE f.key <> ''""",
    "capped_rules": f"""
        WITH rows AS (
            SELECT id, category, coalesce(fields['path'], fields['command'], '') <> '' AS rule, coalesce(last_validated_at, updated_at, created_at) AS moment
            FROM memory_items WHERE status = 'active' AND category IS NOT NULL)
        SELECT id, category, rule AND row_number() OVER (PARTITION BY category, rule ORDER BY moment DESC NULLS LAST, id) > {RULES} AS held FROM rows""",
    "issues_of_events": f"""
        WITH named AS (
            SELECT id, unnest(evidence) AS event_id FROM memory_items
            WHERE category = 'known_issues' AND status = 'active' AND {_OPEN} AND fields['closed_at'] IS NULL)
        SELECT event_id, min(n.id) AS id, (SELECT min(type) FROM session_events e WHERE e.id = n.event_id) AS type
        FROM named n WHERE event_id IS NOT NULL GROUP BY event_id""",
    "milestones": f"""
        SELECT session_id, delivery_seq, command, subject FROM (
            SELECT session_id, delivery_seq, payload.command AS command,
                   nullif(regexp_extract(coalesce(payload.output, ''), '(?m)^\\[[^\\]]+\\][ \\t]*(\\S.*)$', 1), '') AS subject,
                   row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, delivery_seq DESC) AS k
            FROM session_events WHERE type = 'COMMAND_EXECUTED' AND {_MILESTONE} AND session_id IS NOT NULL AND ts IS NOT NULL) WHERE k <= 50""",
    "active_sessions": f"""
        WITH newest AS (
            SELECT source, max(ts) AS ts, arg_max(session_id, (ts, delivery_seq)) AS session_id FROM session_events
            WHERE session_id IS NOT NULL AND ts IS NOT NULL AND source IS NOT NULL GROUP BY source)
        SELECT source, session_id FROM newest WHERE (SELECT max(ts) FROM newest) - ts <= INTERVAL {MINUTES} MINUTES""",
    "event_previews": f"""
        SELECT delivery_seq, left(coalesce({', '.join(f"CASE WHEN trim(payload.{x}, ' ') <> '' THEN payload.{x} END" for x in ('text', 'command', 'output', 'error', 'path'))}), {CHARS}) AS preview
        FROM session_events""",
    "trigger_verdicts": f"""
        WITH {_TRIAGED}, pending AS (
            SELECT session_id, count(*) AS pending, sum(tokens) AS tokens, max(rank) AS highest,
                   coalesce(max(delivery_seq) FILTER (type = 'COMPACTION_REQUESTED') > coalesce(max(delivery_seq) FILTER (type = 'ASSISTANT_MESSAGE'), -1), false) AS compaction
            FROM triaged WHERE action = 'persist_and_queue' AND session_id IS NOT NULL GROUP BY session_id),
        sized AS (
            SELECT p.*, CASE WHEN n < 200 THEN 1.0 WHEN n < 1000 THEN 1.5 WHEN n < 3000 THEN 2.5 ELSE 4.0 END AS scale
            FROM pending p JOIN (SELECT session_id, count(*) AS n FROM session_events GROUP BY session_id) t ON t.session_id = p.session_id),
        told AS (
            SELECT session_id, CASE WHEN compaction THEN 'compaction' WHEN highest >= 4 THEN 'importance' WHEN pending >= ceil(scale * {COUNT}) THEN 'events'
                WHEN tokens >= ceil(scale * {TOKENS}) THEN 'tokens' ELSE 'below' END AS reason FROM sized)
        SELECT session_id, reason <> 'below' AS fire, reason FROM told""",
    "merged_items": """
        SELECT id, CASE WHEN len(evidence) > 0 THEN 'active' ELSE status END AS status,
               CASE WHEN len(evidence) > 0 THEN greatest(CAST(length(coalesce(text, '')) % 7 AS INT), retrieved_count) ELSE retrieved_count END AS retrieved_count
        FROM memory_items WHERE id IS NOT NULL""",
    "inert_events": f"""
        WITH {_TRIAGED}
        SELECT delivery_seq, id FROM triaged WHERE action = 'persist' AND id IS NOT NULL
          AND id NOT IN (SELECT e FROM (SELECT unnest(evidence) AS e FROM memory_items) WHERE e IS NOT NULL)""",
}
