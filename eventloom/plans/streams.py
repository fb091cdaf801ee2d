"""Queries of the streams, run over all files that are there, and their SQL."""

from __future__ import annotations

import uuid

from eventloom.functions import text as T
from eventloom.plans.triage import _TRIAGED, _has
from eventloom.session import shared_dir
from eventloom.sources import files
from eventloom.streaming import pipelines as P


def stream_hashes(spark, sf_dir):
    """Different hashes of the feed, deduplicated in a stream."""
    return P.run_once(P.distinct_hashes(P.event_stream(spark, f"{sf_dir}/session_events.parquet"), "3650 days"), "append")


def stream_bursts(spark, sf_dir):
    """Bursts of sessions that the watermark has passed."""
    return P.run_once(P.session_windows(P.event_stream(spark, f"{sf_dir}/session_events.parquet")), "append")


def stream_daily(spark, sf_dir):
    """Daily counts kept by a stream."""
    return P.run_once(P.daily_counts(P.event_stream(spark, f"{sf_dir}/session_events.parquet")), "complete")


def stream_triage(spark, sf_dir):
    """Kept events of a triage stream with exact deduplication of ids."""
    base = f"{shared_dir(spark)}/tables/triage-{uuid.uuid4().hex}"
    return P.triage_stream(P.event_stream(spark, f"{sf_dir}/session_events.parquet"), base).select("delivery_seq", "rank", "action", "tokens")


def instruction_rules(spark, sf_dir):
    """The rules in the instruction files among the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source = 'instruction_file'")
    return files.instruction_rules(docs, "doc_id", "text")


QUERIES = {f.__name__: f for f in (stream_hashes, stream_bursts, stream_daily, stream_triage, instruction_rules)}

SQL = {
    "stream_hashes": "SELECT DISTINCT session_id, dedupe_hash FROM session_events WHERE session_id IS NOT NULL AND dedupe_hash <> ''",
    "stream_bursts": """
        WITH e AS (SELECT session_id, ts FROM session_events WHERE session_id IS NOT NULL AND ts IS NOT NULL),
        m AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 10 MINUTES, true) AS first FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
        b AS (SELECT session_id, min(ts) AS start_at, max(ts) + INTERVAL 10 MINUTES AS end_at, count(*) AS events FROM (
            SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM m) GROUP BY session_id, burst)
        SELECT session_id, CAST(start_at AS TIMESTAMPTZ) AS start_at, CAST(end_at AS TIMESTAMPTZ) AS end_at, events FROM b
        WHERE end_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e)""",
    "stream_daily": "SELECT type, CAST(ts AS DATE) AS day, count(*) AS events FROM session_events WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_triage": f"""
        WITH {_TRIAGED}
        SELECT delivery_seq, rank, action, tokens FROM triaged WHERE action <> 'discard' AND delivery_seq IN (
            SELECT min(delivery_seq) FROM session_events WHERE id IS NOT NULL GROUP BY lower(trim(id, ' ')))""",
    "instruction_rules": f"""
        WITH bare AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)\\A---\\n.*?\\n---\\n', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS t
            FROM documents WHERE source = 'instruction_file' AND doc_id IS NOT NULL AND text IS NOT NULL),
        lines AS (SELECT doc_id, unnest(l) AS raw, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line FROM (SELECT doc_id, regexp_split_to_array(t, '\\r?\\n') AS l FROM bare)),
        marked AS (
            SELECT *, regexp_matches(raw, '^\\s*```') AS fence, regexp_matches(raw, '^#{{1,6}} ') AS heading,
                   sum(CASE WHEN regexp_matches(raw, '^\\s*```') THEN 1 ELSE 0 END) OVER w AS fences,
                   last_value(CASE WHEN regexp_matches(raw, '^#{{1,6}} ') THEN trim(regexp_replace(raw, '^#{{1,6}} ', ''), ' ') END IGNORE NULLS) OVER w AS section
            FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
        ruled AS (SELECT *, trim(regexp_replace(raw, '^\\s*(?:[-*+]|[0-9]+[.)]|\\[ \\])\\s+', ''), ' ') AS rule FROM marked WHERE fences % 2 = 0 AND NOT fence AND NOT heading)
        SELECT doc_id, line, section, rule,
               CASE WHEN {_has('rule', T.CONSTRAINT)} THEN 'constraints' WHEN {_has('rule', T.DECISION)} THEN 'decisions' ELSE 'conventions' END AS category
        FROM ruled WHERE length(rule) >= 12""",
}
