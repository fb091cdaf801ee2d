"""Queries of event triage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import triage
from eventloom.operators.metrics import newest_of_each


#: A folder that the planted ignore rule leaves out.
IGNORED = "(?:^|/)node_modules/"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/session_events.parquet")


def triage_dedupe(spark, sf_dir):
    """Deliveries that stay after a duplicate hash in a session is dropped."""
    return triage.first_of_hash(_events(spark, sf_dir))


def triage_excluded(spark, sf_dir):
    """Events that a sensitive path excludes."""
    return _events(spark, sf_dir).where(triage.sensitive()).select("delivery_seq", F.col("payload.path").alias("path"))


def triage_trim(spark, sf_dir):
    """Long texts as head and tail, with their length and hash."""
    text = F.col("payload.text")
    return _events(spark, sf_dir).where(F.length(text) > 400).select(
        "delivery_seq", T.trimmed(text, 400).alias("text"), F.length(text).cast("bigint").alias("original_chars"), F.sha2(text, 256).alias("original_hash")
    )


def triage_redact(spark, sf_dir):
    """Secrets masked in a text to which each event's own hash is added under a secret's name."""
    text = F.concat(T.event_text(), F.lit("\nAPI_TOKEN="), F.coalesce("dedupe_hash", F.lit("")), F.lit(" https://bot:"), F.col("id"), F.lit("@host/x"))
    return _events(spark, sf_dir).select(
        "delivery_seq", T.redact_secrets(text).alias("text"), T.count_secrets(text).cast("bigint").alias("masked")
    )


def triage_redact_args(spark, sf_dir):
    """Secrets masked by their name in arguments, to which each event's own hash is added under such names."""
    args = F.concat(F.lit('{"apiKey": "'), F.coalesce("dedupe_hash", F.lit("")), F.lit('", "in": {"Session-Id":"'), F.col("session_id"), F.lit('", "args": '), F.col("payload.args"), F.lit("}}"))
    return _events(spark, sf_dir).where("payload.args IS NOT NULL").select("delivery_seq", T.redact_json(args).alias("args"))


def triage_classify(spark, sf_dir):
    """The importance that an event's type and text give it."""
    return _events(spark, sf_dir).select("delivery_seq", "type", triage.inferred_importance().alias("inferred"))


def triage_route(spark, sf_dir):
    """The action and final importance rank of each event."""
    return triage.triaged(_events(spark, sf_dir)).select("delivery_seq", "rank", "action", "tokens")


def triage_decisions(spark, sf_dir):
    """The whole triage of events to which sensitive and ignored paths and each event's own id under a secret's name are added."""
    seq, path = F.col("delivery_seq"), F.col("payload.path")
    planted = F.when(seq % 5 == 0, F.regexp_replace(path, "[^/]+$", ".env.local")).when(seq % 7 == 0, F.concat(F.lit("node_modules/"), path)).otherwise(path)
    output = F.when(seq % 3 == 0, F.concat("payload.output", F.lit(" API_TOKEN="), "id")).otherwise(F.col("payload.output"))
    events = _events(spark, sf_dir).withColumn("payload", F.col("payload").withField("path", planted).withField("output", output))
    return triage.decided(events, 120, IGNORED).select("delivery_seq", "action", "rank", F.array_join("reasons", ",").alias("reasons"), "tokens", F.length("payload.output").cast("bigint").alias("kept"))


def ingest_statistics(spark, sf_dir):
    """Events by action and importance."""
    return triage.triaged(_events(spark, sf_dir)).groupBy("action", "rank").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def unchanged_files(spark, sf_dir):
    """File changes whose content is the one known before."""
    return triage.unchanged_files(_events(spark, sf_dir))


def token_estimate(spark, sf_dir):
    """Estimated tokens of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.estimated_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def pending_summary(spark, sf_dir):
    """Queued events of each session: count, tokens, highest importance, and whether a compaction request is the newest of them."""
    queued = triage.triaged(_events(spark, sf_dir)).where("action = 'persist_and_queue' AND session_id IS NOT NULL")
    asked = F.max(F.when(F.col("type") == "COMPACTION_REQUESTED", F.col("delivery_seq")))
    spoken = F.max(F.when(F.col("type") == "ASSISTANT_MESSAGE", F.col("delivery_seq")))
    return queued.groupBy("session_id").agg(
        F.count("*").alias("pending"), F.sum("tokens").alias("tokens"), F.max("rank").alias("highest"),
        F.coalesce(asked > F.coalesce(spoken, F.lit(-1)), F.lit(False)).alias("compaction_live"),
    )


def file_index(spark, sf_dir):
    """The newest known hash of every path."""
    seen = _events(spark, sf_dir).where("type = 'FILE_CHANGED' AND payload.path IS NOT NULL")
    return seen.groupBy(F.col("payload.path").alias("path")).agg(
        F.max_by("payload.content_hash", "delivery_seq").alias("content_hash"), F.max("ts").alias("last_seen"), F.count("*").alias("changes")
    )


def shed_queue(spark, sf_dir, cap: int = 3):
    """Low and ephemeral queued or kept events of each session beyond the newest ``cap``.

    The place of the last one that stays is found among the newest few of each map task; all before it are shed."""
    low = triage.triaged(_events(spark, sf_dir)).where("action <> 'discard' AND rank <= 1 AND session_id IS NOT NULL").select("delivery_seq", "session_id")
    newest = newest_of_each(low, "session_id", [F.desc("delivery_seq")], cap)
    kept = newest.groupBy("session_id").agg(F.min("delivery_seq").alias("oldest"), F.count("*").alias("n")).where(F.col("n") == cap)
    return low.join(kept, "session_id").where("delivery_seq < oldest").select("delivery_seq", "session_id")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


_TEXT = "concat_ws(chr(10), nullif(payload.text, ''), nullif(payload.command, ''), nullif(payload.output, ''), nullif(payload.error, ''))"
_SENSITIVE = (
    f"(coalesce({_has('payload.path', T.SENSITIVE_PATH)}, false) OR "
    f"coalesce(len(list_filter(payload.paths, lambda p: coalesce({_has('p', T.SENSITIVE_PATH)}, false))) > 0, false))"
)
_MILESTONE = f"(coalesce(payload.exit_code = 0, false) AND {_has('coalesce(payload.command, chr(32))', T.MILESTONE)} AND NOT {_has('coalesce(payload.command, chr(32))', T.DRY_RUN)})"
_OUT = "coalesce(payload.output, '')"
_INFERRED = f"""CASE
    WHEN type IN ('CONSTRAINT_CHANGED', 'REQUIREMENT_CHANGED', 'ARCHITECTURE_CHANGED', 'DECISION_DETECTED') THEN 'critical'
    WHEN type = 'USER_MESSAGE' THEN CASE WHEN {_has('t', T.CONSTRAINT)} AND NOT {_has('t', T.PASTED_TERMINAL)} THEN 'critical' ELSE 'high' END
    WHEN type = 'ASSISTANT_MESSAGE' THEN CASE WHEN {_has('t', T.DECISION)} OR {_has('t', T.DISCOVERY)} THEN 'high' ELSE 'medium' END
    WHEN type IN ('ERROR_DETECTED', 'TASK_STARTED', 'TASK_COMPLETED', 'COMPACTION_REQUESTED') THEN 'high'
    WHEN type = 'FILE_CHANGED' THEN 'medium'
    WHEN type = 'COMMAND_EXECUTED' THEN CASE WHEN coalesce(payload.exit_code <> 0, false) OR {_MILESTONE} OR {_has('t', T.ERROR)} THEN 'high'
        WHEN {_has(_OUT, T.BENIGN)} THEN 'ephemeral' ELSE 'low' END
    WHEN type = 'TOOL_CALL' THEN 'low'
    WHEN type = 'TOOL_RESULT' THEN CASE WHEN {_has('t', T.ERROR)} THEN 'medium' WHEN {_OUT} = '' OR {_has(_OUT, T.BENIGN)} THEN 'ephemeral' ELSE 'low' END
    WHEN type IN ('SESSION_STARTED', 'SESSION_ENDED') THEN 'low' ELSE 'medium' END"""
_RANK = "list_position(['ephemeral', 'low', 'medium', 'high', 'critical'], {0}) - 1"
_UNITS = "octet_length(encode({0})) "


def _tokens(text: str) -> str:
    """A quarter of the UTF-16 units: characters, and one more for each beyond the basic plane."""
    beyond = f"length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
    return f"CAST(ceil((length({text}) + {beyond}) / 4.0) AS BIGINT)"


_TRIAGED = f"""texted AS (SELECT *, {_TEXT} AS t FROM session_events),
    inferred AS (SELECT *, {_INFERRED} AS inferred FROM texted),
    ranked AS (SELECT *, CAST(greatest(CASE WHEN importance_source = 'adapter' THEN {_RANK.format('importance')} END, {_RANK.format('inferred')}) AS INT) AS rank,
        {_tokens('t')} AS tokens FROM inferred),
    triaged AS (SELECT *, CASE WHEN {_SENSITIVE} OR rank = 0 THEN 'discard'
        WHEN type IN ('USER_MESSAGE', 'DECISION_DETECTED', 'CONSTRAINT_CHANGED', 'REQUIREMENT_CHANGED', 'ARCHITECTURE_CHANGED',
            'COMPACTION_REQUESTED', 'ERROR_DETECTED', 'TASK_STARTED', 'TASK_COMPLETED')
          OR (type = 'ASSISTANT_MESSAGE' AND ({_has('t', T.DECISION)} OR {_has('t', T.DISCOVERY)} OR length(trim(t, ' ')) >= {triage.SUBSTANCE}))
          OR (type = 'COMMAND_EXECUTED' AND {_MILESTONE}) THEN 'persist_and_queue' ELSE 'persist' END AS action FROM ranked)"""


def _redacted_args() -> str:
    text = """('{"apiKey": "' || coalesce(dedupe_hash, '') || '", "in": {"Session-Id":"' || session_id || '", "args": ' || payload.args || '}}')"""
    text = f"regexp_replace({text}, {_q(T.SECRET_VALUE)}, {_q(chr(92) + '1' + chr(34) + T.MASK + chr(34))}, 'g')"
    for pattern, left in T.SECRETS:
        text = f"regexp_replace({text}, {_q(T.re2(pattern))}, {_q(left.replace('$', chr(92)))}, 'g')"
    return f"SELECT delivery_seq, {text} AS args FROM session_events WHERE payload.args IS NOT NULL"


def _redaction() -> tuple[str, str]:
    text = f"({_TEXT} || chr(10) || 'API_TOKEN=' || coalesce(dedupe_hash, '') || ' https://bot:' || id || '@host/x')"
    step, masked = "SELECT delivery_seq, " + text + " AS t0 FROM session_events", []
    for k, (pattern, left) in enumerate(T.SECRETS):
        left = left.replace("$1", "\\1").replace("$2", "\\2")
        step = f"SELECT *, regexp_replace(t{k}, {_q(T.re2(pattern))}, {_q(left)}, 'g') AS t{k + 1} FROM ({step})"
        masked.append(f"len(regexp_extract_all(t{k}, {_q(T.re2(pattern))}))")
    return step, " + ".join(masked)


_STEPS, _MASKED = _redaction()

def _masked(text: str) -> str:
    for pattern, left in T.SECRETS:
        text = f"regexp_replace({text}, {_q(T.re2(pattern))}, {_q(left.replace('$', chr(92)))}, 'g')"
    return text


def _cut(text: str, most: int) -> str:
    head, tail = int(most * 0.6), int(most * 0.3)
    return f"CASE WHEN length({text}) > {most} THEN left({text}, {head}) || chr(10) || '... [' || (length({text}) - {head + tail}) || ' chars cut] ...' || chr(10) || right({text}, {tail}) ELSE {text} END"


def _decisions(most: int = 120) -> str:
    fields = ("text", "output", "error", "command", "args")
    cut = ", ".join(f"{_cut(f'payload.{n}', most) if n in triage.TRIMMED else f'payload.{n}'} AS c_{n}" for n in fields)
    named = f"regexp_replace(c_args, {_q(T.SECRET_VALUE)}, {_q(chr(92) + '1' + chr(34) + T.MASK + chr(34))}, 'g')"
    masked = ", ".join(f"{_masked(named if n == 'args' else f'c_{n}')} AS m_{n}" for n in fields)
    paths = "list_filter(list_concat([payload.path], coalesce(payload.paths, [])), lambda p: p IS NOT NULL)"
    bad = f"list_filter({paths}, lambda p: {_has(chr(112), T.SENSITIVE_PATH)} OR {_has(chr(112), IGNORED)})[1]"
    level = "['ephemeral', 'low', 'medium', 'high', 'critical'][rank + 1]"
    return f"""
        WITH planted AS (
            SELECT * REPLACE (struct_update(payload,
                path := CASE WHEN delivery_seq % 5 = 0 THEN regexp_replace(payload.path, '[^/]+$', '.env.local') WHEN delivery_seq % 7 = 0 THEN 'node_modules/' || payload.path ELSE payload.path END,
                output := CASE WHEN delivery_seq % 3 = 0 THEN payload.output || ' API_TOKEN=' || id ELSE payload.output END) AS payload) FROM session_events),
        shortened AS (SELECT *, {bad} AS bad, {cut}, greatest({", ".join(f"coalesce(length(payload.{n}) > {most}, false)" for n in triage.TRIMMED)}) AS cut FROM planted),
        hidden AS (SELECT *, {masked} FROM shortened),
        clean AS (SELECT * REPLACE (struct_update(payload, {", ".join(f"{n} := m_{n}" for n in fields)}) AS payload), {" OR ".join(f"m_{n} IS DISTINCT FROM c_{n}" for n in fields)} AS hid,
            coalesce(dedupe_hash, '') <> '' AND session_id IS NOT NULL AND row_number() OVER (PARTITION BY session_id, dedupe_hash ORDER BY delivery_seq) > 1 AS again FROM hidden),
        files AS (
            SELECT delivery_seq, payload.content_hash = lag(payload.content_hash) OVER (PARTITION BY payload.path ORDER BY delivery_seq) AS same FROM clean
            WHERE NOT again AND bad IS NULL AND type = 'FILE_CHANGED' AND payload.path IS NOT NULL AND payload.content_hash IS NOT NULL),
        {_TRIAGED.replace('FROM session_events)', 'FROM clean)')},
        judged AS (SELECT t.*, coalesce(f.same, false) AS same, {level} AS level FROM triaged t LEFT JOIN files f USING (delivery_seq)),
        told AS (SELECT *, CASE WHEN level IS DISTINCT FROM importance THEN 'reclassified:' || coalesce(importance, '') || '->' || level END AS re FROM judged)
        SELECT delivery_seq, CASE WHEN again OR bad IS NOT NULL OR same THEN 'discard' ELSE action END AS action, CASE WHEN again OR bad IS NOT NULL OR same THEN 0 ELSE rank END AS rank,
               CASE WHEN again THEN 'duplicate_event' WHEN bad IS NOT NULL THEN 'excluded_path:' || bad
                    WHEN same THEN concat_ws(',', CASE WHEN cut THEN 'payload_truncated' END, CASE WHEN hid THEN 'redacted' END, 'file_unchanged')
                    ELSE concat_ws(',', CASE WHEN cut THEN 'payload_truncated' END, CASE WHEN hid THEN 'redacted' END, re,
                        CASE WHEN rank = 0 THEN 'ephemeral_no_residue' WHEN action = 'persist_and_queue' THEN 'needs_semantics' ELSE 'deterministic_only' END) END AS reasons,
               CASE WHEN again OR bad IS NOT NULL OR same THEN 0 ELSE tokens END AS tokens, CAST(length(payload.output) AS BIGINT) AS kept
        FROM told"""


QUERIES = {
    f.__name__: f
    for f in (
        triage_dedupe, triage_excluded, triage_trim, triage_redact, triage_redact_args, triage_classify, triage_route, triage_decisions, ingest_statistics, unchanged_files,
        token_estimate, pending_summary, file_index, shed_queue,
    )
}
SQL = {
    "triage_dedupe": """
        SELECT min(delivery_seq) AS delivery_seq FROM session_events WHERE session_id IS NOT NULL AND dedupe_hash <> ''
        GROUP BY session_id, dedupe_hash
        UNION ALL SELECT delivery_seq FROM session_events WHERE session_id IS NULL OR coalesce(dedupe_hash, '') = ''""",
    "triage_excluded": f"SELECT delivery_seq, payload.path AS path FROM session_events WHERE {_SENSITIVE}",
    "triage_trim": """
        SELECT delivery_seq, left(t, 240) || chr(10) || '... [' || (length(t) - 360) || ' chars cut] ...' || chr(10) || right(t, 120) AS text,
               CAST(length(t) AS BIGINT) AS original_chars, sha256(t) AS original_hash
        FROM (SELECT delivery_seq, payload.text AS t FROM session_events) WHERE length(t) > 400""",
    "triage_redact": f"SELECT delivery_seq, t{len(T.SECRETS)} AS text, CAST({_MASKED} AS BIGINT) AS masked FROM ({_STEPS})",
    "triage_redact_args": _redacted_args(),
    "triage_decisions": _decisions(),
    "triage_classify": f"WITH {_TRIAGED} SELECT delivery_seq, type, inferred FROM triaged",
    "triage_route": f"WITH {_TRIAGED} SELECT delivery_seq, rank, action, tokens FROM triaged",
    "ingest_statistics": f"WITH {_TRIAGED} SELECT action, rank, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM triaged GROUP BY action, rank",
    "unchanged_files": """
        SELECT delivery_seq, path, content_hash FROM (
            SELECT delivery_seq, payload.path AS path, payload.content_hash AS content_hash,
                   lag(payload.content_hash) OVER (PARTITION BY session_id, payload.path ORDER BY delivery_seq) AS before
            FROM session_events WHERE type = 'FILE_CHANGED' AND payload.path IS NOT NULL AND payload.content_hash IS NOT NULL)
        WHERE before = content_hash""",
    "token_estimate": f"SELECT doc_id, {_tokens('t')} AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "pending_summary": f"""
        WITH {_TRIAGED}
        SELECT session_id, count(*) AS pending, CAST(sum(tokens) AS BIGINT) AS tokens, max(rank) AS highest,
               coalesce(max(delivery_seq) FILTER (type = 'COMPACTION_REQUESTED')
                        > coalesce(max(delivery_seq) FILTER (type = 'ASSISTANT_MESSAGE'), -1), false) AS compaction_live
        FROM triaged WHERE action = 'persist_and_queue' AND session_id IS NOT NULL GROUP BY session_id""",
    "file_index": """
        SELECT payload.path AS path, arg_max(payload.content_hash, delivery_seq) AS content_hash, max(ts) AS last_seen, count(*) AS changes
        FROM session_events WHERE type = 'FILE_CHANGED' AND payload.path IS NOT NULL GROUP BY payload.path""",
    "shed_queue": f"""
        WITH {_TRIAGED}
        SELECT delivery_seq, session_id FROM (
            SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY delivery_seq DESC) AS newest FROM triaged
            WHERE action <> 'discard' AND rank <= 1 AND session_id IS NOT NULL) WHERE newest > 3""",
}
