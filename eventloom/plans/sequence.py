"""Queries of sequence mining and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import sequence as S
from eventloom.operators import similarity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def call_outcomes(spark, sf_dir):
    """Tool calls with their first outcome."""
    return S.call_outcomes(_read(spark, sf_dir, "session_events"))


def command_attempts(spark, sf_dir):
    """Commands with their place among their session's attempts."""
    return S.command_attempts(_read(spark, sf_dir, "session_events")).select("session_id", "delivery_seq", "i", "ok", S.program(F.col("command")).alias("program"))


def command_recoveries(spark, sf_dir):
    """Failed commands and the related success that followed."""
    return S.recoveries(_read(spark, sf_dir, "session_events"))


def repeated_calls(spark, sf_dir):
    """Runs of the same command with the same answer."""
    return S.repeated_calls(_read(spark, sf_dir, "session_events"), least=2)


def error_classes(spark, sf_dir):
    """How often each kind of error line stands in outputs and errors."""
    rows = _read(spark, sf_dir, "session_events").select(S.error_class(F.coalesce("payload.error", "payload.output")).alias("error_class"))
    return rows.where("error_class IS NOT NULL").groupBy("error_class").agg(F.count("*").alias("n"))


def path_references(spark, sf_dir):
    """Paths that memory items name."""
    return S.path_references(_read(spark, sf_dir, "memory_items"))


def stale_references(spark, sf_dir):
    """Items whose paths no file change of the feed has."""
    files = _read(spark, sf_dir, "session_events").where("payload.path IS NOT NULL").select(F.col("payload.path").alias("path"))
    return S.stale_references(_read(spark, sf_dir, "memory_items"), files)


def restatements(spark, sf_dir):
    """Different statements of one category with nearly the same words."""
    return similarity.restatements(_read(spark, sf_dir, "memory_items"), 0.8, by_words=True)


def recovery_notes(spark, sf_dir):
    """What the assistant said last between a failure and its recovery."""
    events = _read(spark, sf_dir, "session_events")
    return S.latest_notes(events, S.recoveries(events))


def episodes(spark, sf_dir):
    """Failures with the related success that resolved them."""
    return S.episodes(_read(spark, sf_dir, "session_events"))


QUERIES = {
    f.__name__: f
    for f in (episodes, call_outcomes, command_attempts, command_recoveries, repeated_calls, error_classes, path_references, stale_references, restatements, recovery_notes)
}

_ATTEMPTS = """attempts AS (
    SELECT session_id, delivery_seq, row_number() OVER (PARTITION BY session_id ORDER BY delivery_seq) AS i, payload.command AS command, payload.exit_code = 0 AS ok
    FROM session_events WHERE type = 'COMMAND_EXECUTED' AND session_id IS NOT NULL AND payload.command IS NOT NULL AND payload.exit_code IS NOT NULL)"""
_RECOVERIES = f"""{_ATTEMPTS}, found AS (
    SELECT *, last_value(CASE WHEN NOT ok THEN {{'q': delivery_seq, 'c': command}} END IGNORE NULLS)
        OVER (PARTITION BY session_id ORDER BY delivery_seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f FROM attempts),
    pairs AS (
        SELECT session_id, f.q AS failed_seq, f.c AS failed, delivery_seq, command FROM found
        WHERE ok AND f IS NOT NULL AND f.c <> command AND regexp_extract(f.c, '^\\s*(\\S+)', 1) = regexp_extract(command, '^\\s*(\\S+)', 1)
          AND (levenshtein(f.c, command) <= 0.4 * greatest(length(f.c), length(command))
               OR list_has_any(list_filter(regexp_split_to_array(f.c, '\\s+'), lambda w: length(w) >= 5), list_filter(regexp_split_to_array(command, '\\s+'), lambda w: length(w) >= 5)))),
    recoveries AS (SELECT session_id, failed_seq, failed, min(delivery_seq) AS fixed_seq, arg_min(command, delivery_seq) AS fixed FROM pairs GROUP BY ALL)"""
_REFS = f"SELECT id, unnest(list_distinct(regexp_extract_all(text, '{S.PATH}'))) AS path FROM memory_items WHERE id IS NOT NULL"
SQL = {
    "call_outcomes": """
        WITH calls AS (
            SELECT session_id, payload.tool_use_id AS tool_use_id, min(delivery_seq) AS call_seq, arg_min(payload.tool, delivery_seq) AS tool FROM session_events
            WHERE type IN ('TOOL_CALL', 'FILE_CHANGED') AND session_id IS NOT NULL AND payload.tool_use_id IS NOT NULL GROUP BY ALL)
        SELECT c.session_id, c.tool_use_id, call_seq, tool, min(delivery_seq) AS outcome_seq, arg_min(type = 'TOOL_RESULT', delivery_seq) AS ok
        FROM calls c JOIN session_events e ON e.session_id = c.session_id AND e.payload.tool_use_id = c.tool_use_id
        WHERE e.type IN ('TOOL_RESULT', 'ERROR_DETECTED') AND delivery_seq > call_seq GROUP BY c.session_id, c.tool_use_id, call_seq, tool""",
    "command_attempts": f"WITH {_ATTEMPTS} SELECT session_id, delivery_seq, CAST(i AS BIGINT) AS i, ok, regexp_extract(command, '^\\s*(\\S+)', 1) AS program FROM attempts",
    "command_recoveries": f"WITH {_RECOVERIES} SELECT session_id, failed_seq, failed, fixed_seq, fixed FROM recoveries",
    "repeated_calls": """
        WITH rows_ AS (
            SELECT session_id, delivery_seq, CASE WHEN type = 'COMMAND_EXECUTED' THEN payload.command END AS call, nullif(payload.output, '') AS answer,
                   row_number() OVER w AS i, sum(CASE WHEN type = 'FILE_CHANGED' THEN 1 ELSE 0 END) OVER w AS epoch
            FROM session_events WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY delivery_seq)),
        marked AS (
            SELECT *, coalesce(i - lag(i) OVER s > 15 OR epoch <> lag(epoch) OVER s, true) AS apart FROM rows_ WHERE call IS NOT NULL
            WINDOW s AS (PARTITION BY session_id, call ORDER BY delivery_seq)),
        islands AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY session_id, call ORDER BY delivery_seq) AS island FROM marked),
        turned AS (
            SELECT *, coalesce(CAST(answer <> last_value(answer IGNORE NULLS) OVER (PARTITION BY session_id, call, island ORDER BY delivery_seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT), 0) AS turn FROM islands),
        runs AS (
            SELECT session_id, call, island, run, count(*) AS repeats, min(delivery_seq) AS first_seq FROM (
                SELECT *, sum(turn) OVER (PARTITION BY session_id, call, island ORDER BY delivery_seq) AS run FROM turned) GROUP BY ALL)
        SELECT session_id, call, repeats, first_seq FROM (
            SELECT *, row_number() OVER (PARTITION BY session_id, call ORDER BY repeats DESC, first_seq) AS k FROM runs WHERE repeats >= 2) WHERE k = 1""",
    "error_classes": f"""
        SELECT error_class, count(*) AS n FROM (
            SELECT left(trim(regexp_replace(list_filter(string_split(coalesce(payload.error, payload.output), chr(10))[1:40],
                lambda x: regexp_matches(x, '{S.ERROR_LINE}'))[1], '[0-9]+', 'N', 'g'), ' '), 80) AS error_class FROM session_events)
        WHERE error_class IS NOT NULL GROUP BY error_class""",
    "path_references": _REFS,
    "stale_references": f"""
        SELECT n.id, count(*) AS named, count(f.path) AS present, count(f.path) = 0 AS stale FROM ({_REFS}) n
        LEFT JOIN (SELECT DISTINCT payload.path AS path FROM session_events WHERE payload.path IS NOT NULL) f ON f.path = n.path GROUP BY n.id""",
    "restatements": """
        WITH plain AS (
            SELECT id, category, trim(regexp_replace(regexp_replace(lower(text), '\\[[^\\]]*\\]', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') AS p
            FROM memory_items WHERE category IS NOT NULL AND text IS NOT NULL),
        said AS (
            SELECT id, category, list_distinct(string_split(p, ' ')) AS g
            FROM (SELECT category, p, min(id) AS id FROM plain WHERE p <> '' GROUP BY category, p)),
        pairs AS (
            SELECT a.id AS id_a, b.id AS id_b, len(a.g) AS n, len(b.g) AS m, len(list_intersect(a.g, b.g)) AS k
            FROM said a JOIN said b ON a.category = b.category AND a.id < b.id
            WHERE least(len(a.g), len(b.g)) >= 0.8 * greatest(len(a.g), len(b.g)) - 1e-9)
        SELECT id_a, id_b, round(k / (n + m - k), 6) AS similarity FROM pairs WHERE k / (n + m - k) >= 0.8 - 1e-9""",
    "recovery_notes": f"""
        WITH {_RECOVERIES}
        SELECT failed_seq, max(delivery_seq) AS note_seq FROM recoveries r JOIN session_events e ON e.session_id = r.session_id
        WHERE e.type = 'ASSISTANT_MESSAGE' AND length(e.payload.text) >= 20 AND delivery_seq > failed_seq AND delivery_seq < fixed_seq GROUP BY failed_seq""",
    "episodes": f"""
        WITH {_ATTEMPTS}, met AS (
            SELECT f.session_id, f.delivery_seq, f.i, w.i AS place, w.delivery_seq AS fixed_seq FROM attempts f JOIN attempts w
            ON w.session_id = f.session_id AND w.i BETWEEN f.i + 1 AND f.i + {S.AHEAD}
            WHERE NOT f.ok AND w.ok AND regexp_extract(f.command, '^\\s*(\\S+)', 1) = regexp_extract(w.command, '^\\s*(\\S+)', 1)
              AND (levenshtein(f.command, w.command) <= 0.4 * greatest(length(f.command), length(w.command))
                   OR list_has_any(list_filter(regexp_split_to_array(f.command, '\\s+'), lambda x: length(x) >= 5), list_filter(regexp_split_to_array(w.command, '\\s+'), lambda x: length(x) >= 5)))),
        first AS (SELECT session_id, delivery_seq, i, min(place) AS place, arg_min(fixed_seq, place) AS fixed_seq FROM met GROUP BY session_id, delivery_seq, i)
        SELECT session_id, min(delivery_seq) AS failed_seq, fixed_seq, place - min(i) - 1 AS attempts, count(*) AS failures FROM first GROUP BY session_id, fixed_seq, place""",
}
