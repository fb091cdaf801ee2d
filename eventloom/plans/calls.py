"""Queries of tool calls, loops and errors and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import commands as C
from eventloom.operators import calls as O
from eventloom.operators.sequence import PATH, path_references
from eventloom.plans.triage import _has, _q
from eventloom.session import written

LEAST = 2


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_outcomes(spark, sf_dir):
    """How each tool use ended."""
    return O.outcomes(_read(spark, sf_dir, "session_events")).select("session_id", "tool_use_id", "failed", F.length("output").cast("bigint").alias("chars"))


def tool_calls(spark, sf_dir):
    """Every call of every session as loops see it."""
    return O.tool_calls(_read(spark, sf_dir, "session_events"))


def call_loops(spark, sf_dir):
    """The longest run of each call, from two repeats on, those with most repeats first."""
    return O.loops(O.tool_calls(_read(spark, sf_dir, "session_events")), least=LEAST)


def loop_summary(spark, sf_dir):
    """How many sessions have loops, and the worst of them."""
    calls = written(O.tool_calls(_read(spark, sf_dir, "session_events")), "all-calls")
    return O.loop_summary(calls, O.loops(calls, least=LEAST))


def failure_verdicts(spark, sf_dir):
    """What each failure is worth."""
    return O.issues(_read(spark, sf_dir, "session_events"))


def mistyped_paths(spark, sf_dir):
    """Paths that items name, and those of changed files without the last letter of their name, with the files meant."""
    files = _read(spark, sf_dir, "session_events").where("type = 'FILE_CHANGED' AND payload.path IS NOT NULL").select(F.col("payload.path").alias("path"))
    short = files.select(F.regexp_replace("path", r"[a-z](\.[^./]*)$", "$1").alias("path"))
    return O.mistyped_paths(path_references(_read(spark, sf_dir, "memory_items")).select("path").unionByName(short), files)


def command_kinds(spark, sf_dir):
    """How often each kind of command stands in the feed, and how many different ones as they are compared."""
    command = F.col("payload.command")
    kind = F.when(C.changes_project(command), "changes").when(C.only_looks(command), "looks").when(C.is_scratch(command), "scratch").otherwise("other")
    rows = _read(spark, sf_dir, "session_events").where("payload.command IS NOT NULL").select(kind.alias("kind"), C.command_signature(command).alias("s"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("s").alias("different"))


QUERIES = {f.__name__: f for f in (use_outcomes, tool_calls, call_loops, loop_summary, failure_verdicts, mistyped_paths, command_kinds)}


def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _bare(command: str) -> str:
    return f"trim(regexp_replace({command}, {_q(C.PREFIX)}, ''), ' ')"


def _looks(command: str) -> str:
    return f"({_has(_bare(command), C.LOOKING)} OR {_has(_bare(command), C.WAITING)})"


def _changes(command: str) -> str:
    return f"({_has(_bare(command), C.CHANGING)} AND NOT {_has(_bare(command), C.STASH_LIST)})"


def _signature(command: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({_bare(command)}, {_q(C.WINDOW)}, ' ', 'g'), '\\s+', ' ', 'g'), ' '))"


def _answer(output: str) -> str:
    masked = f"regexp_replace(left({output}, {C.ANSWER_CHARS}), {_q(C.MOMENT)}, 'T', 'g')"
    masked = f"regexp_replace({masked}, {_q(C.DURATION)}, '\\1D\\2', 'g')"
    return f"nullif(trim(regexp_replace({masked}, '\\s+', ' ', 'g'), ' '), '')"


_SCRATCH = f"({_has('{0}', C.SCRATCH)} OR {_has(f'regexp_replace({{0}}, {_q(C.REDIRECTED)}, chr(32), chr(103))', C.SCRATCH_FILE)})"
_OUTCOMES = """ends AS (
        SELECT session_id, payload.tool_use_id AS tool_use_id, delivery_seq, type,
               type = 'ERROR_DETECTED' OR coalesce(type = 'COMMAND_EXECUTED' AND payload.exit_code <> 0, false) AS failed,
               coalesce(nullif(trim(payload.error, ' '), ''), nullif(trim(payload.output, ' '), ''), '') AS output
        FROM session_events WHERE session_id IS NOT NULL AND payload.tool_use_id <> ''
          AND (type IN ('ERROR_DETECTED', 'TOOL_RESULT') OR (type = 'COMMAND_EXECUTED' AND payload.exit_code IS NOT NULL))),
    outcomes AS (
        SELECT session_id, tool_use_id, o.failed AS failed, o.output AS output FROM (
            SELECT session_id, tool_use_id, coalesce(arg_max({'failed': failed, 'output': output}, delivery_seq) FILTER (type <> 'TOOL_RESULT'),
                                                     arg_min({'failed': failed, 'output': output}, delivery_seq) FILTER (type = 'TOOL_RESULT')) AS o
            FROM ends GROUP BY ALL))"""


def _identity() -> str:
    named = " ".join(f"WHEN tool = '{t}' THEN list_filter(pairs, lambda e: e.k IN ({_list(names)}))" for t, names in O.IDENTITY.items())
    pairs = "list_sort(list_transform(json_keys(args), lambda k: {'k': k, 'v': coalesce(args ->> k, '')}))"
    return f"""(SELECT list_aggregate(list_transform(CASE WHEN len(named) > 0 THEN named ELSE pairs END, lambda e: e.k || '=' || e.v), 'string_agg', chr(31))
        FROM (SELECT pairs, CASE {named} END AS named FROM (SELECT {pairs} AS pairs)))"""


_CALLS = f"""{_OUTCOMES},
    own AS (SELECT DISTINCT session_id FROM session_events WHERE type = 'TOOL_CALL' AND session_id IS NOT NULL AND payload.tool_use_id <> ''),
    firsts AS (
        SELECT session_id, tool_use_id, unnest(c) FROM (
            SELECT session_id, payload.tool_use_id AS tool_use_id, arg_min({{'delivery_seq': delivery_seq, 'type': type, 'payload': payload}}, delivery_seq) AS c
            FROM session_events WHERE type IN ('TOOL_CALL', 'FILE_CHANGED') AND payload.tool_use_id <> '' AND session_id IN (SELECT session_id FROM own) GROUP BY ALL)),
    raw AS (
        SELECT session_id, delivery_seq, 'user' AS kind, 'user' AS tool, NULL AS command, NULL AS args, NULL::BOOLEAN AS failed, NULL AS output
        FROM session_events WHERE type = 'USER_MESSAGE' AND session_id IS NOT NULL
        UNION ALL
        SELECT f.session_id, delivery_seq, CASE WHEN type = 'FILE_CHANGED' THEN 'write' ELSE 'call' END, coalesce(payload.tool, 'unknown'), payload.command, payload.args, o.failed, o.output
        FROM firsts f LEFT JOIN outcomes o ON o.session_id = f.session_id AND o.tool_use_id = f.tool_use_id
        UNION ALL
        SELECT session_id, delivery_seq, CASE WHEN type = 'FILE_CHANGED' THEN 'write' ELSE 'call' END, coalesce(payload.tool, 'unknown'), payload.command, payload.args,
               CASE type WHEN 'FILE_CHANGED' THEN NULL WHEN 'COMMAND_EXECUTED' THEN payload.exit_code <> 0 ELSE type = 'ERROR_DETECTED' END,
               coalesce(nullif(trim(payload.error, ' '), ''), nullif(trim(payload.output, ' '), ''))
        FROM session_events WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM own)
          AND (type = 'FILE_CHANGED' OR (type = 'COMMAND_EXECUTED' AND payload.exit_code IS NOT NULL) OR (type IN ('TOOL_RESULT', 'ERROR_DETECTED') AND payload.args IS NOT NULL))),
    told AS (
        SELECT *, kind = 'user' AS user, kind = 'write' OR tool IN ({_list(C.WRITING_TOOLS)}) AS writes, nullif(trim(command, ' '), '') AS c FROM raw),
    judged AS (SELECT *, coalesce({_changes('c')}, false) AS changes, coalesce({_looks('c')}, false) AS looks FROM told),
    calls AS (
        SELECT session_id, delivery_seq, tool,
               CASE WHEN user THEN 'user' WHEN writes THEN tool || '::write' ELSE tool || '::' || coalesce({_signature('c')}, {_identity()}, '') END AS signature,
               CASE WHEN NOT user THEN failed END AS failed, CASE WHEN NOT user AND NOT writes THEN {_answer('output')} END AS answer,
               user OR (writes AND NOT coalesce(failed, false)) OR (NOT writes AND changes) AS resets,
               user OR writes OR coalesce(failed AND {_has(f'left(output, {C.ERROR_CHARS})', C.PLATFORM)}, false) OR tool IN ({_list(C.REPEATED_TOOLS)})
                 OR {_has('tool', C.UNSEEN_TOOLS)} OR looks OR changes AS ignored FROM judged)"""
_LOOPS = f"""{_CALLS},
    counted AS (
        SELECT *, row_number() OVER w AS i, sum(CAST(resets AS INT)) OVER (PARTITION BY session_id ORDER BY delivery_seq ROWS UNBOUNDED PRECEDING) AS epoch
        FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY delivery_seq)),
    met AS (
        SELECT *, coalesce(i - lag(i) OVER w > {O.GAP} OR epoch <> lag(epoch) OVER w, true) AS apart
        FROM counted WHERE NOT ignored AND NOT resets WINDOW w AS (PARTITION BY session_id, signature ORDER BY i)),
    islands AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY session_id, signature ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM met),
    turned AS (
        SELECT *, coalesce(answer <> last_value(answer IGNORE NULLS) OVER (PARTITION BY session_id, signature, island ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS turn FROM islands),
    runs AS (
        SELECT session_id, tool, signature, island, run, count(*) AS repeats, count(*) FILTER (failed) AS fails, min(delivery_seq) AS first_seq, max(delivery_seq) AS last_seq FROM (
            SELECT *, sum(CAST(turn AS INT)) OVER (PARTITION BY session_id, signature, island ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM turned) GROUP BY ALL),
    loops AS (
        SELECT session_id, tool, signature, repeats, fails * 2 > repeats AS error_loop, first_seq, last_seq FROM runs WHERE repeats >= {LEAST}
        QUALIFY row_number() OVER (PARTITION BY session_id, signature ORDER BY repeats DESC, first_seq) = 1)"""

_STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_ENDING = "regexp_extract(regexp_extract({0}, '([^/]*)$', 1), '.\\.([^.]*)$', 1)"
_BASE, _FOLDER = "regexp_extract({0}, '([^/]*)$', 1)", "regexp_extract({0}, '^(.*)/[^/]*$', 1)"
_PARTS = ", ".join(f"{x.format(v)} AS {n}{v[0]}" for v in ("path", "meant") for x, n in ((_STEM, "stem_"), (_ENDING, "ending_"), (_BASE, "base_"), (_FOLDER, "folder_")))
SQL = {
    "use_outcomes": f"WITH {_OUTCOMES} SELECT session_id, tool_use_id, failed, CAST(length(output) AS BIGINT) AS chars FROM outcomes",
    "tool_calls": f"WITH {_CALLS} SELECT * FROM calls",
    "call_loops": f"WITH {_LOOPS} SELECT * FROM loops",
    "loop_summary": f"""
        WITH {_LOOPS}
        SELECT (SELECT count(DISTINCT session_id) FROM calls) AS sessions, (SELECT count(DISTINCT session_id) FROM loops) AS with_loops, session_id, signature, repeats
        FROM (SELECT 1) LEFT JOIN (SELECT session_id, signature, repeats FROM loops ORDER BY repeats DESC, first_seq LIMIT 1) ON true""",
    "failure_verdicts": f"""
        WITH rows AS (
            SELECT session_id, payload.tool_use_id AS tool_use_id, delivery_seq, payload.command AS command, coalesce(payload.error, payload.output, '') AS said
            FROM session_events WHERE type = 'ERROR_DETECTED' OR (type = 'COMMAND_EXECUTED' AND payload.exit_code <> 0)),
        named AS (
            SELECT session_id, payload.tool_use_id AS tool_use_id, arg_min(payload.command, delivery_seq) AS named FROM session_events
            WHERE payload.command IS NOT NULL AND session_id IS NOT NULL AND payload.tool_use_id <> '' GROUP BY ALL),
        caused AS (
            SELECT r.*, coalesce(command, named) AS cause, left(said, {C.ERROR_CHARS}) AS head FROM rows r
            LEFT JOIN named n ON n.session_id = r.session_id AND n.tool_use_id = r.tool_use_id)
        SELECT delivery_seq, cause, CASE WHEN coalesce({_SCRATCH.format('cause')}, false) THEN 'scratch'
            WHEN NOT {_has('head', C.GRAVE)} AND ({_has('head', C.FUMBLED)} OR {_has('head', C.PLATFORM)}
                 OR length(trim(regexp_replace(head, '(?i)exit code [0-9]+', '', 'g'), ' ')) < {C.SUBSTANCE}) THEN 'noise' ELSE 'known_issue' END AS verdict FROM caused""",
    "mistyped_paths": f"""
        WITH files AS (SELECT DISTINCT payload.path AS meant FROM session_events WHERE type = 'FILE_CHANGED' AND payload.path IS NOT NULL),
        named AS (
            SELECT unnest(regexp_extract_all(text, '{PATH}')) AS path FROM memory_items WHERE id IS NOT NULL
            UNION SELECT regexp_replace(meant, '[a-z](\\.[^./]*)$', '\\1') FROM files),
        gone AS (SELECT path FROM named WHERE path NOT IN (SELECT meant FROM files)),
        met AS (
            SELECT path, meant FROM gone JOIN files ON {_BASE.format('path')} = {_BASE.format('meant')}
            UNION SELECT path, meant FROM gone JOIN files ON {_FOLDER.format('path')} = {_FOLDER.format('meant')}),
        pairs AS (SELECT path, meant, {_PARTS} FROM met)
        SELECT DISTINCT path, meant FROM pairs WHERE base_p <> '' AND base_m <> '' AND (
            (base_p = base_m AND folder_p <> folder_m AND lower(stem_p) NOT IN ({_list(C.COMMON_NAMES)}))
            OR (folder_p = folder_m AND base_p <> base_m AND CASE WHEN stem_p = stem_m THEN ending_p <> ending_m ELSE ending_p = ending_m AND least(length(stem_p), length(stem_m)) >= 3
                AND levenshtein(stem_p, stem_m) <= greatest(1, floor(greatest(length(stem_p), length(stem_m)) / 4)) END))""",
    "command_kinds": f"""
        SELECT CASE WHEN {_changes('c')} THEN 'changes' WHEN {_looks('c')} THEN 'looks' WHEN {_SCRATCH.format('c')} THEN 'scratch' ELSE 'other' END AS kind,
               count(*) AS n, count(DISTINCT {_signature('c')}) AS different
        FROM (SELECT payload.command AS c FROM session_events WHERE payload.command IS NOT NULL) GROUP BY 1""",
}
