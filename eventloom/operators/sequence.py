"""Patterns in the order of a session's events: attempts, recoveries, repeated calls, errors and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.metrics import running_last, running_sum
from eventloom.session import written

#: Attempts that a success looks back, calls that may lie between repeats, and repeats that make a loop.
LOOK_BACK, GAP, LEAST_REPEATS = 5, 15, 3
#: Attempts that a failure looks ahead.
AHEAD = 12

# Words of a line that tells what kind of error a command had.
ERROR_LINE = (
    r"(?i)(not found|no such file|command not found|unrecognized|unknown option|invalid|is not a function|cannot find|permission denied"
    r"|usage:|assertion failed|timeout|failed|error)"
)
PATH = r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_-]+\.[A-Za-z][A-Za-z0-9]{0,5}"


def call_outcomes(events: DataFrame) -> DataFrame:
    """Each tool call with its first later outcome of the same session and tool use:
    ``session_id, tool_use_id, call_seq, outcome_seq, ok, tool``. A call without outcome, and an outcome without call,
    give no row; of repeated calls of one use the first counts."""
    keys = events.where("session_id IS NOT NULL AND payload.tool_use_id IS NOT NULL")
    calls = keys.where("type IN ('TOOL_CALL', 'FILE_CHANGED')").groupBy("session_id", F.col("payload.tool_use_id").alias("tool_use_id")).agg(
        F.min("delivery_seq").alias("call_seq"), F.min_by("payload.tool", "delivery_seq").alias("tool")
    )
    ends = keys.where("type IN ('TOOL_RESULT', 'ERROR_DETECTED')").select(
        "session_id", F.col("payload.tool_use_id").alias("tool_use_id"), F.col("delivery_seq").alias("end_seq"), (F.col("type") == "TOOL_RESULT").alias("good")
    )
    met = calls.join(ends, ["session_id", "tool_use_id"]).where("end_seq > call_seq")
    return met.groupBy("session_id", "tool_use_id", "call_seq", "tool").agg(F.min("end_seq").alias("outcome_seq"), F.min_by("good", "end_seq").alias("ok"))


def command_attempts(events: DataFrame) -> DataFrame:
    """Commands with an exit code, numbered within their session: ``session_id, delivery_seq, i, command, ok, output``.

    The numbers are running counts over ranges of ``delivery_seq``, so a long session is no single task."""
    rows = events.where("type = 'COMMAND_EXECUTED' AND session_id IS NOT NULL AND payload.command IS NOT NULL AND payload.exit_code IS NOT NULL")
    tries = rows.select(
        "session_id", "delivery_seq", F.col("payload.command").alias("command"), (F.col("payload.exit_code") == 0).alias("ok"),
        F.coalesce("payload.error", "payload.output", F.lit("")).alias("output"), F.lit(1).alias("one"),
    )
    return running_sum(tries, "session_id", "delivery_seq", "one", "i").drop("one")


def program(command: Column) -> Column:
    """The first word of a command."""
    return F.regexp_extract(command, r"^\s*(\S+)", 1)


def related_commands(a: Column, b: Column) -> Column:
    """Whether one command is another try of the other: the same program, and few edits or a long word in common."""
    near = F.levenshtein(a, b) <= 0.4 * F.greatest(F.length(a), F.length(b))
    long_words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= 5)
    return (program(a) == program(b)) & (near | F.arrays_overlap(long_words(a), long_words(b)))


def recoveries(events: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """Failed commands with the success that put them right: ``session_id, failed_seq, fixed_seq, failed, fixed``.

    A success looks back over ``look_back`` attempts to the nearest failure, by joins on the attempts' numbers; the pair
    counts if the commands differ and are related; of several successes that find one failure the first takes it.
    """
    tries = command_attempts(events)
    failures = tries.where("NOT ok").select("session_id", F.col("i").alias("at"), F.struct("delivery_seq", "command").alias("f"))
    looks = tries.where("ok").select("session_id", "delivery_seq", "command", "i", F.explode(F.sequence(F.col("i") - look_back, F.col("i") - 1)).alias("at"))
    nearest = looks.join(failures, ["session_id", "at"]).groupBy("session_id", "delivery_seq", "command")
    found = nearest.agg(F.max_by("f", "at").alias("f"))
    pairs = found.where((F.col("f.command") != F.col("command")) & related_commands(F.col("f.command"), F.col("command")))
    return pairs.groupBy("session_id", F.col("f.delivery_seq").alias("failed_seq"), F.col("f.command").alias("failed")).agg(
        F.min("delivery_seq").alias("fixed_seq"), F.min_by("command", "delivery_seq").alias("fixed")
    )


def episodes(events: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """Failed commands with the related success that resolved them: ``session_id, failed_seq, fixed_seq, attempts, failures``.

    A failure looks ahead over ``ahead`` attempts to the first related success, by joins on the attempts' numbers. Of the
    failures that one success resolves, the first opens the episode; ``attempts`` lie between its ends and ``failures`` are
    those that it resolves.
    """
    tries = written(command_attempts(events), "attempts")
    wins = tries.where("ok").select("session_id", F.col("i").alias("at"), F.struct("delivery_seq", "command").alias("w"))
    looks = tries.where("NOT ok").select("session_id", "delivery_seq", "command", "i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + ahead)).alias("at"))
    met = looks.join(wins, ["session_id", "at"]).where(related_commands(F.col("command"), F.col("w.command")))
    first = met.groupBy("session_id", "delivery_seq", "i").agg(F.min("at").alias("at"), F.min_by("w.delivery_seq", "at").alias("fixed_seq"))
    return first.groupBy("session_id", "fixed_seq", "at").agg(F.min("delivery_seq").alias("failed_seq"), F.min("i").alias("i"), F.count("*").alias("failures")).select(
        "session_id", "failed_seq", "fixed_seq", (F.col("at") - F.col("i") - 1).alias("attempts"), "failures"
    )


def repeated_calls(events: DataFrame, gap: int = GAP, least: int = LEAST_REPEATS) -> DataFrame:
    """Loops: the longest run of equal calls of each session and signature, of at least ``least`` calls.

    Signatures are the commands. A run ends where a file change, a gap of more than ``gap`` events, or a different
    answer comes between; a missing answer differs from none. Islands without answers come first (changes and gaps),
    and runs inside them change where the last known answer does, so no state is walked row by row.
    """
    rows = events.where("session_id IS NOT NULL").select(
        "session_id", "delivery_seq", F.when(F.col("type") == "COMMAND_EXECUTED", F.col("payload.command")).alias("call"), F.nullif(F.col("payload.output"), F.lit("")).alias("answer"),
        (F.col("type") == "FILE_CHANGED").cast("int").alias("reset"), F.lit(1).alias("one"),
    )
    counted = running_sum(running_sum(rows, "session_id", "delivery_seq", "one", "i"), "session_id", "delivery_seq", "reset", "epoch")
    calls = counted.where("call IS NOT NULL")
    same = Window.partitionBy("session_id", "call").orderBy("delivery_seq")
    apart = F.coalesce((F.col("i") - F.lag("i").over(same) > gap) | (F.col("epoch") != F.lag("epoch").over(same)), F.lit(True))
    islands = calls.withColumn("island", F.sum(apart.cast("int")).over(same))
    inside = Window.partitionBy("session_id", "call", "island").orderBy("delivery_seq")
    known = F.last("answer", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    turned = islands.withColumn("turn", F.coalesce((F.col("answer") != known).cast("int"), F.lit(0)))
    runs = turned.withColumn("run", F.sum("turn").over(inside)).groupBy("session_id", "call", "island", "run").agg(F.count("*").alias("repeats"), F.min("delivery_seq").alias("first_seq"))
    best = F.max_by(F.struct("repeats", "first_seq"), F.struct("repeats", -F.col("first_seq"))).alias("b")
    return runs.where(F.col("repeats") >= least).groupBy("session_id", "call").agg(best).select("session_id", "call", "b.repeats", "b.first_seq")


def error_class(text: Column) -> Column:
    """The first of the first 40 lines that tells an error, without numbers, at most 80 characters; null if none does."""
    lines = F.filter(F.slice(F.split(text, r"\n"), 1, 40), lambda x: x.rlike(ERROR_LINE))
    return F.substring(F.trim(F.regexp_replace(F.get(lines, 0), r"[0-9]+", "N")), 1, 80)


def path_references(items: DataFrame) -> DataFrame:
    """The different paths that each item's text names: ``(id, path)``."""
    return items.where(F.col("id").isNotNull()).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATH), F.lit(0)))).alias("path"))


def stale_references(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items with paths, how many of them are among ``files`` (``path``), and whether all are gone."""
    named = path_references(items)
    return named.join(files.select("path", F.lit(1).alias("there")).distinct(), "path", "left").groupBy("id").agg(
        F.count("*").alias("named"), F.count("there").alias("present"), (F.count("there") == 0).alias("stale")
    )


def latest_notes(events: DataFrame, pairs: DataFrame, least: int = 20) -> DataFrame:
    """The last long message of the assistant between the two ends of each recovery: ``failed_seq, note_seq``.

    Notes and recoveries are put in one order and the last note runs along over ranges of it, so no note is paired with
    every recovery of its session.
    """
    notes = events.where("type = 'ASSISTANT_MESSAGE' AND session_id IS NOT NULL").where(F.length("payload.text") >= least)
    notes = notes.select("session_id", F.col("delivery_seq").alias("at"), F.col("delivery_seq").alias("note_seq"), F.lit(None).cast("bigint").alias("failed_seq"))
    ends = pairs.select("session_id", F.col("fixed_seq").alias("at"), F.lit(None).cast("bigint").alias("note_seq"), "failed_seq")
    found = running_last(notes.unionByName(ends), ["session_id"], "at", "note_seq", "note").where("note > failed_seq")
    return found.groupBy("failed_seq").agg(F.max("note").alias("note_seq"))
