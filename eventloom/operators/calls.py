"""Tool calls with their answers, loops over them, and what errors are worth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import commands as C
from eventloom.operators.metrics import running_last, running_sum
from eventloom.session import written

#: Calls that may lie between repeats, and repeats that make a loop.
GAP, LEAST_REPEATS = 15, 3
#: Paths in one block of a comparison of names, and those of a block that are compared at once.
BLOCK, TILE = 2048, 64
# The arguments that identify a call of some tools; all arguments identify a call of any other.
IDENTITY = {
    "Read": ("file_path", "offset", "limit"), "Grep": ("pattern", "path", "glob", "type", "output_mode"), "Glob": ("pattern", "path"),
    "WebFetch": ("url", "prompt"), "WebSearch": ("query",),
}


def outcomes(events: DataFrame) -> DataFrame:
    """How each tool use ended: ``session_id, tool_use_id, failed, output``. The last error or exit code counts, or else the
    first result."""
    ends = events.where("session_id IS NOT NULL AND payload.tool_use_id <> ''").where(
        "type IN ('ERROR_DETECTED', 'TOOL_RESULT') OR (type = 'COMMAND_EXECUTED' AND payload.exit_code IS NOT NULL)"
    )
    told = F.coalesce(F.nullif(F.trim("payload.error"), F.lit("")), F.nullif(F.trim("payload.output"), F.lit("")), F.lit(""))
    failed = (F.col("type") == "ERROR_DETECTED") | F.coalesce((F.col("type") == "COMMAND_EXECUTED") & (F.col("payload.exit_code") != 0), F.lit(False))
    rows = ends.select("session_id", F.col("payload.tool_use_id").alias("tool_use_id"), "delivery_seq", (F.col("type") == "TOOL_RESULT").alias("result"), F.struct(failed.alias("failed"), told.alias("output")).alias("o"))
    last, first = F.max_by("o", F.when(~F.col("result"), F.col("delivery_seq"))), F.min_by("o", F.when(F.col("result"), F.col("delivery_seq")))
    return rows.groupBy("session_id", "tool_use_id").agg(F.coalesce(last, first).alias("o")).select("session_id", "tool_use_id", "o.failed", "o.output")


def tool_calls(events: DataFrame) -> DataFrame:
    """One row for each tool call and user message of each session:
    ``session_id, delivery_seq, tool, signature, failed, answer, resets, ignored``.

    A session with calls of its own takes these, each use once at its first delivery, with the outcome of the use; any
    other takes the commands, changed files and results that hooks leave. User messages, changed files, writing tools and
    commands that change the project end a run (``resets``); what only looks, is meant to be repeated or was refused by
    the platform is ``ignored``. A writing call that failed changed nothing.
    """
    rows = events.where("session_id IS NOT NULL").select("session_id", "delivery_seq", "type", "payload")
    use = F.nullif(F.col("payload.tool_use_id"), F.lit(""))
    own = rows.where((F.col("type") == "TOOL_CALL") & use.isNotNull()).groupBy("session_id").agg(F.lit(True).alias("own"))
    rows = rows.join(own, "session_id", "left").withColumn("own", F.coalesce("own", F.lit(False))).withColumn("tool_use_id", use)
    told = F.coalesce(F.nullif(F.trim("payload.error"), F.lit("")), F.nullif(F.trim("payload.output"), F.lit("")))
    users = rows.where("type = 'USER_MESSAGE'").select("session_id", "delivery_seq", F.lit("user").alias("kind"), F.lit("user").alias("tool"), *_no_call())
    made = rows.where("own AND type IN ('TOOL_CALL', 'FILE_CHANGED') AND tool_use_id IS NOT NULL")
    made = made.groupBy("session_id", "tool_use_id").agg(F.min_by(F.struct("delivery_seq", "type", "payload"), "delivery_seq").alias("c"))
    made = made.join(outcomes(events), ["session_id", "tool_use_id"], "left").select(
        "session_id", "c.delivery_seq", F.when(F.col("c.type") == "FILE_CHANGED", "write").otherwise("call").alias("kind"), F.coalesce("c.payload.tool", F.lit("unknown")).alias("tool"),
        F.col("c.payload.command").alias("command"), F.col("c.payload.args").alias("args"), "failed", "output",
    )
    ended = F.when(F.col("type") == "COMMAND_EXECUTED", F.col("payload.exit_code") != 0).otherwise(F.col("type") == "ERROR_DETECTED")
    hooked = rows.where("NOT own").where(
        "type = 'FILE_CHANGED' OR (type = 'COMMAND_EXECUTED' AND payload.exit_code IS NOT NULL) OR (type IN ('TOOL_RESULT', 'ERROR_DETECTED') AND payload.args IS NOT NULL)"
    )
    hooked = hooked.select(
        "session_id", "delivery_seq", F.when(F.col("type") == "FILE_CHANGED", "write").otherwise("call").alias("kind"), F.coalesce("payload.tool", F.lit("unknown")).alias("tool"),
        F.col("payload.command").alias("command"), F.col("payload.args").alias("args"), F.when(F.col("type") != "FILE_CHANGED", ended).alias("failed"), told.alias("output"),
    )
    calls = users.unionByName(made).unionByName(hooked)
    writes = (F.col("kind") == "write") | F.col("tool").isin(*C.WRITING_TOOLS)
    command = F.nullif(F.trim("command"), F.lit(""))
    changes, looks = F.coalesce(C.changes_project(command), F.lit(False)), F.coalesce(C.only_looks(command), F.lit(False))
    refused = F.coalesce(F.col("failed") & C.of_platform(F.col("output")), F.lit(False))
    again = F.col("tool").isin(*C.REPEATED_TOOLS) | F.col("tool").rlike(C.UNSEEN_TOOLS)
    user = F.col("kind") == "user"
    return calls.select(
        "session_id", "delivery_seq", "tool",
        F.when(user, "user").when(writes, F.concat("tool", F.lit("::write"))).otherwise(F.concat("tool", F.lit("::"), F.coalesce(C.command_signature(command), _identity()))).alias("signature"),
        F.when(~user, F.col("failed")).alias("failed"), F.when(~user & ~writes, C.plain_answer(F.col("output"))).alias("answer"),
        (user | (writes & ~F.coalesce("failed", F.lit(False))) | (~writes & changes)).alias("resets"),
        (user | writes | refused | again | looks | changes).alias("ignored"),
    )


def _no_call():
    text = F.lit(None).cast("string")
    return text.alias("command"), text.alias("args"), F.lit(None).cast("boolean").alias("failed"), text.alias("output")


def _identity():
    """The arguments that identify a call, in lower case: those named for its tool if it has any, else all, as pairs in order."""
    pairs = F.array_sort(F.map_entries(F.from_json("args", "map<string,string>")))
    of = lambda names: F.filter(pairs, lambda e: e["key"].isin(*names))
    named = F.coalesce(*[F.when(F.col("tool") == t, of(names)) for t, names in IDENTITY.items()])
    chosen = F.when(F.size(named) > 0, named).otherwise(pairs)
    joined = F.array_join(F.transform(chosen, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\x1f")
    return F.coalesce(joined, F.lower(F.trim(F.regexp_replace("args", r"\s+", " "))), F.lit(""))


def loops(calls: DataFrame, gap: int = GAP, least: int = LEAST_REPEATS) -> DataFrame:
    """The longest run of each call and session: ``session_id, tool, signature, repeats, error_loop, first_seq, last_seq``.

    A run has one signature and one answer, a missing answer differing from none; no repeat comes more than ``gap`` calls
    after the one before, and nothing that resets lies between. An error loop fails more than half of the time. Places,
    resets and runs are counted along ranges, so neither a long session nor a call repeated without end is one task.
    """
    rows = calls.withColumn("one", F.lit(1).cast("bigint")).withColumn("reset", F.col("resets").cast("bigint"))
    rows = written(running_sum(written(rows, "calls"), "session_id", "delivery_seq", "one", "i"), "calls-placed")
    rows = running_sum(rows, "session_id", "delivery_seq", "reset", "epoch")
    keys = ["session_id", "signature"]
    rows = written(rows.where("NOT ignored AND NOT resets").withColumn("here", F.struct("i", "epoch")), "calls-counted")
    rows = running_last(rows, keys, "i", "here", "before")
    apart = F.coalesce((F.col("i") - F.col("before.i") > gap) | (F.col("epoch") != F.col("before.epoch")), F.lit(True))
    rows = written(rows.withColumn("apart", apart.cast("bigint")), "calls-apart")
    rows = written(running_sum(rows, keys, "i", "apart", "island"), "calls-islands")
    rows = running_last(rows, [*keys, "island"], "i", "answer", "known")
    rows = written(rows.withColumn("turn", F.coalesce((F.col("answer") != F.col("known")).cast("bigint"), F.lit(0))), "calls-turned")
    rows = running_sum(rows, [*keys, "island"], "i", "turn", "run")
    runs = rows.groupBy(*keys, "tool", "island", "run").agg(
        F.count("*").alias("repeats"), F.count_if(F.coalesce("failed", F.lit(False))).alias("fails"), F.min("delivery_seq").alias("first_seq"), F.max("delivery_seq").alias("last_seq")
    )
    best = F.max_by(F.struct("tool", "repeats", "fails", "first_seq", "last_seq"), F.struct("repeats", -F.col("first_seq"))).alias("b")
    found = runs.where(F.col("repeats") >= least).groupBy(*keys).agg(best)
    return found.select("session_id", "b.tool", "signature", "b.repeats", (F.col("b.fails") * 2 > F.col("b.repeats")).alias("error_loop"), "b.first_seq", "b.last_seq")


def loop_summary(calls: DataFrame, found: DataFrame) -> DataFrame:
    """One row: ``sessions, with_loops``, and the session, call and repeats of the worst loop, the first of equal ones."""
    worst = F.max_by(F.struct("session_id", "signature", "repeats"), F.struct("repeats", -F.col("first_seq"))).alias("w")
    loops_row = found.agg(F.countDistinct("session_id").alias("with_loops"), worst)
    scanned = calls.agg(F.countDistinct("session_id").alias("sessions"))
    return scanned.crossJoin(loops_row).select("sessions", "with_loops", F.col("w.session_id").alias("session_id"), F.col("w.signature").alias("signature"), F.col("w.repeats").alias("repeats"))  # one row each


def issues(events: DataFrame) -> DataFrame:
    """What each failure of the feed is worth: ``delivery_seq, verdict, cause``, the cause being the command of its tool use.

    An error or a command that failed is ``scratch`` if the command is the agent's own trial, ``noise`` if the text says
    nothing of the project, else a ``known_issue``.
    """
    rows = events.where("type = 'ERROR_DETECTED' OR (type = 'COMMAND_EXECUTED' AND payload.exit_code <> 0)").select(
        "session_id", F.col("payload.tool_use_id").alias("tool_use_id"), "delivery_seq", "payload.command", F.coalesce("payload.error", "payload.output", F.lit("")).alias("said")
    )
    named = events.where("payload.command IS NOT NULL AND session_id IS NOT NULL AND payload.tool_use_id <> ''")
    named = named.groupBy("session_id", F.col("payload.tool_use_id").alias("tool_use_id")).agg(F.min_by("payload.command", "delivery_seq").alias("named"))
    rows = rows.join(named, ["session_id", "tool_use_id"], "left").withColumn("cause", F.coalesce("command", "named"))
    verdict = F.when(F.coalesce(C.is_scratch(F.col("cause")), F.lit(False)), "scratch").when(C.fleeting(F.col("said")), "noise").otherwise("known_issue")
    return rows.select("delivery_seq", verdict.alias("verdict"), "cause")


def mistyped_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that are no file, with the files that they were likely meant to be: ``(path, meant)``.

    ``paths`` and ``files`` have ``path``. A file is meant if it has the same name in another folder, unless many files
    bear that name, or in the same folder the same stem with another ending, or the same ending and a near stem. The
    first two are joins that give no other pairs; the near stems of a folder and ending are compared in blocks.
    """
    parts = C.path_parts(F.col("path"))
    files = written(files.where("path IS NOT NULL").select("path").distinct().select("path", parts.alias("p")).select("path", "p.*").where("base <> ''"), "real-paths")
    gone = paths.where("path IS NOT NULL").select("path").distinct().join(files.select("path"), "path", "left_anti")
    gone = written(gone.select("path", parts.alias("p")).select("path", "p.*").where("base <> ''"), "gone-paths")
    meant = files.withColumnsRenamed({"path": "meant", "folder": "f", "ending": "e"})
    moved = gone.where(~F.lower("stem").isin(*C.COMMON_NAMES)).join(meant.select("meant", "base", "f"), "base").where("folder <> f")
    ended = gone.join(meant.select("meant", F.col("f").alias("folder"), "stem", "e"), ["folder", "stem"]).where("ending <> e")
    near = _alike(gone, files).where(C.near_stems(F.col("a"), F.col("b")))
    return moved.select("path", "meant").unionByName(ended.select("path", "meant")).unionByName(near.select("path", "meant"))


def _alike(gone: DataFrame, files: DataFrame) -> DataFrame:
    """All pairs of one folder and ending whose stems can be near: ``(path, meant, a, b)``, with their stems.

    Each side of a folder and ending is gathered into blocks of about ``BLOCK``, and every pair of blocks is compared in
    a task by marks of 64 bits. One edit changes one letter and two pairs of neighbouring letters on either side, so
    stems that differ in more of them than their edits allow are left out; no near pair is.
    """
    keys = ["folder", "ending"]

    def blocks(df: DataFrame, side: str) -> DataFrame:
        df = df.where(F.length("stem") >= 3).select(*keys, F.struct("path", "stem").alias("x"))
        sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("n"))
        return df.join(sizes, keys).groupBy(*keys, F.pmod(F.xxhash64("x"), "n").alias("block")).agg(F.collect_list("x").alias(side)).drop("block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, s = batch.column("q").flatten(), batch.column("s").flatten()
            (q_len, q_letters, q_pairs), (s_len, s_letters, s_pairs) = _marks(q.field("stem")), _marks(s.field("stem"))
            q_end, s_end = (np.cumsum(pc.list_value_length(batch.column(c)).to_numpy()) for c in ("q", "s"))
            for row in range(len(batch)):
                at = slice(s_end[row - 1] if row else 0, s_end[row])
                for low in range(q_end[row - 1] if row else 0, q_end[row], TILE):
                    high = min(low + TILE, q_end[row])
                    edits = np.maximum(np.maximum(q_len[low:high, None], s_len[at]) >> 2, 1)
                    x, y = q_letters[low:high, None], s_letters[at]
                    i, j = np.nonzero((np.bitwise_count(x & ~y) <= edits) & (np.bitwise_count(~x & y) <= edits))
                    most = 2 * edits[i, j]
                    i, j = i + low, j + at.start
                    x, y = q_pairs[i], s_pairs[j]
                    keep = (np.bitwise_count(x & ~y) <= most) & (np.bitwise_count(~x & y) <= most)
                    if keep.any():
                        a, b = q.take(pa.array(i[keep])), s.take(pa.array(j[keep]))
                        yield pa.RecordBatch.from_arrays([a.field("path"), b.field("path"), a.field("stem"), b.field("stem")], ["path", "meant", "a", "b"])

    return blocks(gone, "q").join(blocks(files, "s"), keys).select("q", "s").mapInArrow(compare, "path string, meant string, a string, b string")


def _marks(stems: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its length, a mark of its letters, second ones apart from first, and one of its pairs of letters, its
    ends counted as letters. A character counts as the first byte of its encoding."""
    n = len(stems)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), stems.cast(pa.binary())), b"")[0]
    data, of = np.frombuffer(whole.as_buffer(), np.uint8), np.repeat(np.arange(n), pc.binary_length(stems).to_numpy())
    first = (data & 0xC0) != 0x80
    data, of = data[first].astype(np.int64), of[first]
    length = np.bincount(of, minlength=n)

    def mark(owner: np.ndarray, bit: np.ndarray) -> np.ndarray:
        order, out = np.argsort(owner, kind="stable"), np.zeros(n, np.uint64)
        owner = owner[order]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
        if len(starts):
            out[owner[starts]] = np.bitwise_or.reduceat(np.uint64(1) << bit[order].astype(np.uint64), starts)
        return out

    once, times = np.unique(of * 256 + data, return_counts=True)
    twice = once[times > 1]
    letters = mark(np.r_[once >> 8, twice >> 8], np.r_[once & 31, 32 + (twice & 31)])
    edge = np.r_[True, of[1:] != of[:-1]][: len(of)]
    before, last = np.where(edge, 0, np.r_[0, data[:-1]][: len(data)]), np.r_[edge[1:], True][: len(data)]
    bit = lambda a, b: ((a * 0x9E3779B1 + b * 0x85EBCA6B) & 0xFFFFFFFF) >> 26
    pairs = mark(np.r_[of, of[last]], np.r_[bit(before, data), bit(data[last], 0)])
    return length, letters, pairs
