"""Agent transcripts and hook payloads as normalised events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
TRANSCRIPT = (
    "type string, sessionId string, uuid string, timestamp timestamp, isSidechain boolean, operation string, content string, "
    f"message struct<id:string,model:string,content:array<{BLOCK}>,usage:{USAGE}>, _corrupt_record string"
)
#: As transcripts are read: the content of a message is text in some records and an array of blocks in others.
_READ = "type string, sessionId string, uuid string, timestamp timestamp, isSidechain boolean, operation string, content string, message string, _corrupt_record string"
PAYLOAD = (
    "struct<text:string,tool:string,tool_use_id:string,args:string,output:string,exit_code:int,command:string,path:string,"
    "paths:array<string>,error:string,truncated:boolean,original_bytes:int,original_hash:string,redactions:int,content_hash:string,project:string,task:string>"
)
EVENT = (
    "id string, session_id string, ordinal int, ts timestamp, type string, source string, importance string, importance_source string, "
    f"dedupe_hash string, payload {PAYLOAD}"
)


def _with_blocks(rows: DataFrame) -> DataFrame:
    """The columns of ``TRANSCRIPT`` with messages as structs; a content that is no array or object is one text block."""
    content, raw = f"content array<{BLOCK}>", F.get_json_object("message", "$.content")
    blocks, fields = F.from_json("message", content)["content"], F.from_json("message", "content map<string,string>")["content"]
    text = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), raw.alias("text"))), BLOCK))
    head = F.from_json("message", f"id string, model string, usage {USAGE}")
    message = F.struct(
        head["id"].alias("id"), head["model"].alias("model"), F.when(blocks.isNull() & fields.isNull() & raw.isNotNull(), text).otherwise(blocks).alias("content"),
        head["usage"].alias("usage"),
    )
    return rows.withColumn("message", F.when(F.col("message").isNotNull(), message))


def read_lines(spark: SparkSession, path: str, schema: str = TRANSCRIPT, pattern: str = "*.jsonl") -> DataFrame:
    """JSON lines below a folder, each with its file's name as session and its line; a bad line is kept in ``_corrupt_record``.

    ``file_line`` counts the lines of a file from 1, blank ones aside; lines added at the end leave it as it was.
    """
    own = schema == TRANSCRIPT
    rows = spark.read.schema(_READ if own else schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("file_session", F.regexp_extract("_file", r"([^/]+)\.jsonl$", 1))
    rows = rows.withColumn("file_line", F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_at"))).drop("_file", "_block", "_at")
    return _with_blocks(rows) if own else rows


def stream_lines(spark: SparkSession, path: str, schema: str = TRANSCRIPT, pattern: str = "*.jsonl", files: int = 1000) -> DataFrame:
    """The same as a stream over rolled files, without lines; the checkpoint of the query is the cursor."""
    own = schema == TRANSCRIPT
    rows = (
        spark.readStream.schema(_READ if own else schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).json(path)
    )
    return _with_blocks(rows) if own else rows


def _payload(**parts: Column) -> Column:
    """A payload struct with the given parts, all else null."""
    names = [x.split(":", 1) for x in PAYLOAD[len("struct<") : -1].replace("array<string>", "array").split(",")]
    kinds = {n: "array<string>" if k == "array" else k for n, k in names}
    return F.struct(*[(parts.get(n, F.lit(None))).cast(k).alias(n) for n, k in kinds.items()])


def _line(records: DataFrame) -> tuple[Column, Column]:
    """The line of each record, and the same with its file's name; null if the records were not read from files."""
    if "file_line" not in records.columns:
        return F.lit(None).cast("int"), F.lit(None).cast("string")
    return F.col("file_line"), F.concat_ws(":", "file_session", "file_line")


def _finished(rows: DataFrame, source: str) -> DataFrame:
    """Events with their ids. ``key`` tells the events of a session apart: the place of each in its records."""
    digest = F.sha2(F.to_json(F.struct("session_id", F.lit(source).alias("source"), "key")), 256)
    return rows.where("type IS NOT NULL").select(
        F.concat(F.lit("evt_"), F.substring(digest, 1, 19)).alias("id"), "session_id", "ordinal", "ts", "type",
        F.lit(source).alias("source"), F.lit("medium").alias("importance"), F.lit("default").alias("importance_source"),
        F.substring(digest, 1, 32).alias("dedupe_hash"), "payload",
    )


def transcript_events(records: DataFrame, source: str = "claude") -> DataFrame:
    """A row for each block of each transcript record: messages, calls, results, errors and changed files.

    Side chains, thoughts, bad lines and records without content give none; a record's session falls back to its file.
    An event is known by its record's ``uuid`` and the block's place, so equal messages are events of their own; without
    uuid the file and line stand for it, and without these the time and content.
    """
    session = F.coalesce("sessionId", "file_session") if "file_session" in records.columns else F.col("sessionId")
    line, place = _line(records)
    rows = records.where(~F.coalesce("isSidechain", F.lit(False)) & F.col("message.content").isNotNull()).select(
        session.alias("session_id"), F.col("timestamp").alias("ts"), F.col("type").alias("role"), F.coalesce(F.nullif("uuid", F.lit("")), place).alias("record"),
        line.alias("ordinal"), F.posexplode("message.content").alias("n", "b"),
    )
    path = F.coalesce(F.get_json_object("b.input", "$.file_path"), F.get_json_object("b.input", "$.notebook_path"))
    writes = F.col("b.name").isin("Write", "Edit", "MultiEdit", "NotebookEdit") & path.isNotNull()
    said = F.col("b.type") == "text"
    kind = (
        F.when(said & (F.col("role") == "user") & (F.trim("b.text") != ""), "USER_MESSAGE")
        .when(said & (F.col("role") == "assistant") & (F.trim("b.text") != ""), "ASSISTANT_MESSAGE")
        .when((F.col("b.type") == "tool_use") & writes, "FILE_CHANGED")
        .when(F.col("b.type") == "tool_use", "TOOL_CALL")
        .when((F.col("b.type") == "tool_result") & F.coalesce("b.is_error", F.lit(False)), "ERROR_DETECTED")
        .when(F.col("b.type") == "tool_result", "TOOL_RESULT")
    )
    call, result = F.col("b.type") == "tool_use", F.col("b.type") == "tool_result"
    bad = F.coalesce("b.is_error", F.lit(False))
    payload = _payload(
        text=F.when(said, F.col("b.text")), tool=F.when(call, F.col("b.name")), tool_use_id=F.when(call, F.col("b.id")).when(result, F.col("b.tool_use_id")),
        args=F.when(call, F.col("b.input")), command=F.when(call, F.get_json_object("b.input", "$.command")), path=F.when(call, path),
        output=F.when(result & ~bad, F.col("b.content")), error=F.when(result & bad, F.col("b.content")),
    )
    key = F.struct(F.lit("transcript"), F.coalesce("record", F.to_json(F.struct("ts", payload))), F.col("b.type"), "n")
    return _finished(rows.select("session_id", "ordinal", "ts", kind.alias("type"), payload.alias("payload"), F.to_json(key).alias("key")), source)


def transcript_usage(records: DataFrame) -> DataFrame:
    """Token use of each message once: ``id, session_id, ts, input_tokens, output_tokens, cached_tokens, model``."""
    rows = records.where("message.usage IS NOT NULL AND message.id IS NOT NULL").select(
        F.col("message.id").alias("id"), F.col("sessionId").alias("session_id"), F.col("timestamp").alias("ts"), F.col("message.usage").alias("u"), F.col("message.model").alias("model")
    )
    cached = F.coalesce("u.cache_read_input_tokens", F.lit(0)) + F.coalesce("u.cache_creation_input_tokens", F.lit(0))
    return rows.dropDuplicates(["id"]).select("id", "session_id", "ts", "u.input_tokens", "u.output_tokens", cached.alias("cached_tokens"), "model")


HOOK = "hook_event_name string, session_id string, cwd string, prompt string, source string, reason string, tool_name string, tool_input string, tool_response string, ts timestamp"


def hook_events(payloads: DataFrame, source: str = "claude") -> DataFrame:
    """Hook payloads as events; hooks that only mark a stop give none.

    As in the reference an event is known by its hook and content, since a hook names no record that it comes from.
    """
    name = F.col("hook_event_name")
    command = F.get_json_object("tool_input", "$.command")
    path = F.get_json_object("tool_input", "$.file_path")
    used = name == "PostToolUse"
    kind = (
        F.when(name == "SessionStart", "SESSION_STARTED").when((name == "UserPromptSubmit") & (F.trim("prompt") != ""), "USER_MESSAGE")
        .when(used & command.isNotNull(), "COMMAND_EXECUTED").when(used & path.isNotNull(), "FILE_CHANGED").when(used, "TOOL_RESULT")
        .when(name == "PreCompact", "COMPACTION_REQUESTED").when(name == "SessionEnd", "SESSION_ENDED")
    )
    payload = _payload(
        text=F.when(name == "UserPromptSubmit", F.col("prompt")).when(name == "PreCompact", F.col("reason")), tool=F.when(used, F.col("tool_name")),
        args=F.when(used, F.col("tool_input")), command=F.when(used, command), path=F.when(used, path),
        output=F.when(used, F.coalesce(F.get_json_object("tool_response", "$.stdout"), F.col("tool_response"))),
        exit_code=F.when(used & command.isNotNull(), F.coalesce(F.get_json_object("tool_response", "$.exit_code").cast("int"), F.lit(0))),
        project=F.when(name == "SessionStart", F.regexp_extract("cwd", r"([^/]+)/?$", 1)),
    )
    key = F.to_json(F.struct(F.lit("hook"), name, payload, "tool_input"))
    none = F.lit(None).cast("int").alias("ordinal")
    return _finished(payloads.select("session_id", none, "ts", kind.alias("type"), payload.alias("payload"), key.alias("key")), source)


ROLLOUT = (
    "type string, timestamp timestamp, payload struct<type:string,session_id:string,cwd:string,role:string,content:string,name:string,"
    "input:string,arguments:string,call_id:string,output:string,message:string>"
)
#: The same with the place that a record gives itself.
ROLLOUT_NUMBERED = f"ordinal int, {ROLLOUT}"


def rollout_events(records: DataFrame, session_id: Column, source: str = "codex") -> DataFrame:
    """Rollout records as events; the session comes from the context, a record's own wins.

    An event is known by its record's ``ordinal``, where the records have one, else by file and line, else by time and
    content.
    """
    line, place = _line(records)
    numbered = F.col("ordinal") if "ordinal" in records.columns else F.lit(None).cast("int")
    p, kind = F.col("payload.type"), F.col("type")
    call, done = p.isin("function_call", "custom_tool_call"), p.isin("function_call_output", "custom_tool_call_output")
    what = (
        F.when(kind == "session_meta", "SESSION_STARTED")
        .when((kind == "event_msg") & (p == "user_message"), "USER_MESSAGE").when((kind == "event_msg") & (p == "agent_message"), "ASSISTANT_MESSAGE")
        .when((kind == "response_item") & call, "TOOL_CALL").when((kind == "response_item") & done, "TOOL_RESULT")
    )
    args = F.coalesce("payload.arguments", "payload.input")
    payload = _payload(
        text=F.when(kind == "event_msg", F.col("payload.message")), tool=F.when(call, F.col("payload.name")), tool_use_id=F.col("payload.call_id"),
        args=F.when(call, args), command=F.when(call, F.get_json_object(args, "$.command")), output=F.when(done, F.col("payload.output")),
        project=F.when(kind == "session_meta", F.regexp_extract("payload.cwd", r"([^/]+)/?$", 1)),
    )
    key = F.struct(F.lit("rollout"), F.coalesce(numbered.cast("string"), place, F.to_json(F.struct("timestamp", payload))), what, "payload.call_id")
    rows = records.select(
        F.coalesce("payload.session_id", session_id).alias("session_id"), F.coalesce(numbered, line).alias("ordinal"), F.col("timestamp").alias("ts"), what.alias("type"),
        payload.alias("payload"), F.to_json(key).alias("key"),
    )
    return _finished(rows, source)


def normalised_events(lines: DataFrame, column: str = "value", source: str = "generic") -> DataFrame:
    """Complete events in JSON, with defaults for what they lack; lines that are no event are dropped."""
    e = F.from_json(column, EVENT)
    rows = lines.select(e.alias("e")).where("e.type IS NOT NULL AND e.session_id IS NOT NULL").select("e.*")
    digest = F.sha2(F.concat_ws("\x1f", "session_id", "type", F.coalesce("source", F.lit(source)), F.coalesce(F.col("ordinal").cast("string"), F.lit("")), F.to_json("payload")), 256)
    return rows.select(
        F.coalesce("id", F.concat(F.lit("evt_"), F.substring(digest, 1, 19))).alias("id"), "session_id", "ordinal", "ts", "type", F.coalesce("source", F.lit(source)).alias("source"),
        F.coalesce("importance", F.lit("medium")).alias("importance"), F.when(F.col("importance").isNull(), "default").otherwise(F.coalesce("importance_source", F.lit("adapter"))).alias("importance_source"),
        F.coalesce(F.nullif("dedupe_hash", F.lit("")), F.substring(digest, 1, 32)).alias("dedupe_hash"), "payload",
    )
