"""Conversations put together again from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.components import connected_components
from eventloom.operators.dedupe import repeated_deliveries
from eventloom.operators.metrics import running_last
from eventloom.session import cut, written

#: The event types that are messages, and their roles.
ROLES = {"USER_MESSAGE": "user", "ASSISTANT_MESSAGE": "assistant"}
#: Messages from which a conversation is ordered in several ranges of places, and how many ranges.
LONG = 100_000
RANGES = 256
#: Words that a quoted line must have, and hours that may lie between it and the message that says it.
QUOTED_WORDS, QUOTE_HOURS = 3, 24


def messages(events: DataFrame) -> DataFrame:
    """The messages with text among the kept events: ``delivery_seq, session_id, ordinal, ts, role``."""
    spoken = events.where(F.col("type").isin(*ROLES) & F.col("payload.text").rlike(r"[\p{L}\p{N}]"))
    role = F.when(F.col("type") == "USER_MESSAGE", ROLES["USER_MESSAGE"]).otherwise(ROLES["ASSISTANT_MESSAGE"])
    rows = spoken.select("delivery_seq", "session_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), role.alias("role"))
    return rows.join(repeated_deliveries(events).select("delivery_seq"), "delivery_seq", "left_anti")


def reply_and_quote_links(events: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of messages without a session: to the messages that share their tool use (a reply), with or without
    a session, and to the one whose line they quote after ``>``.

    A tool use links each of its messages to the first of them. A quoted line of at least ``QUOTED_WORDS`` words links to
    the last message delivered before that says it, or else to the first one after, if their times, where both have one,
    are at most ``QUOTE_HOURS`` apart. So no two groups are paired in full, and short lines that many say link nothing.
    """
    spoken = events.where(F.col("type").isin(*ROLES) & F.col("payload.text").isNotNull() & F.col("delivery_seq").isNotNull())
    keyed = spoken.where("payload.tool_use_id <> ''").select("delivery_seq", F.col("payload.tool_use_id").alias("key"), F.col("session_id").isNull().alias("bare"))
    least = keyed.groupBy("key").agg(F.min("delivery_seq").alias("b"), F.max("bare").alias("bare")).where("bare").drop("bare")
    replies = keyed.join(least, "key").select(F.col("delivery_seq").alias("a"), "b")
    lines = spoken.select("delivery_seq", "session_id", "ts", F.explode(F.split("payload.text", r"\r?\n")).alias("line"))
    lines = lines.select("delivery_seq", "session_id", F.struct("delivery_seq", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).alias("said_by"), F.col("line").startswith(">").alias("quotes"),
                         F.trim(F.regexp_replace("line", "^[> ]+", "")).alias("said"))
    lines = lines.where(F.size(F.regexp_extract_all("said", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) >= QUOTED_WORDS)
    quoted = lines.where("quotes AND session_id IS NULL").select("delivery_seq", "said", F.col("said_by").alias("quoted_by"))
    said = lines.where("NOT quotes").join(quoted.select("said").distinct(), "said", "left_semi").select("delivery_seq", "said", "said_by")
    line = said.withColumn("quoted_by", F.lit(None).cast(quoted.schema["quoted_by"].dataType)).unionByName(quoted.withColumn("said_by", F.lit(None).cast(said.schema["said_by"].dataType)))
    line = running_last(line, ["said"], "delivery_seq", "said_by", "earlier").withColumn("back", -F.col("delivery_seq"))
    met = running_last(line, ["said"], "back", "said_by", "later").where("quoted_by IS NOT NULL").select("quoted_by", F.coalesce("earlier", "later").alias("said_by"))
    near = F.coalesce(F.abs(F.col("quoted_by.at") - F.col("said_by.at")) <= QUOTE_HOURS * 3600, F.lit(True))
    quotes = met.where(near).select(F.col("quoted_by.delivery_seq").alias("a"), F.col("said_by.delivery_seq").alias("b"))
    return quotes.unionByName(replies).where("a <> b")


def with_conversations(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Give each message without a session the conversation that its links lead to.

    Conversations without an identifier are the connected components of their links. One that reaches a message with a
    session takes the least such session, any other is named by its first message. Sessions themselves need no search.
    """
    if events.where(F.col("session_id").isNull() & F.col("type").isin(*ROLES)).isEmpty():
        return rows.withColumnRenamed("session_id", "conversation")
    parts = connected_components(reply_and_quote_links(events), "a", "b")
    known = parts.join(rows.select(F.col("delivery_seq").alias("node"), "session_id"), "node").groupBy("component").agg(F.min("session_id").alias("name"))
    found = parts.join(known, "component").select(F.col("node").alias("delivery_seq"), "component", "name")
    own = F.concat(F.lit("conversation:"), F.coalesce("component", "delivery_seq").cast("string"))
    return rows.join(found, "delivery_seq", "left").select(
        "delivery_seq", F.coalesce("session_id", "name", own).alias("conversation"), "ordinal", "ts", "role"
    )


def rebuilt(rows: DataFrame, long: int = LONG, ranges: int = RANGES) -> DataFrame:
    """Order and validate messages: ``(conversation, turn, role, delivery_seq)`` for the sound conversations.

    The place of a message is its ordinal if all of its conversation have one, otherwise its time. A conversation with
    more than ``long`` messages is cut at quantiles of its places into ``ranges`` parts, which are ordered and checked
    apart; the parts' counts and end roles then give the turns and join the checks, so no task sorts a whole long one.
    """
    sizes = rows.groupBy("conversation").agg(F.count("*").alias("n"), F.count("ordinal").alias("with_ordinal"), F.count("ts").alias("with_ts"))
    by_ordinal = F.col("with_ordinal") == F.col("n")
    usable = sizes.where(by_ordinal | (F.col("with_ts") == F.col("n"))).select("conversation", "n", by_ordinal.alias("by_ordinal"))
    placed = rows.join(usable, "conversation").select(
        "conversation", "delivery_seq", "role", "n", F.when(F.col("by_ordinal"), F.col("ordinal")).otherwise(F.col("ts")).alias("place")
    )
    cuts = placed.where(F.col("n") > long).groupBy("conversation").agg(F.percentile_approx("place", [k / ranges for k in range(1, ranges)]).alias("cuts"))
    cuts = cut(cuts)
    if cuts.isEmpty():
        parted = placed.withColumn("part", F.lit(0))
    else:
        below = F.size(F.filter("cuts", lambda c: c <= F.col("place")))
        parted = placed.join(cuts, "conversation", "left").withColumn("part", F.coalesce(below, F.lit(0))).drop("cuts")
    inside = Window.partitionBy("conversation", "part").orderBy("place", "delivery_seq")
    before, role_before = F.lag("place").over(inside), F.lag("role").over(inside)
    checked = parted.select(
        "conversation", "part", "delivery_seq", "role", "place",
        F.row_number().over(inside).alias("rank"),
        F.coalesce((before == F.col("place")) | ((role_before == "user") & (F.col("role") == "user")), F.lit(False)).alias("bad"),
    )
    order = F.struct("place", "delivery_seq")
    parts = checked.groupBy("conversation", "part").agg(
        F.count("*").alias("n"), F.max("bad").alias("bad"), F.min_by("role", order).alias("first"), F.max_by("role", order).alias("last")
    )
    along = Window.partitionBy("conversation").orderBy("part")
    whole = Window.partitionBy("conversation")
    previous = F.lag("last").over(along)
    met = F.when(previous.isNull(), F.col("first") != "user").otherwise((previous == "user") & (F.col("first") == "user"))
    ended = F.lead("part").over(along).isNull() & (F.col("last") != "assistant")
    judged = parts.select("conversation", "part", (F.sum("n").over(along) - F.col("n")).alias("offset"), (F.col("bad") | met | ended).alias("bad"))
    sound = judged.withColumn("broken", F.max("bad").over(whole)).where("NOT broken").select("conversation", "part", "offset")
    return checked.join(sound, ["conversation", "part"]).select(
        "conversation", (F.col("rank") + F.col("offset")).cast("int").alias("turn"), "role", "delivery_seq"
    )


def conversations(events: DataFrame, long: int = LONG, ranges: int = RANGES) -> DataFrame:
    """The sound conversations of an event feed: ``(session_id, turn, role, delivery_seq)``.

    Messages are the first deliveries of type USER_MESSAGE or ASSISTANT_MESSAGE whose text has a letter or digit. A
    conversation is unsound, and left out as a whole, if a place is null, two messages have one place, the first is not
    the user's, the last not the assistant's, or two user messages follow each other.

    Nulls: a message without session belongs to the conversation that its reply and quote links reach, see
    ``with_conversations``; one without ``delivery_seq`` is ignored, one without text is no message. Repeated rows are
    repeated deliveries. An empty table gives no rows. Extra columns are ignored.
    """
    events = events.where("delivery_seq IS NOT NULL").select("delivery_seq", "id", "session_id", "ordinal", "ts", "type", "dedupe_hash", "payload")
    rows = written(with_conversations(messages(events), events), "messages")
    return rebuilt(rows, long, ranges).select(F.col("conversation").alias("session_id"), "turn", "role", "delivery_seq")
