"""Queries of the analytics layer and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import metrics, triage
from eventloom.plans.triage import _TRIAGED


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_totals(spark, sf_dir):
    """Tokens spoken in each session: user, assistant, turns and the largest single turn."""
    spoken = _read(spark, sf_dir, "session_events").where("type IN ('USER_MESSAGE', 'ASSISTANT_MESSAGE') AND session_id IS NOT NULL")
    tokens = T.estimated_tokens(F.coalesce("payload.text", F.lit("")))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, tokens)), F.lit(0))
    return spoken.groupBy("session_id").agg(
        of("USER_MESSAGE").alias("user_tokens"), of("ASSISTANT_MESSAGE").alias("assistant_tokens"),
        F.count_if(F.col("type") == "ASSISTANT_MESSAGE").alias("turns"), F.max(tokens).alias("peak"),
    )


def precision_stats(spark, sf_dir):
    """How many items of each category were never used, retired within an hour, unsure or unverified."""
    items = _read(spark, sf_dir, "memory_items")
    age = F.unix_seconds(F.col("updated_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    return items.groupBy("category").agg(
        F.count("*").alias("items"),
        F.count_if(F.coalesce("retrieved_count", F.lit(0)) == 0).alias("never_retrieved"),
        F.count_if(F.col("status").isin("superseded", "archived", "deleted") & (age <= 3600)).alias("retired_early"),
        F.count_if(F.col("confidence") < 0.6).alias("unsure"),
        F.count_if(F.array_contains("tags", "unverified")).alias("unverified"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def retrieval_stats(spark, sf_dir):
    """Use of memory items by status and importance."""
    return _read(spark, sf_dir, "memory_items").groupBy("status", "importance").agg(
        F.count("*").alias("items"), F.coalesce(F.sum("retrieved_count"), F.lit(0)).cast("bigint").alias("retrievals"),
        F.countDistinct("category").alias("categories"), F.max("last_used_at").alias("last_used"),
    )


def latency_percentiles(spark, sf_dir):
    """Median, 95th percentile and maximum of the measured value of each kind of event."""
    rows = _read(spark, sf_dir, "events")
    found = metrics.floor_index_percentiles(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.join(rows.groupBy("event_type").agg(F.max("value").alias("highest"), F.count("value").alias("n")), "event_type")


def last_activity(spark, sf_dir):
    """The last event or session end of each source."""
    events = _read(spark, sf_dir, "session_events").select("source", F.col("ts").alias("at"))
    sessions = _read(spark, sf_dir, "agent_sessions").select("source", F.col("ended_at").alias("at"))
    return events.unionAll(sessions).groupBy("source").agg(F.max("at").alias("last_at"), F.count("at").alias("n"))


def sessions_with_counts(spark, sf_dir):
    """Every session with the number of its events, none included."""
    counts = _read(spark, sf_dir, "session_events").groupBy("session_id").agg(F.count("*").alias("events"))
    sessions = _read(spark, sf_dir, "agent_sessions").select(F.col("id").alias("session_id"), "agent")
    return sessions.join(counts, "session_id", "left").select("session_id", "agent", F.coalesce("events", F.lit(0)).alias("events"))


def recent_sessions(spark, sf_dir, n: int = 50):
    """The sessions with the latest events."""
    last = _read(spark, sf_dir, "session_events").where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("ts").alias("last_at"))
    return last.orderBy(F.desc("last_at"), "session_id").limit(n)


def session_state(spark, sf_dir):
    """The latest known source and the first and last time of each session, from its events."""
    rows = _read(spark, sf_dir, "session_events").where("session_id IS NOT NULL")
    known = metrics.latest(rows, "session_id", F.col("delivery_seq"), "source")
    times = rows.groupBy("session_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return known.join(times, "session_id")


def daily_history(spark, sf_dir):
    """Events, new items and patches of each day."""
    day = lambda df, col, name: df.where(F.col(col).isNotNull()).groupBy(F.to_date(col).alias("day")).agg(F.count("*").alias(name))
    events = day(_read(spark, sf_dir, "session_events"), "ts", "events")
    items = day(_read(spark, sf_dir, "memory_items"), "created_at", "items")
    patches = day(_read(spark, sf_dir, "patches"), "created_at", "patches")
    every = events.unionByName(items, True).unionByName(patches, True).groupBy("day")
    return every.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("events", "items", "patches")])


def weekly_history(spark, sf_dir):
    """The daily history by weeks that begin on Monday."""
    week = F.to_date(F.date_trunc("week", "day")).alias("week")
    return daily_history(spark, sf_dir).groupBy(week).agg(*[F.sum(x).alias(x) for x in ("events", "items", "patches")])


def prompt_growth(spark, sf_dir):
    """Tokens that each session's assistant turns would read if the whole past were sent again each time."""
    rows = _read(spark, sf_dir, "session_events").where("session_id IS NOT NULL").select(
        "session_id", "delivery_seq", "type", T.estimated_tokens(T.event_text()).alias("tokens")
    )
    turns = metrics.running_sum(rows, "session_id", "delivery_seq", "tokens", "past").where("type = 'ASSISTANT_MESSAGE'")
    return turns.groupBy("session_id").agg(F.sum("past").alias("prompt_tokens"), F.count("*").alias("turns"), F.max("past").alias("largest"))


def never_used_steps(spark, sf_dir):
    """How many items were there and had not been used yet, at each time that this changed."""
    items = _read(spark, sf_dir, "memory_items").where("created_at IS NOT NULL")
    born = items.select(F.col("created_at").alias("at"), F.lit(1).alias("d"))
    used = items.where("last_used_at IS NOT NULL").select(F.greatest("last_used_at", "created_at").alias("at"), F.lit(-1).alias("d"))
    steps = metrics.running_steps(born.unionAll(used), "at", "d", F.to_date("at"))
    return steps.select(F.col("at").alias("moment"), F.col("total").alias("never_used"))


def resumes(spark, sf_dir):
    """Session starts of each source that come more than ten minutes after the start before."""
    starts = _read(spark, sf_dir, "session_events").where("type = 'SESSION_STARTED' AND session_id IS NOT NULL")
    return metrics.gap_openers(starts.select("delivery_seq", "session_id", "ts"), "session_id", "ts", "delivery_seq", 600)


def resume_counts(spark, sf_dir):
    """Resumes and repeats of each session, and the tokens of its kept events."""
    starts = _read(spark, sf_dir, "session_events").where("type = 'SESSION_STARTED' AND session_id IS NOT NULL AND ts IS NOT NULL")
    opened = resumes(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("resumes"))
    return starts.groupBy("session_id").agg(F.count("*").alias("starts")).join(opened, "session_id").select(
        "session_id", "resumes", (F.col("starts") - F.col("resumes")).alias("repeats")
    )


def events_by_category(spark, sf_dir):
    """Kept events of each type with the share that needs no model."""
    rows = triage.triaged(_read(spark, sf_dir, "session_events"))
    return rows.groupBy("type").agg(
        F.count("*").alias("events"), F.count_if(F.col("action") == "discard").alias("discarded"),
        F.count_if(F.col("action") == "persist_and_queue").alias("queued"),
        F.round(F.count_if(F.col("action") != "persist_and_queue") / F.count("*"), 6).alias("settled_share"),
    )


def coverage(spark, sf_dir):
    """Of each session: stored, queued and settled events, and the settled part of all that are stored."""
    rows = triage.triaged(_read(spark, sf_dir, "session_events")).where("session_id IS NOT NULL")
    counts = rows.groupBy("session_id").agg(
        F.count_if(F.col("action") != "discard").alias("stored"), F.count_if(F.col("action") == "persist_and_queue").alias("pending")
    )
    derived = F.col("stored") - F.col("pending")
    return counts.select("session_id", "stored", "pending", F.when(F.col("stored") > 0, F.round(derived / F.col("stored"), 6)).otherwise(0.0).alias("coverage"))


def _loud():
    """Whether any text field of an event has text, without putting them together."""
    parts = [F.coalesce(F.col(f"payload.{x}") != "", F.lit(False)) for x in ("text", "command", "output", "error")]
    return parts[0] | parts[1] | parts[2] | parts[3]


def quiet_streak(spark, sf_dir):
    """The length of the run of events without text with which each session ends, of its last 20."""
    rows = _read(spark, sf_dir, "session_events").where("session_id IS NOT NULL").select("session_id", "delivery_seq", _loud().alias("loud"))
    newest = Window.partitionBy("session_id").orderBy(F.desc("delivery_seq"))
    last = rows.withColumn("n", F.row_number().over(newest)).where("n <= 20")
    breaks = last.withColumn("breaks", F.sum(F.col("loud").cast("int")).over(newest))
    return breaks.groupBy("session_id").agg(F.count_if(F.col("breaks") == 0).alias("streak"))


def keep_last(spark, sf_dir, n: int = 500):
    """The newest measurements of each kind, as many as a log keeps, summed up."""
    kept = metrics.newest_of_each(_read(spark, sf_dir, "events"), "event_type", [F.desc("event_id")], n)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"), F.round(F.sum("value"), 4).alias("total"))


def trailing_hour(spark, sf_dir):
    """For every measured event, what its user used in the hour up to it."""
    rows = _read(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    # A row is seen in its own hour and looked back on from the next, so a user with many rows is split by hours.
    own = F.floor(F.col("s") / 3600)
    seen = rows.select("event_id", "user_id", "value", "s", F.explode(F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own")))).alias("h"))
    hour = Window.partitionBy("user_id", "h.b").orderBy("s").rangeBetween(-3600, 0)
    summed = seen.select("event_id", "h.own", F.count("*").over(hour).alias("calls"), F.round(F.sum("value").over(hour), 4).alias("used"))
    return summed.where("own").drop("own")


def avoided_tokens(spark, sf_dir, budget: int = 600):
    """Tokens that resumed sessions did not read again, being given a context of ``budget`` instead of their past: by day, and
    all up to that day."""
    rows = _read(spark, sf_dir, "session_events").where("session_id IS NOT NULL").select("session_id", "delivery_seq", "type", T.estimated_tokens(T.event_text()).alias("tokens"))
    past = metrics.running_sum(rows, "session_id", "delivery_seq", "tokens", "past").where("type = 'SESSION_STARTED'").select("delivery_seq", "past")
    saved = past.join(resumes(spark, sf_dir), "delivery_seq").where("ts IS NOT NULL").select(F.to_date("ts").alias("day"), F.greatest(F.lit(0), F.col("past") - budget).alias("avoided"))
    days = saved.groupBy("day").agg(F.sum("avoided").alias("avoided"), F.count("*").alias("resumes"))
    return days.withColumn("upto", F.sum("avoided").over(Window.orderBy("day")))  # a row for each day


def context_reduction(spark, sf_dir, budget: int = 600):
    """Of each session: its tokens, those of its context, the part that the context saves, and that part of what is settled."""
    rows = triage.triaged(_read(spark, sf_dir, "session_events")).where("session_id IS NOT NULL AND action <> 'discard'")
    sums = rows.groupBy("session_id").agg(F.sum("tokens").alias("raw"), F.round(F.count_if(F.col("action") == "persist") / F.count("*"), 6).alias("settled"))
    active = F.least(F.col("raw"), F.lit(budget))
    reduction = F.when(F.col("raw") > 0, F.round(1 - active / F.col("raw"), 6)).otherwise(0.0)
    return sums.select("session_id", "raw", active.alias("active"), reduction.alias("reduction"), F.round(reduction * F.col("settled"), 6).alias("effective"))


def project_overview(spark, sf_dir):
    """Documents of each project: how many, languages and characters."""
    return _read(spark, sf_dir, "documents").groupBy("project").agg(
        F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"), F.sum(F.length("text")).alias("chars"), F.max("created_at").alias("newest")
    )


def pricing_summary(spark, sf_dir):
    """Order lines by return flag and status: sums and means."""
    rows = _read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(paid), 2).alias("sum_paid"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        usage_totals, precision_stats, retrieval_stats, latency_percentiles, last_activity, sessions_with_counts, recent_sessions, session_state,
        daily_history, weekly_history, prompt_growth, never_used_steps, resumes, resume_counts, events_by_category, coverage, quiet_streak,
        keep_last, trailing_hour, avoided_tokens, context_reduction, project_overview, pricing_summary,
    )
}

_BEYOND = "length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
_TOK = "CAST(ceil((length({0}) + " + _BEYOND + ") / 4.0) AS BIGINT)"
_DAILY = """
    SELECT day, CAST(sum(events) AS BIGINT) AS events, CAST(sum(items) AS BIGINT) AS items, CAST(sum(patches) AS BIGINT) AS patches FROM (
        SELECT CAST(ts AS DATE) AS day, 1 AS events, 0 AS items, 0 AS patches FROM session_events WHERE ts IS NOT NULL
        UNION ALL SELECT CAST(created_at AS DATE), 0, 1, 0 FROM memory_items WHERE created_at IS NOT NULL
        UNION ALL SELECT CAST(created_at AS DATE), 0, 0, 1 FROM patches WHERE created_at IS NOT NULL) GROUP BY day"""
_RESUMES = """
    SELECT delivery_seq, session_id, ts FROM (
        SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, delivery_seq) AS before FROM session_events
        WHERE type = 'SESSION_STARTED' AND session_id IS NOT NULL AND ts IS NOT NULL)
    WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 600000000"""
_EVENT_TEXT = "concat_ws(chr(10), nullif(payload.text, ''), nullif(payload.command, ''), nullif(payload.output, ''), nullif(payload.error, ''))"
SQL = {
    "usage_totals": f"""
        SELECT session_id, CAST(coalesce(sum(n) FILTER (type = 'USER_MESSAGE'), 0) AS BIGINT) AS user_tokens,
               CAST(coalesce(sum(n) FILTER (type = 'ASSISTANT_MESSAGE'), 0) AS BIGINT) AS assistant_tokens,
               count(*) FILTER (type = 'ASSISTANT_MESSAGE') AS turns, max(n) AS peak
        FROM (SELECT *, {_TOK.format("coalesce(payload.text, '')")} AS n FROM session_events
              WHERE type IN ('USER_MESSAGE', 'ASSISTANT_MESSAGE') AND session_id IS NOT NULL) GROUP BY session_id""",
    "precision_stats": """
        SELECT category, count(*) AS items, count(*) FILTER (coalesce(retrieved_count, 0) = 0) AS never_retrieved,
               count(*) FILTER (status IN ('superseded', 'archived', 'deleted') AND floor(epoch(updated_at)) - floor(epoch(created_at)) <= 3600) AS retired_early,
               count(*) FILTER (confidence < 0.6) AS unsure, count(*) FILTER (list_contains(tags, 'unverified')) AS unverified,
               round(avg(confidence), 6) AS mean_confidence
        FROM memory_items GROUP BY category""",
    "retrieval_stats": """
        SELECT status, importance, count(*) AS items, CAST(coalesce(sum(retrieved_count), 0) AS BIGINT) AS retrievals,
               count(DISTINCT category) AS categories, max(last_used_at) AS last_used FROM memory_items GROUP BY status, importance""",
    "latency_percentiles": """
        SELECT event_type, v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] AS p95,
               v[n] AS highest, n
        FROM (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)""",
    "last_activity": """
        SELECT source, max(moment) AS last_at, count(moment) AS n FROM (
            SELECT source, ts AS moment FROM session_events UNION ALL SELECT source, ended_at FROM agent_sessions) GROUP BY source""",
    "sessions_with_counts": """
        SELECT id AS session_id, agent, (SELECT count(*) FROM session_events e WHERE e.session_id = s.id) AS events FROM agent_sessions s""",
    "recent_sessions": """
        SELECT session_id, max(ts) AS last_at FROM session_events WHERE session_id IS NOT NULL GROUP BY session_id
        ORDER BY last_at DESC NULLS LAST, session_id LIMIT 50""",
    "session_state": """
        SELECT session_id, arg_max(source, delivery_seq) FILTER (source IS NOT NULL) AS source, min(ts) AS first_at, max(ts) AS last_at
        FROM session_events WHERE session_id IS NOT NULL GROUP BY session_id""",
    "daily_history": _DAILY,
    "weekly_history": f"""
        SELECT CAST(date_trunc('week', day) AS DATE) AS week, CAST(sum(events) AS BIGINT) AS events, CAST(sum(items) AS BIGINT) AS items,
               CAST(sum(patches) AS BIGINT) AS patches FROM ({_DAILY}) GROUP BY 1""",
    "prompt_growth": f"""
        SELECT session_id, CAST(sum(past) AS BIGINT) AS prompt_tokens, count(*) AS turns, CAST(max(past) AS BIGINT) AS largest FROM (
            SELECT session_id, type, sum({_TOK.format('t')}) OVER (PARTITION BY session_id ORDER BY delivery_seq) AS past
            FROM (SELECT *, {_EVENT_TEXT} AS t FROM session_events WHERE session_id IS NOT NULL))
        WHERE type = 'ASSISTANT_MESSAGE' GROUP BY session_id""",
    "never_used_steps": """
        SELECT moment, CAST(sum(sum(d)) OVER (ORDER BY moment) AS BIGINT) AS never_used FROM (
            SELECT created_at AS moment, 1 AS d FROM memory_items WHERE created_at IS NOT NULL
            UNION ALL SELECT greatest(last_used_at, created_at), -1 FROM memory_items WHERE created_at IS NOT NULL AND last_used_at IS NOT NULL)
        GROUP BY moment""",
    "resumes": _RESUMES,
    "resume_counts": f"""
        WITH o AS ({_RESUMES})
        SELECT s.session_id, o.n AS resumes, s.n - o.n AS repeats
        FROM (SELECT session_id, count(*) AS n FROM session_events WHERE type = 'SESSION_STARTED' AND session_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1) s
        JOIN (SELECT session_id, count(*) AS n FROM o GROUP BY 1) o USING (session_id)""",
    "events_by_category": f"""
        WITH {_TRIAGED}
        SELECT type, count(*) AS events, count(*) FILTER (action = 'discard') AS discarded, count(*) FILTER (action = 'persist_and_queue') AS queued,
               round(count(*) FILTER (action <> 'persist_and_queue') / count(*), 6) AS settled_share FROM triaged GROUP BY type""",
    "coverage": f"""
        WITH {_TRIAGED}, c AS (
            SELECT session_id, count(*) FILTER (action <> 'discard') AS stored, count(*) FILTER (action = 'persist_and_queue') AS pending
            FROM triaged WHERE session_id IS NOT NULL GROUP BY session_id)
        SELECT session_id, stored, pending, CASE WHEN stored > 0 THEN round((stored - pending) / stored, 6) ELSE 0.0 END AS coverage FROM c""",
    "quiet_streak": f"""
        SELECT session_id, count(*) FILTER (breaks = 0) AS streak FROM (
            SELECT session_id, n, sum(CASE WHEN {_EVENT_TEXT} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY delivery_seq DESC) AS breaks
            FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY delivery_seq DESC) AS n FROM session_events WHERE session_id IS NOT NULL)
            WHERE n <= 20) GROUP BY session_id""",
    "keep_last": """
        SELECT event_type, count(*) AS n, min(event_id) AS oldest, round(sum(value), 4) AS total FROM (
            SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 500 GROUP BY event_type""",
    "trailing_hour": """
        SELECT event_id, count(*) OVER w AS calls, round(sum(value) OVER w, 4) AS used FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
        WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""",
    "avoided_tokens": f"""
        WITH o AS ({_RESUMES}), p AS (
            SELECT delivery_seq, ts, type, sum({_TOK.format(_EVENT_TEXT)}) OVER (PARTITION BY session_id ORDER BY delivery_seq ROWS UNBOUNDED PRECEDING) AS past
            FROM session_events WHERE session_id IS NOT NULL),
        d AS (SELECT CAST(p.ts AS DATE) AS day, CAST(sum(greatest(0, past - 600)) AS BIGINT) AS avoided, count(*) AS resumes FROM p JOIN o USING (delivery_seq) WHERE p.type = 'SESSION_STARTED' GROUP BY 1)
        SELECT day, avoided, resumes, CAST(sum(avoided) OVER (ORDER BY day) AS BIGINT) AS upto FROM d""",
    "context_reduction": f"""
        WITH {_TRIAGED}, s AS (
            SELECT session_id, CAST(sum(tokens) AS BIGINT) AS raw, round(count(*) FILTER (action = 'persist') / count(*), 6) AS settled FROM triaged
            WHERE session_id IS NOT NULL AND action <> 'discard' GROUP BY session_id),
        r AS (SELECT *, least(raw, 600) AS active, CASE WHEN raw > 0 THEN round(1 - least(raw, 600) / raw, 6) ELSE 0.0 END AS reduction FROM s)
        SELECT session_id, raw, active, reduction, round(reduction * settled, 6) AS effective FROM r""",
    "project_overview": """
        SELECT project, count(*) AS documents, count(DISTINCT lang) AS languages, CAST(sum(length(text)) AS BIGINT) AS chars, max(created_at) AS newest
        FROM documents GROUP BY project""",
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_paid,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
}
