"""Queries of item state and patch checks and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import patches as P
from eventloom.operators import state

AS_OF = "2026-05-01 00:00:00"
UP_TO = 20


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def live_items(spark, sf_dir):
    """Items that are active and within their time to live."""
    return _read(spark, sf_dir, "memory_items").where(state.live(AS_OF)).select("id", "category", "importance")


def decayed_items(spark, sf_dir):
    """Active items whose time to live has passed."""
    return _read(spark, sf_dir, "memory_items").where((F.col("status") == "active") & ~state.live(AS_OF)).select("id", "ttl_seconds")


def item_flags(spark, sf_dir):
    """Whether each item is protected, closed, closable and always shown."""
    return _read(spark, sf_dir, "memory_items").select(
        "id", state.protected().alias("protected"), F.coalesce(state.closed(), F.lit(False)).alias("closed"),
        F.coalesce(F.col("category").isin(*state.CLOSABLE), F.lit(False)).alias("closable"), state.always_shown(0.8).alias("always_shown"),
    )


def category_listing(spark, sf_dir, n: int = 50):
    """The first items of each category by importance and last change."""
    from eventloom.operators.metrics import newest_of_each

    rows = _read(spark, sf_dir, "memory_items").where("status = 'active' AND category IS NOT NULL")
    order = [F.desc_nulls_last(T.importance_rank(F.col("importance"))), F.desc_nulls_last("updated_at"), F.col("id")]
    return newest_of_each(rows, "category", order, n).select("category", "id", "importance")


def supersession_chains(spark, sf_dir):
    """The item that stands at the end of each superseded item's chain."""
    return state.final_successors(_read(spark, sf_dir, "memory_items"))


def evidence_checks(spark, sf_dir):
    """How much of each item's evidence is among the events."""
    return state.evidence_found(_read(spark, sf_dir, "memory_items"), _read(spark, sf_dir, "session_events"))


def patch_op_counts(spark, sf_dir):
    """Operations of each store by kind."""
    ops = state.patch_operations(_read(spark, sf_dir, "patches"))
    return ops.groupBy("store_id", "op").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


def patch_unknown_targets(spark, sf_dir):
    """Operations on items that the log has not added."""
    return state.unknown_targets(_read(spark, sf_dir, "patches"))


def patch_violations(spark, sf_dir):
    """Patches that change the unknown, add again, supersede themselves or do nothing."""
    return state.violations(_read(spark, sf_dir, "patches"))


def patch_repeated_additions(spark, sf_dir):
    """Additions that say again what the store was told."""
    return state.repeated_additions(_read(spark, sf_dir, "patches"))


def touched_items(spark, sf_dir):
    """How often and when last each item of a store was touched."""
    rows = _read(spark, sf_dir, "patches").where("store_id IS NOT NULL AND seq IS NOT NULL")
    one = rows.groupBy("store_id", "seq").agg(F.min_by(F.struct("patch", "created_at"), F.struct("received_at", "id")).alias("p"))
    each = one.select("store_id", F.explode("p.patch.touch_ids").alias("item_id"), F.col("p.created_at").alias("moment"))
    return each.where("item_id IS NOT NULL").groupBy("store_id", "item_id").agg(F.count("*").alias("touches"), F.max("moment").alias("last_touched"))


def replay_as_of(spark, sf_dir):
    """The items that every store held after the first places of its log."""
    return P.current_items(_read(spark, sf_dir, "patches").where(F.col("seq") <= UP_TO))


def replay_difference(spark, sf_dir):
    """Items that a store holds at the end but not after the first places of its log, or the other way round."""
    rows = _read(spark, sf_dir, "patches")
    end = P.current_items(rows).select("store_id", "item_id", F.lit("added").alias("change"))
    then = P.current_items(rows.where(F.col("seq") <= UP_TO)).select("store_id", "item_id", F.lit("gone").alias("change"))
    keys = ["store_id", "item_id"]
    return end.join(then, keys, "left_anti").unionByName(then.join(end, keys, "left_anti"))


def store_items(spark, sf_dir):
    """The items that every store holds at the end, with all their parts."""
    return P.current_items(_read(spark, sf_dir, "patches"), parts=P.DETAILS)


def store_working(spark, sf_dir):
    """The working memory of every store at the end."""
    return P.working_memory(_read(spark, sf_dir, "patches"))


def store_versions(spark, sf_dir):
    """The version that every store reaches, and how many of its patches count."""
    log = P.written(P.ordered_log(_read(spark, sf_dir, "patches")).select("store_id", "seq", "base", "new", F.struct("seq").alias("body")), "versions-log")
    reached = P.accepted_patches(log).groupBy("store_id").agg(F.count("*").alias("accepted"), F.max_by(F.struct("new"), "seq").alias("v"))
    return reached.select("store_id", "accepted", F.col("v.new").alias("version"))


QUERIES = {
    f.__name__: f
    for f in (
        live_items, decayed_items, item_flags, category_listing, supersession_chains, evidence_checks, patch_op_counts, patch_unknown_targets, patch_violations,
        patch_repeated_additions, touched_items, replay_as_of, replay_difference, store_items, store_working, store_versions,
    )
}

_AGE = f"epoch(TIMESTAMP '{AS_OF}') - floor(epoch(coalesce(last_validated_at, updated_at, created_at)))"
_LIVE = f"(status = 'active' AND (ttl_seconds IS NULL OR coalesce({_AGE} <= ttl_seconds, true)))"
_LOG = "log AS (SELECT store_id, seq, arg_min(patch, (received_at, id)) AS patch FROM patches WHERE store_id IS NOT NULL AND seq IS NOT NULL GROUP BY store_id, seq)"
_ALL = "log_all AS (SELECT store_id, seq, p.patch AS patch FROM (SELECT store_id, seq, arg_min({'patch': patch}, (received_at, id)) AS p FROM patches WHERE store_id IS NOT NULL AND seq IS NOT NULL GROUP BY store_id, seq))"
_OPS = f"""{_LOG}, {_ALL}, ops AS (
    SELECT store_id, seq, o.op AS op, o.item_id AS item_id, o.category AS category, o.text AS text, place FROM (
        SELECT store_id, seq, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS place FROM (
            SELECT store_id, seq, list_concat(
                list_transform(coalesce(patch.add_items, []), lambda x: {{'op': 'add', 'item_id': x.id, 'category': x.category, 'text': x.text}}),
                list_transform(coalesce(patch.update_items, []), lambda x: {{'op': 'update', 'item_id': x.id, 'category': NULL::VARCHAR, 'text': NULL::VARCHAR}}),
                list_transform(coalesce(patch.remove_ids, []), lambda x: {{'op': 'remove', 'item_id': x, 'category': NULL::VARCHAR, 'text': NULL::VARCHAR}}),
                list_transform(coalesce(patch.supersede_items, []), lambda x: {{'op': 'supersede', 'item_id': x.id, 'category': NULL::VARCHAR, 'text': NULL::VARCHAR}}),
                list_transform(coalesce(patch.touch_ids, []), lambda x: {{'op': 'touch', 'item_id': x, 'category': NULL::VARCHAR, 'text': NULL::VARCHAR}})) AS l
            FROM log)))"""
def _accepted(where: str = "true") -> str:
    """The log walked patch by patch."""
    return f"""firsts AS (
        SELECT store_id, seq, unnest(arg_min({{'base': base_version, 'new': new_version, 'patch': patch}}, (received_at, id))) FROM patches
        WHERE store_id IS NOT NULL AND seq IS NOT NULL AND {where} GROUP BY store_id, seq),
    placed AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY seq) AS k FROM firsts),
    walk AS (
        SELECT store_id, 0::BIGINT AS k, 0::BIGINT AS version, false AS taken FROM (SELECT DISTINCT store_id FROM placed)
        UNION ALL
        SELECT p.store_id, p.k, CASE WHEN coalesce(p.base = w.version, false) THEN p.new ELSE w.version END, coalesce(p.base = w.version, false)
        FROM walk w JOIN placed p ON p.store_id = w.store_id AND p.k = w.k + 1),
    accepted AS (SELECT p.* FROM placed p JOIN walk w USING (store_id, k) WHERE w.taken)"""


def items_sql(where: str = "true", detailed: bool = False) -> str:
    """Common tables that end in ``held``: the items of every store, walked operation by operation."""
    none = "NULL::VARCHAR"
    one = lambda rank, var, item, **given: f"list_transform({var}, lambda x: {{'rank': {rank}, 'item': {item}, " + ", ".join(
        f"'{n}': {given.get(n, 'NULL::DOUBLE' if n == 'confidence' else none)}" for n in P.DETAILS
    ) + "})"
    bound = f"coalesce(CASE WHEN x.source = 'user' THEN x.confidence WHEN x.confidence IS NOT NULL THEN least(x.confidence, {P.MOST_INFERRED}) END, {P.CONFIDENCE})"
    added = one(0, "coalesce(patch.add_items, [])", "x.id", status="'active'", importance="coalesce(x.importance, 'medium')", category="x.category", text="x.text",
                confidence=bound, source="coalesce(x.source, 'worker')", reason="x.reason")
    updated = one(1, "coalesce(patch.update_items, [])", "x.id", status="x.status", importance="x.importance", text="x.text", confidence="x.confidence", reason="x.reason")
    removed = one(2, "coalesce(patch.remove_ids, [])", "x")
    retired = one(3, "coalesce(patch.supersede_items, [])", "x.id", status="'superseded'", superseded_by="x.by_id", reason="x.reason")
    parts = list(P.DETAILS if detailed else P.PARTS)
    step = lambda n: f"CASE WHEN o.rank = 0 THEN CASE WHEN s.alive THEN s.{n} ELSE o.{n} END ELSE coalesce(o.{n}, s.{n}) END AS {n}"
    return f"""{_accepted(where)},
    listed AS (SELECT store_id, seq, new, list_concat({added}, {updated}, {removed}, {retired}) AS l FROM accepted),
    opened AS (SELECT store_id, seq, new, unnest(l) AS o, generate_subscripts(l, 1) AS place FROM listed),
    numbered AS (
        SELECT store_id, new, o.item AS item_id, o.rank AS rank, {', '.join(f'o.{n} AS {n}' for n in parts)},
               row_number() OVER (PARTITION BY store_id, o.item ORDER BY seq, place) AS k FROM opened WHERE o.item IS NOT NULL),
    states AS (
        SELECT store_id, item_id, 0::BIGINT AS k, false AS alive, {', '.join(f"NULL::{'DOUBLE' if n == 'confidence' else 'VARCHAR'} AS {n}" for n in parts)}, NULL::BIGINT AS version
        FROM (SELECT DISTINCT store_id, item_id FROM numbered)
        UNION ALL
        SELECT o.store_id, o.item_id, o.k, CASE o.rank WHEN 0 THEN true WHEN 2 THEN false ELSE s.alive END, {', '.join(step(n) for n in parts)},
               CASE WHEN (o.rank = 0 AND s.alive) OR o.rank = 2 THEN s.version ELSE o.new END
        FROM states s JOIN numbered o ON o.store_id = s.store_id AND o.item_id = s.item_id AND o.k = s.k + 1),
    held AS (SELECT store_id, item_id, {', '.join(parts)}, version FROM states s WHERE alive AND k = (SELECT max(k) FROM numbered n WHERE n.store_id = s.store_id AND n.item_id = s.item_id))"""


SQL = {
    "live_items": f"SELECT id, category, importance FROM memory_items WHERE {_LIVE}",
    "decayed_items": f"SELECT id, ttl_seconds FROM memory_items WHERE status = 'active' AND NOT {_LIVE}",
    "item_flags": """
        SELECT id, coalesce(source = 'user' AND importance = 'critical', false) AS protected,
               coalesce(fields['closed_at'] IS NOT NULL, false) AS closed,
               coalesce(category IN ('goals', 'requirements', 'open_questions', 'known_issues'), false) AS closable,
               NOT coalesce(fields['closed_at'] IS NOT NULL, false) AND coalesce(source = 'user' OR importance = 'critical' OR confidence >= 0.8, false) AS always_shown
        FROM memory_items""",
    "category_listing": """
        SELECT category, id, importance FROM (
            SELECT *, row_number() OVER (PARTITION BY category ORDER BY list_position(['ephemeral', 'low', 'medium', 'high', 'critical'], importance) DESC NULLS LAST,
                                         updated_at DESC NULLS LAST, id) AS k
            FROM memory_items WHERE status = 'active' AND category IS NOT NULL) WHERE k <= 50""",
    "supersession_chains": """
        WITH RECURSIVE steps AS (SELECT id, superseded_by AS next FROM memory_items WHERE superseded_by IS NOT NULL AND id IS NOT NULL AND superseded_by <> id),
        walk AS (
            SELECT id, next AS final_id, CAST(1 AS BIGINT) AS hops FROM steps
            UNION ALL SELECT w.id, s.next, w.hops + 1 FROM walk w JOIN steps s ON s.id = w.final_id WHERE w.hops < 200)
        SELECT id, final_id, hops FROM walk WHERE final_id NOT IN (SELECT id FROM steps)""",
    "evidence_checks": """
        SELECT n.id, count(*) AS named, count(k.event) AS found
        FROM (SELECT id, unnest(list_distinct(evidence)) AS event FROM memory_items WHERE id IS NOT NULL) n
        LEFT JOIN (SELECT DISTINCT id AS event FROM session_events) k ON k.event = n.event GROUP BY n.id""",
    "patch_op_counts": f"WITH {_OPS} SELECT store_id, op, count(*) AS n, count(DISTINCT item_id) AS items FROM ops GROUP BY store_id, op",
    "patch_unknown_targets": f"""
        WITH {_OPS}, added AS (SELECT store_id, item_id, min(seq) AS added FROM ops WHERE op = 'add' AND item_id IS NOT NULL GROUP BY ALL)
        SELECT o.store_id, o.seq, o.op, o.item_id FROM ops o LEFT JOIN added a ON a.store_id = o.store_id AND a.item_id = o.item_id
        WHERE o.op <> 'add' AND o.item_id IS NOT NULL AND (a.added IS NULL OR a.added > o.seq)""",
    "patch_violations": f"""
        WITH {_OPS}, added AS (SELECT store_id, item_id, min(seq) AS added FROM ops WHERE op = 'add' AND item_id IS NOT NULL GROUP BY ALL),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY store_id, item_id ORDER BY seq, place) AS k FROM ops WHERE op = 'add' AND item_id IS NOT NULL)
        SELECT DISTINCT o.store_id, o.seq, 'unknown_item' AS code, o.item_id FROM ops o LEFT JOIN added a ON a.store_id = o.store_id AND a.item_id = o.item_id
        WHERE o.op <> 'add' AND o.item_id IS NOT NULL AND (a.added IS NULL OR a.added > o.seq)
        UNION ALL SELECT DISTINCT store_id, seq, 'duplicate_id', item_id FROM numbered WHERE k > 1
        UNION ALL SELECT DISTINCT store_id, seq, 'self_supersede', x.id FROM (SELECT store_id, seq, unnest(patch.supersede_items) AS x FROM log) WHERE x.id = x.by_id
        UNION ALL SELECT store_id, seq, 'empty_patch', NULL FROM log_all WHERE patch IS NULL OR (coalesce(len(patch.add_items), 0) + coalesce(len(patch.update_items), 0)
            + coalesce(len(patch.remove_ids), 0) + coalesce(len(patch.supersede_items), 0) + coalesce(len(patch.touch_ids), 0) + coalesce(cardinality(patch.working), 0)) = 0""",
    "patch_repeated_additions": f"""
        WITH {_OPS}
        SELECT store_id, seq, CAST(place AS INT) AS place, item_id FROM (
            SELECT *, row_number() OVER (PARTITION BY store_id, category,
                regexp_replace(regexp_replace(trim(lower(text), ' '), '\\s+', ' ', 'g'), '[.;:!]+$', '') ORDER BY seq, place) AS k
            FROM ops WHERE op = 'add' AND text IS NOT NULL) WHERE k > 1""",
    "touched_items": """
        SELECT store_id, item_id, count(*) AS touches, max(moment) AS last_touched FROM (
            SELECT store_id, unnest(p.patch.touch_ids) AS item_id, p.created_at AS moment FROM (
                SELECT store_id, seq, arg_min({'patch': patch, 'created_at': created_at}, (received_at, id)) AS p FROM patches
                WHERE store_id IS NOT NULL AND seq IS NOT NULL GROUP BY store_id, seq))
        WHERE item_id IS NOT NULL GROUP BY store_id, item_id""",
    "replay_as_of": f"WITH RECURSIVE {items_sql(f'seq <= {UP_TO}')} SELECT * FROM held",
    "replay_difference": f"""
        WITH ends AS (WITH RECURSIVE {items_sql()} SELECT store_id, item_id FROM held),
        thens AS (WITH RECURSIVE {items_sql(f'seq <= {UP_TO}')} SELECT store_id, item_id FROM held)
        SELECT *, 'added' AS change FROM (SELECT * FROM ends EXCEPT SELECT * FROM thens)
        UNION ALL SELECT *, 'gone' FROM (SELECT * FROM thens EXCEPT SELECT * FROM ends)""",
    "store_items": f"WITH RECURSIVE {items_sql(detailed=True)} SELECT * FROM held",
    "store_working": f"""
        WITH RECURSIVE {_accepted()}, given AS (SELECT store_id, seq, unnest(map_entries(patch.working)) AS e FROM accepted WHERE patch.working IS NOT NULL)
        SELECT store_id, e.key AS name, arg_max({{'v': e.value}}, seq).v AS value, max(seq) AS seq FROM given GROUP BY store_id, e.key""",
    "store_versions": f"""
        WITH RECURSIVE {_accepted()}
        SELECT store_id, count(*) AS accepted, arg_max({{'v': new}}, seq).v AS version FROM accepted GROUP BY store_id""",
}
