"""The life of memory items: liveness, protection, supersession, evidence, and checks of patches against a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.session import cut

# Categories whose items can be closed, and those that are always shown, in their order.
CLOSABLE = ("goals", "requirements", "open_questions", "known_issues")


def _seconds(at: Column) -> Column:
    return F.unix_seconds(at.cast("timestamp"))


def live(as_of: str) -> Column:
    """Active, and not older than its time to live counted from the last validation, change or creation."""
    since = F.coalesce("last_validated_at", "updated_at", "created_at")
    age = _seconds(F.lit(as_of)) - _seconds(since)
    return (F.col("status") == "active") & (F.col("ttl_seconds").isNull() | F.coalesce(age <= F.col("ttl_seconds"), F.lit(True)))


def protected() -> Column:
    return F.coalesce((F.col("source") == "user") & T.at_least(F.col("importance"), "critical"), F.lit(False))


def closed() -> Column:
    return F.col("fields").getItem("closed_at").isNotNull()


def always_shown(least_confidence: float) -> Column:
    sure = (F.col("source") == "user") | (F.col("importance") == "critical") | (F.col("confidence") >= least_confidence)
    return ~F.coalesce(closed(), F.lit(False)) & F.coalesce(sure, F.lit(False))


def final_successors(items: DataFrame) -> DataFrame:
    """The last item that each superseded item leads to: ``(id, final_id, hops)``, by doubling the steps each round.

    There are as many rounds as the number of steps has bits, so a chain of any length comes to its end; what then still
    moves runs into a circle, which has no end, and gives no row. Unknown successors end a chain as well.
    """
    steps = cut(items.where("superseded_by IS NOT NULL AND id IS NOT NULL AND superseded_by <> id").select("id", F.col("superseded_by").alias("to"), F.lit(1).cast("bigint").alias("hops")))
    for _ in range(steps.count().bit_length()):
        ahead, seen = steps.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more")), Observation()
        far = steps.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved"))
        steps = cut(far.observe(seen, F.count_if("moved").alias("moved"))).drop("moved")
        if not seen.get["moved"]:
            break
    circles = steps.join(steps.select(F.col("id").alias("to")), "to", "left_semi").select("id")
    return steps.join(circles, "id", "left_anti").select("id", F.col("to").alias("final_id"), "hops")


def evidence_found(items: DataFrame, events: DataFrame) -> DataFrame:
    """Of each item with evidence, how many of its different event ids are known."""
    named = items.where(F.col("id").isNotNull()).select("id", F.explode(F.array_distinct("evidence")).alias("event"))
    known = events.select(F.col("id").alias("event"), F.lit(1).alias("known")).distinct()
    return named.join(known, "event", "left").groupBy("id").agg(F.count("*").alias("named"), F.count("known").alias("found"))


def patch_operations(patches: DataFrame) -> DataFrame:
    """The operations of each different patch in their order: ``store_id, seq, rank, place, op, item_id, category, text``."""
    kind = "array<struct<rank:int,op:string,item_id:string,category:string,text:string>>"
    one = lambda rank, op, item, category=F.lit(None), text=F.lit(None): F.struct(
        F.lit(rank).alias("rank"), F.lit(op).alias("op"), item.alias("item_id"), category.cast("string").alias("category"), text.cast("string").alias("text")
    )
    empty = F.array().cast(kind)
    lists = [
        F.transform("patch.add_items", lambda x: one(0, "add", x["id"], x["category"], x["text"])),
        F.transform("patch.update_items", lambda x: one(1, "update", x["id"])),
        F.transform("patch.remove_ids", lambda x: one(2, "remove", x)),
        F.transform("patch.supersede_items", lambda x: one(3, "supersede", x["id"])),
        F.transform("patch.touch_ids", lambda x: one(4, "touch", x)),
    ]
    every = F.concat(*[F.coalesce(x.cast(kind), empty) for x in lists])
    first = patches.where("store_id IS NOT NULL AND seq IS NOT NULL").groupBy("store_id", "seq").agg(F.min_by("patch", F.struct("received_at", "id")).alias("patch"))
    return first.select("store_id", "seq", F.posexplode(every).alias("place", "o")).select("store_id", "seq", "o.rank", "place", "o.op", "o.item_id", "o.category", "o.text")


def unknown_targets(patches: DataFrame) -> DataFrame:
    """Operations on an item that no patch up to theirs in the log adds: ``store_id, seq, op, item_id``."""
    ops = patch_operations(patches).where("item_id IS NOT NULL")
    added = ops.where("op = 'add'").groupBy("store_id", "item_id").agg(F.min("seq").alias("added"))
    late = ops.where("op <> 'add'").join(added, ["store_id", "item_id"], "left").where("added IS NULL OR added > seq")
    return late.select("store_id", "seq", "op", "item_id")


def repeated_additions(patches: DataFrame) -> DataFrame:
    """Additions whose category and plain text an earlier addition in the store had: ``store_id, seq, place, item_id``."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.lower("text")), r"\s+", " "), r"[.;:!]+$", "")
    adds = patch_operations(patches).where("op = 'add' AND text IS NOT NULL").withColumn("plain", plain)
    same = ["store_id", F.coalesce("category", F.lit("")).alias("kind"), "plain"]
    adds = adds.select(*same, "seq", "place", "item_id", F.col("category").isNull().alias("bare"))
    keys = ["store_id", "kind", "bare", "plain"]
    firsts = adds.groupBy(*keys).agg(F.min(F.struct("seq", "place")).alias("f"), F.count("*").alias("n")).where("n > 1")
    return adds.join(firsts, keys).where(F.struct("seq", "place") != F.col("f")).select("store_id", "seq", "place", "item_id")


def violations(patches: DataFrame) -> DataFrame:
    """What is wrong with patches in their log: ``store_id, seq, code, item_id``.

    ``unknown_item`` changes what was never added, ``duplicate_id`` adds an id again, ``self_supersede`` names an item as
    its own successor, ``empty_patch`` does nothing (its item is null). A place of a log counts once.
    """
    ops = patch_operations(patches)
    unknown = unknown_targets(patches).select("store_id", "seq", F.lit("unknown_item").alias("code"), "item_id").distinct()
    adds = ops.where("op = 'add' AND item_id IS NOT NULL").select("store_id", "seq", "place", "item_id")
    first = adds.groupBy("store_id", "item_id").agg(F.min(F.struct("seq", "place")).alias("f"), F.count("*").alias("n")).where("n > 1")
    again = adds.join(first, ["store_id", "item_id"]).where(F.struct("seq", "place") != F.col("f")).select("store_id", "seq", F.lit("duplicate_id").alias("code"), "item_id").distinct()
    rows = patches.where("store_id IS NOT NULL AND seq IS NOT NULL").groupBy("store_id", "seq").agg(F.min_by(F.struct("patch"), F.struct("received_at", "id")).alias("p"))
    own = F.filter(F.coalesce("p.patch.supersede_items", F.expr("filter(p.patch.supersede_items, x -> false)")), lambda x: x["id"] == x["by_id"])
    selves = rows.select("store_id", "seq", F.lit("self_supersede").alias("code"), F.explode(own).alias("x")).select("store_id", "seq", "code", F.col("x.id").alias("item_id")).distinct()
    named = ("add_items", "update_items", "remove_ids", "supersede_items", "touch_ids")
    size = sum((F.coalesce(F.size(f"p.patch.{x}"), F.lit(0)) for x in named), F.lit(0))
    nothing = (size + F.coalesce(F.size("p.patch.working"), F.lit(0))) <= 0
    empty = rows.where(F.col("p.patch").isNull() | nothing).select("store_id", "seq", F.lit("empty_patch").alias("code"), F.lit(None).cast("string").alias("item_id"))
    return unknown.unionByName(again).unionByName(selves).unionByName(empty)
