"""Rebuilding the state of many stores from their patch logs by composing functions.

A patch is a function on the version of its store and, through its operations, on each of its items. Both kinds of
function compose associatively, so a log is cut into ranges of ``seq`` and reduced as a tree; a hot store or a hot
item is spread over as many tasks as it has ranges, and no task ever holds a whole log.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.metrics import running_sum
from eventloom.session import cut, written

#: Places of a log in one range, and functions composed at once in the reduction of items.
RANGE = 256
FAN = 64

#: The parts of an item that its state keeps, and those that a detailed one keeps as well. An operation sets those that it
#: gives and leaves the others.
PARTS = {"status": "string", "importance": "string"}
DETAILS = {**PARTS, "category": "string", "text": "string", "confidence": "double", "source": "string", "reason": "string", "superseded_by": "string"}
#: The confidence of an item that names none, and the most that one may have that is not the user's.
CONFIDENCE, MOST_INFERRED = 0.8, 0.9


def ordered_log(patches: DataFrame, parts: dict[str, str] = PARTS) -> DataFrame:
    """One row for each ``(store_id, seq)``: ``store_id, seq, base, new, body``; repeats go, the earliest arrival stays.

    The body has the lists of operations with the fields that ``parts`` take. Rows with a null store or seq have no place
    in any log and are ignored.
    """
    pick = lambda names: lambda x: F.struct(*[x[n].alias(n) for n in names])
    detailed = set(parts) - set(PARTS)
    body = F.struct(
        F.transform("patch.add_items", pick(["id", "importance", *(["category", "text", "confidence", "source", "reason"] if detailed else [])])).alias("add"),
        F.transform("patch.update_items", pick(["id", "status", "importance", *(["text", "confidence", "reason"] if detailed else [])])).alias("update"),
        F.col("patch.remove_ids").alias("remove"),
        F.transform("patch.supersede_items", pick(["id", "by_id", "reason"]) if detailed else pick(["id"])).alias("supersede"),
    )
    row = F.struct(F.col("base_version").alias("base"), F.col("new_version").alias("new"), body.alias("body"))
    return (
        patches.where("store_id IS NOT NULL AND seq IS NOT NULL")
        .groupBy("store_id", "seq")
        .agg(F.min_by(row, F.struct("received_at", "id")).alias("p"))
        .select("store_id", "seq", "p.base", "p.new", "p.body")
    )


def _range_functions(part: DataFrame) -> DataFrame:
    """The version function of each range: rows ``(store_id, node, v_in, v_out)``; other versions pass unchanged.

    Read from the right: entering a patch at its base gives what the rest of the range makes of its new version.
    """

    def compose(run):
        out = {}
        run = run.sort_by("seq").select(["base", "new"]).to_pydict()
        for base, new in zip(reversed(run["base"]), reversed(run["new"]), strict=True):
            if base is not None:  # a null base fits no version that a number can reach
                out[base] = out.get(new, new)
        return pa.table({"v_in": pa.array(out.keys(), pa.int64()), "v_out": pa.array(out.values(), pa.int64())})

    def keyed(key, run):
        out = compose(run)
        names = pa.array([key[0].as_py()] * len(out), pa.string()), pa.array([key[1].as_py()] * len(out), pa.int64())
        return out.add_column(0, "node", names[1]).add_column(0, "store_id", names[0])

    return part.groupBy("store_id", "node").applyInArrow(keyed, "store_id string, node bigint, v_in bigint, v_out bigint")


def _compose_pairs(level: DataFrame) -> DataFrame:
    """Compose neighbouring nodes; a join on store, parent and version spreads even a hot store."""
    parent = F.shiftright("node", 1).alias("node")
    left = level.where("node % 2 = 0").select("store_id", parent, "v_in", F.col("v_out").alias("mid"), "last")
    right = level.where("node % 2 = 1").select("store_id", parent, F.col("v_in").alias("mid"), F.col("v_out").alias("v_end"), "last", F.lit(True).alias("hit"))
    through = left.join(right.drop("last"), ["store_id", "node", "mid"], "left").select(
        "store_id", "node", "v_in", F.when(F.col("hit"), F.col("v_end")).otherwise(F.col("mid")).alias("v_out"), "last"
    )
    passed = right.join(left.select("store_id", "node", F.col("v_in").alias("mid")), ["store_id", "node", "mid"], "left_anti")
    return through.unionByName(passed.select("store_id", "node", F.col("mid").alias("v_in"), F.col("v_end").alias("v_out"), "last"))


def numbered_ranges(log: DataFrame) -> DataFrame:
    """The ranges that the logs have, numbered without gaps in each store: ``store_id, part, node, last``.

    ``part`` is the place of the range among all that ``seq`` could have, ``node`` counts those that exist from 0, and
    ``last`` is the highest node of the store. Gaps in ``seq`` and longer logs of other stores add no rows.
    """
    parts = log.select("store_id", "part").distinct().withColumn("one", F.lit(1).cast("bigint"))
    numbered = cut(running_sum(parts, "store_id", "part", "one", "node", RANGE).select("store_id", "part", (F.col("node") - 1).alias("node")))
    return cut(numbered.join(numbered.groupBy("store_id").agg(F.max("node").alias("last")), "store_id"))


def _entry_versions(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """The version reached before each range of the stores with several ranges: ``(store_id, part, entry)``.

    Functions are composed up the tree of each store, up to its own height and no further, and entry versions are handed
    down from its root to the ranges that exist, so every level has at most a row for each range.
    """
    several = ranges.where("last > 0")
    depth = int(several.agg(F.max("last")).first()[0] or 0).bit_length()
    if not depth:
        return several.select("store_id", "part", F.lit(0).cast("bigint").alias("entry"))
    many = log.select("store_id", "part", "seq", "base", "new").join(several, ["store_id", "part"])
    tops = several.select("store_id", "last").distinct()
    levels = [cut(_range_functions(many).join(tops, "store_id"))]
    for k in range(1, depth):
        levels.append(cut(_compose_pairs(levels[-1]).where(F.shiftright("last", k) > 0)))
    entry = None
    for k in reversed(range(depth)):
        # A store's root is one level above its highest node; its version before all is 0.
        root = tops.where((F.shiftright("last", k) == 1)).select("store_id", F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("entry"), "last")
        entry = root if entry is None else entry.unionByName(root)
        # The left child starts where its parent does, the right one where the left one ends.
        step = levels[k].where("node % 2 = 0").select("store_id", "node", F.col("v_in").alias("entry"), "v_out", F.lit(True).alias("hit"))
        left = entry.select("store_id", (F.col("node") * 2).alias("node"), "entry", "last")
        right = left.where(F.col("node") < F.shiftright("last", k)).join(step, ["store_id", "node", "entry"], "left").select(
            "store_id", (F.col("node") + 1).alias("node"), F.when(F.col("hit"), F.col("v_out")).otherwise(F.col("entry")).alias("entry"), "last"
        )
        entry = cut(left.unionByName(right))
    return entry.join(several.select("store_id", "node", "part"), ["store_id", "node"]).select("store_id", "part", "entry")


def accepted_patches(log: DataFrame, size: int = RANGE) -> DataFrame:
    """The patches of ``log`` whose base is the version reached, as ``store_id, seq, new, body``."""
    log = log.withColumn("part", F.floor(F.col("seq") / size))
    ranges = numbered_ranges(log)
    entry = _entry_versions(log, ranges)
    runs = log.groupBy("store_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "base", "new", "body"))).alias("run"))
    # A store with one range starts at version 0; a null entry of any other fits no base.
    starts = entry.select("store_id", "part", "entry", F.lit(True).alias("later"))
    runs = runs.join(starts, ["store_id", "part"], "left")
    start = F.when(F.col("later"), F.col("entry")).otherwise(F.lit(0).cast("bigint"))
    walked = F.aggregate(
        F.transform("run", lambda p: F.struct(p["seq"].alias("seq"), p["base"].alias("base"), p["new"].alias("new"))),
        F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("kept")),
        lambda acc, p: F.when(
            p["base"] == acc["at"],
            F.struct(p["new"].alias("at"), F.concat(acc["kept"], F.array(p["seq"])).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return (
        runs.select("store_id", "run", walked.alias("kept"))
        .select("store_id", F.explode(F.filter("run", lambda p: F.array_contains("kept", p["seq"]))).alias("p"))
        .select("store_id", "p.seq", "p.new", "p.body")
    )


def _state(kinds: dict[str, str], alive, version, stamped, **given: Column) -> Column:
    return F.struct(
        alive.alias("alive"), *[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()], version.cast("bigint").alias("version"), stamped.alias("stamped")
    )


def item_functions(accepted: DataFrame, parts: dict[str, str] = PARTS) -> DataFrame:
    """Each operation of each accepted patch as a function on its item: ``store_id, item_id, seq, at, absent, held``.

    ``absent`` is what the operation makes of an item that is not held: a state, with ``alive`` false for none.
    ``held`` is what it makes of one that is held: ``alive`` false drops it, otherwise each null part stays as it was, and
    so does the version unless ``stamped``, since a version may be null.
    """
    null, yes, no = F.lit(None), F.lit(True), F.lit(False)
    none, same = _state(parts, no, null, no), _state(parts, yes, null, no)
    detailed, new = set(parts) > set(PARTS), F.col("new")

    def made(x):
        given = {"status": F.lit("active"), "importance": F.coalesce(x["importance"], F.lit("medium"))}
        if detailed:
            sure = F.coalesce(x["source"], F.lit("worker")) == "user"
            bound = F.when(sure, x["confidence"]).otherwise(F.least(x["confidence"], F.lit(MOST_INFERRED)))
            confidence = F.coalesce(F.when(x["confidence"].isNotNull(), bound), F.lit(CONFIDENCE))
            given |= {"category": x["category"], "text": x["text"], "confidence": confidence, "source": F.coalesce(x["source"], F.lit("worker")), "reason": x["reason"]}
        return _state(parts, yes, new, yes, **given)

    def changed(x):
        names = ("status", "importance", "text", "confidence", "reason") if detailed else ("status", "importance")
        return _state(parts, yes, new, yes, **{n: x[n] for n in names})

    def retired(x):
        return _state(parts, yes, new, yes, status=F.lit("superseded"), **({"superseded_by": x["by_id"], "reason": x["reason"]} if detailed else {}))

    def ops(kind: str, rank: int, item, absent, held):
        return F.transform(
            F.coalesce(F.col(f"body.{kind}"), F.expr(f"filter(body.{kind}, x -> false)")),
            lambda x, i: F.struct(
                item(x).alias("item_id"), F.struct(F.lit(rank).alias("rank"), i.alias("place")).alias("at"),
                absent(x).alias("absent"), held(x).alias("held"),
            ),
        )

    every = [
        ops("add", 0, lambda x: x["id"], made, lambda x: same),
        ops("update", 1, lambda x: x["id"], lambda x: none, changed),
        ops("remove", 2, lambda x: x, lambda x: none, lambda x: none),
        ops("supersede", 3, lambda x: x["id"], lambda x: none, retired),
    ]
    state = f"struct<alive:boolean,{','.join(f'{n}:{k}' for n, k in parts.items())},version:bigint,stamped:boolean>"
    kind = f"array<struct<item_id:string,at:struct<rank:int,place:int>,absent:{state},held:{state}>>"
    none_yet = F.array().cast(kind)
    return (
        accepted.select("store_id", "seq", F.explode(F.concat(*[F.coalesce(x.cast(kind), none_yet) for x in every])).alias("o"))
        .where("o.item_id IS NOT NULL")
        .select("store_id", "o.item_id", "seq", "o.at", "o.absent", "o.held")
    )


def _then(parts: dict[str, str], f: Column, g_held: Column, g_absent: Column) -> Column:
    """The result state of ``f`` followed by a function with the given halves."""
    kept = _state(
        parts,
        g_held["alive"],
        F.when(g_held["stamped"], g_held["version"]).when(g_held["alive"], f["version"]),
        g_held["stamped"] | (g_held["alive"] & f["stamped"]),
        **{n: F.when(g_held["alive"], F.coalesce(g_held[n], f[n])) for n in parts},
    )
    return F.when(f["alive"], kept).otherwise(g_absent)


def _composed(parts: dict[str, str], functions: Column) -> Column:
    """The composition of an ordered array of item functions."""
    null = F.lit(None)
    unit = F.struct(_state(parts, F.lit(False), null, F.lit(False)).alias("absent"), _state(parts, F.lit(True), null, F.lit(False)).alias("held"))
    return F.aggregate(
        functions,
        unit,
        lambda f, g: F.struct(
            _then(parts, f["absent"], g["held"], g["absent"]).alias("absent"), _then(parts, f["held"], g["held"], g["absent"]).alias("held")
        ),
    )


def held_items(functions: DataFrame, size: int = RANGE, fan: int = FAN, parts: dict[str, str] = PARTS) -> DataFrame:
    """Reduce item functions to the state of each item held at the end: ``store_id, item_id``, its parts and ``version``.

    The functions of an item within one range of ``seq`` are composed first, then ``fan`` ranges at a time. A composed
    function has a fixed size, so each level is smaller than the one below.
    """
    level = functions.select("store_id", "item_id", F.floor(F.col("seq") / size).alias("node"), F.struct("seq", "at").alias("at"), "absent", "held")
    level = _reduce(level, parts)
    top = level.agg(F.min("node"), F.max("node")).first()
    low, high = (top[0] or 0, top[1] or 0)
    while high > low:
        low, high = low // fan, high // fan
        level = _reduce(
            level.select("store_id", "item_id", F.floor(F.col("node") / fan).alias("node"), F.col("node").alias("at"), "absent", "held"), parts
        )
    return level.where("absent.alive").select("store_id", "item_id", *[f"absent.{n}" for n in parts], "absent.version")


def _reduce(level: DataFrame, parts: dict[str, str]) -> DataFrame:
    grouped = level.groupBy("store_id", "item_id", "node").agg(F.array_sort(F.collect_list(F.struct("at", "absent", "held"))).alias("fs"))
    return grouped.select("store_id", "item_id", "node", _composed(parts, F.col("fs")).alias("f")).select(
        "store_id", "item_id", "node", "f.absent", "f.held"
    )


def current_items(patches: DataFrame, size: int = RANGE, fan: int = FAN, parts: dict[str, str] = PARTS) -> DataFrame:
    """The items that each store holds after its log: ``store_id, item_id, status, importance, version``, or all ``DETAILS``.

    A store starts at version 0 without items. A patch whose base is not the version reached changes nothing, any other
    sets the version, an empty or null patch too. Add, update, remove and supersede count in this order, each list in
    its own. Repeated rows of one ``seq`` count once, rows in any order give the same result, gaps in ``seq`` are no
    error. Details: an item made without confidence has ``CONFIDENCE``, one that is not the user's at most
    ``MOST_INFERRED``; an update sets what it gives; the successor and reason of a retired one are those last given.
    Nulls: rows without store or seq are ignored, so are list entries without id; a null base fits no version,
    and after a null new version nothing fits. An empty table gives no rows. Extra columns are ignored.
    """
    log = written(ordered_log(patches, parts), "patch-log")
    functions = written(item_functions(accepted_patches(log, size), parts), "item-functions")
    return held_items(functions, size, fan, parts)


def working_memory(patches: DataFrame, size: int = RANGE) -> DataFrame:
    """What the accepted patches of each store leave as its working memory: ``store_id, name, value, seq``, the value that
    the last of them gives to each name. Names that only later patches leave out stay; a null value is a value."""
    body = F.struct(F.map_entries("patch.working").alias("working"))
    row = F.struct(F.col("base_version").alias("base"), F.col("new_version").alias("new"), body.alias("body"))
    log = patches.where("store_id IS NOT NULL AND seq IS NOT NULL").groupBy("store_id", "seq").agg(F.min_by(row, F.struct("received_at", "id")).alias("p"))
    log = written(log.select("store_id", "seq", "p.base", "p.new", "p.body"), "working-log")
    given = accepted_patches(log, size).select("store_id", "seq", F.explode("body.working").alias("e")).select("store_id", "seq", F.col("e.key").alias("name"), "e.value")
    last = given.groupBy("store_id", "name").agg(F.max_by(F.struct("value"), "seq").alias("v"), F.max("seq").alias("seq"))
    return last.select("store_id", "name", "v.value", "seq")
