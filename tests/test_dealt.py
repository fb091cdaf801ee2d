"""Deduplication, components and patch composition: brute force and edge cases."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from eventloom.operators.components import connected_components
from eventloom.operators.dedupe import QuotientTable, kept_events, quotient_key, repeated_deliveries
from eventloom.operators.patches import current_items, numbered_ranges, ordered_log

EVENTS = "delivery_seq bigint, id string, session_id string, dedupe_hash string, component string"


def _find(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "x bigint, y bigint"), "x", "y").collect()}
    want = _find([p for p in links if p[0] != p[1]])
    assert got == want


def test_components_of_nothing_and_nulls(spark):
    rows = spark.createDataFrame([(1, None), (None, 2), (5, 5)], "u bigint, v bigint")
    assert connected_components(rows, "u", "v").count() == 0
    assert connected_components(rows.limit(0), "u", "v").count() == 0


def _wanted(rows):
    ids, hashes, links = {}, {}, []
    for seq, i, s, h, _ in rows:
        if seq is None:
            continue
        links.append((seq, seq))
        if i is not None:
            links.append((ids.setdefault(i.strip(" \t\r\n").lower(), seq), seq))
        if s is not None and h:
            links.append((hashes.setdefault((s, h), seq), seq))
    return {k: v for k, v in _find(links).items() if k != v}


def test_repeated_deliveries_of_random_rows(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice([None, f"e{rng.randrange(90)}", f" E{rng.randrange(90)}\t"]), rng.choice([None, "s", "t"]), rng.choice([None, "", f"h{rng.randrange(80)}"]), "x")
        for i in range(200)
    ]
    rows += [(None, "e1", "s", "h1", "x"), (300, "", "s", None, "x"), (301, " ", "t", None, "x")]
    got = {r.delivery_seq: r.event_seq for r in repeated_deliveries(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == _wanted(rows)


def test_shards_are_filled_one_after_the_other():
    """Few rows at once, many or all give the same links, also with shards longer than that."""
    import numpy as np
    import pyarrow as pa

    from eventloom.operators import dedupe

    rng = np.random.default_rng(2)
    quotient = np.sort(rng.integers(0, 9, 400)).astype(np.int32)
    table = pa.table({
        "delivery_seq": pa.array(rng.permutation(400)), "quotient": quotient, "rest": pa.array(rng.integers(0, 12, 400)), "tail": ["3:"] * 400,
        "first_seq": pa.nulls(400, pa.int64()),
    })
    before, found = dedupe.ROWS_AT_ONCE, []
    try:
        for dedupe.ROWS_AT_ONCE in (1, 30, 90, 1000):
            links = pa.Table.from_batches(list(dedupe._shards(iter(table.to_batches(max_chunksize=17)))))
            found.append(sorted(zip(*[c.to_pylist() for c in links.columns], strict=True)))
    finally:
        dedupe.ROWS_AT_ONCE = before
    assert found[0] == found[1] == found[2] == found[3]
    firsts = {}
    for seq, q, r in sorted(zip(table["delivery_seq"].to_pylist(), quotient.tolist(), table["rest"].to_pylist(), strict=True)):
        firsts.setdefault((q, r), []).append(seq)
    assert found[0] == sorted((s, v[0]) for v in firsts.values() for s in v[1:])


def test_one_hot_event(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("delivery_seq"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("e"), "id")).alias("id"),
        F.lit("s").alias("session_id"), F.lit(None).cast("string").alias("dedupe_hash"),
    )
    assert repeated_deliveries(rows).count() == len(range(0, 20_000, 3)) - 1
    assert kept_events(rows).count() == 20_000 - len(range(0, 20_000, 3)) + 1


def test_no_events(spark):
    assert repeated_deliveries(spark.createDataFrame([], EVENTS)).count() == 0


def test_quotient_keys_are_exact(spark):
    texts = ["", "a", "a\0", "\0", "abcdefg", "abcdefgh", "abcdefgh\0", "A" * 5000, "A" * 5001, "é", "é", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(quotient_key(F.col("t")).alias("k"))
    assert rows.where("k IS NOT NULL").distinct().count() == len(texts) - 1
    assert rows.where("k IS NULL").count() == 1


def test_quotient_table_over_batches(spark, tmp_path):
    table = QuotientTable(spark, f"file://{tmp_path}/ids", groups=4)
    batch = lambda *x: spark.createDataFrame([(v,) for v in x], "k string")
    new = lambda df: sorted(r.k for r in df.collect())
    assert new(table.insert(batch("a", "b", "a", None), "k", "0")) == ["a", "b"]
    assert new(table.insert(batch("b", "c"), "k", "1")) == ["c"]
    assert new(table.insert(batch("b", "c"), "k", "1")) == ["c"]  # the same batch again
    assert new(table.insert(batch("a", "c"), "k", "2")) == []


PATCHES = (
    "id string, store_id string, seq bigint, base_version bigint, new_version bigint, received_at timestamp, status string, patch struct<working:map<string,string>,"
    "add_items:array<struct<id:string,category:string,text:string,importance:string>>,update_items:array<struct<id:string,status:string,importance:string>>,"
    "remove_ids:array<string>,supersede_items:array<struct<id:string,by_id:string>>,touch_ids:array<string>>"
)


def _patch(add=None, update=None, remove=None, supersede=None):
    return (None, add, update, remove, supersede, None)


def _applied(rows):
    logs = {}
    for _, store, seq, base, new, _, _, patch in rows:
        if store is not None and seq is not None:
            logs.setdefault(store, {}).setdefault(seq, (base, new, patch or (None,) * 6))
    out = {}
    for store, log in logs.items():
        version, items = 0, {}
        for seq in sorted(log):
            base, new, (_, add, update, remove, supersede, _) = log[seq]
            if version is None or base is None or base != version:
                continue
            version = new
            for x in add or []:
                if x and x[0] is not None and x[0] not in items:
                    items[x[0]] = ["active", x[3] or "medium", new]
            for x in update or []:
                if x and x[0] in items:
                    items[x[0]] = [x[1] or items[x[0]][0], x[2] or items[x[0]][1], new]
            for x in remove or []:
                items.pop(x, None)
            for x in supersede or []:
                if x and x[0] in items:
                    items[x[0]] = ["superseded", items[x[0]][1], new]
        out.update({(store, i): tuple(v) for i, v in items.items()})
    return out


@pytest.mark.parametrize("size,fan", [(1, 2), (4, 2), (256, 64)])
def test_patches_of_random_logs(spark, size, fan):
    rng = random.Random(size)
    rows = []
    for store in ("a", "b", "c", None):
        version = 0
        for seq in range(1, 70 if store == "a" else 9):
            if rng.random() < 0.1:
                continue
            base = version if rng.random() < 0.75 else rng.choice([None, version - 1, version + 1, rng.randrange(60)])
            new = rng.choice([None if rng.random() < 0.05 else version + rng.randrange(1, 4)])
            ids = [f"i{rng.randrange(6)}" for _ in range(4)]
            patch = rng.choice([
                None, _patch(), _patch(add=[(ids[0], "goals", "t", rng.choice([None, "high"])), None, (None, None, None, None)]),
                _patch(update=[(ids[1], rng.choice([None, "stale"]), rng.choice([None, "low"]))], remove=[ids[2], None]),
                _patch(add=[(ids[0], None, None, "low"), (ids[1], None, None, None)], supersede=[(ids[3], "x"), None], remove=[ids[1]]),
            ])
            row = (f"p{seq}", store, seq, base, new, None, "x", patch)
            rows += [row] * rng.choice([1, 1, 2])
            if base == version and base is not None and new is not None:
                version = new
    rows.append(("p", "d", None, 0, 1, None, "x", _patch(add=[("i", None, None, None)])))
    want = _applied(rows)
    rng.shuffle(rows)
    got = current_items(spark.createDataFrame(rows, PATCHES), size, fan).collect()
    assert {(r.store_id, r.item_id): (r.status, r.importance, r.version) for r in got} == want and len(got) == len(want)


def test_no_patches(spark):
    assert current_items(spark.createDataFrame([], PATCHES)).count() == 0


def test_hot_item(spark):
    rows = [("p", "s", i + 1, i, i + 1, None, "x", _patch(add=[("hot", None, None, None)] if i == 0 else None, update=[("hot", None, "low")])) for i in range(600)]
    got = current_items(spark.createDataFrame(rows, PATCHES), 16, 4).collect()
    assert got == [Row(store_id="s", item_id="hot", status="active", importance="low", version=600)]


def test_gaps_and_small_stores_add_no_ranges(spark):
    """A log with a gap of a billion places beside a thousand short ones: as many ranges as there are."""
    rows = [("p", "wide", 1, 0, 1, None, "x", _patch(add=[("i", None, None, None)])), ("p", "wide", 10**9, 1, 2, None, "x", _patch(update=[("i", None, "low")]))]
    for k in range(1000):
        rows += [("p", f"s{k}", seq, seq // 300, seq // 300 + 1, None, "x", _patch(add=[(f"i{seq}", None, None, None)])) for seq in (1, 300, 600)[: 1 + k % 3]]
    patches = spark.createDataFrame(rows, PATCHES)
    ranges = numbered_ranges(ordered_log(patches).withColumn("part", F.floor(F.col("seq") / 256)))
    assert ranges.count() == len({(r[1], r[2] // 256) for r in rows})
    got = current_items(patches).collect()
    assert {(r.store_id, r.item_id): (r.status, r.importance, r.version) for r in got} == _applied(rows)
