"""Items that repeat another one with small changes: circulant MinHash, banding, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.words import lower_words, mixed, word_hashes
from eventloom.operators.components import connected_components
from eventloom.session import cut, written

SIMILARITY = 0.6
LEAST_WORDS = 8
#: A pair of similarity s is missed with probability (1 - s ** ROWS) ** BANDS: 7 % at 0.6, 0.5 % at 0.67, 0.003 % at 0.75.
ROWS = 6
BANDS = 56
#: Signatures of one band that one task compares; there are as many parts of a band as that takes.
PART_ITEMS = 200_000
#: Items of one block of signatures, so that a place in it takes two bytes.
BLOCK = 1 << 16
#: Bytes up to which a counted list of numbers (16 bytes each) may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 8 << 20

#: Pairs that a task gives out at once.
PAIRS_AT_ONCE = 500_000
#: Items of a bucket from which its pairs are spread over tasks, by pairs of blocks of half as many items.
HOT = 1024

_ENTRIES = "band int, part int, block bigint, buckets array<int>, places array<smallint>, groups array<bigint>"
#: Pairs of items, or pairs of blocks of items with their groups, packed as 8 bytes each.
_PAIRS = "a bigint, b bigint, left binary, right binary, left_groups binary, right_groups binary"


def _permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the numbers below 2 ** 32."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(hashes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash signatures ``(size, texts)``: the first permutation places a word on a circle of 2 ** 32, and
    the k-th coordinate is the least value of the second permutation after a turn by k. No text may be empty."""
    placed = mixed(hashes).astype(np.uint32)
    out = np.empty((size, len(offsets) - 1), np.uint32)
    step = 2048
    for low in range(0, len(offsets) - 1, step):
        at = offsets[low : low + step + 1]
        part, starts = placed[at[0] : at[-1]], at[:-1] - at[0]
        for k in range(size):
            out[k, low : low + step] = np.minimum.reduceat(_permuted(part + np.uint32(k)), starts)
    return out


def band_buckets(signature: np.ndarray, seeds: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """The 64-bit bucket of every text in each band of ``rows`` coordinates; texts of different seeds never share one
    but by chance."""
    for low in range(0, len(signature), rows):
        bucket = seeds + np.uint64(low)
        for coordinate in signature[low : low + rows]:
            bucket = mixed(bucket * np.uint64(0x9E3779B97F4A7C15) + coordinate)
        yield bucket


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give every item a block and a place in it."""
    block, used = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        if used + len(batch) > BLOCK:
            block, used = block + 1, 0
        for low in range(0, len(batch), BLOCK):
            part = batch.slice(low, BLOCK)
            if low:
                block, used = block + 1, 0
            node = (np.int64(block) << 16) + used + np.arange(len(part))
            used += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(node), *part.columns], ["node", *part.schema.names])


def _plain(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none, none], ["a", "b", "left", "right", "left_groups", "right_groups"])


def _pairs_in(batches: Iterator[pa.RecordBatch], star: bool, most: int) -> Iterator[pa.RecordBatch]:
    """The pairs of items in one bucket and of different groups, over a part of a band, some at a time.

    Of a hot bucket come pairs of blocks instead, to be spread over tasks; with ``star`` only its links to its least item,
    and each of its items with itself as a sign that it has more pairs.
    """
    part = pa.Table.from_batches(list(batches))
    block = np.repeat(part.column("block").to_numpy(), [len(x) for x in part.column("buckets")])
    places = part.column("places").combine_chunks().flatten().to_numpy().view(np.uint16)
    bucket = part.column("buckets").combine_chunks().flatten().to_numpy()
    node = (block << 16) + places
    group = part.column("groups").combine_chunks().flatten().to_numpy() if not part.column("groups").null_count else node
    order = np.lexsort((node, group, bucket))
    bucket, node, group = bucket[order], node[order], group[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(bucket)))
    hot = sizes > most
    left = np.repeat(np.where(hot, 0, starts + sizes), sizes) - np.where(np.repeat(hot, sizes), 0, np.arange(len(bucket)) + 1)
    done = np.concatenate([[0], np.cumsum(left)])
    low = 0
    while low < len(node):
        high = max(low + 1, int(np.searchsorted(done, done[low] + PAIRS_AT_ONCE, "right")) - 1)
        some = left[low:high]
        first = np.repeat(np.arange(low, high), some)
        second = first + 1 + np.arange(len(first)) - np.repeat(done[low:high] - done[low], some)
        apart = group[first] != group[second]
        if apart.any():
            yield _plain(np.minimum(node[first], node[second])[apart], np.maximum(node[first], node[second])[apart])
        low = high
    for at, n in zip(starts[hot].tolist(), sizes[hot].tolist(), strict=True):
        nodes, groups = node[at : at + n], group[at : at + n]
        if star:
            yield _plain(np.full(n - 1, nodes[0]), nodes[1:])
            yield _plain(nodes, nodes)
            continue
        ranges = [(k, min(n, k + most // 2)) for k in range(0, n, most // 2)]
        for i, (a, b) in enumerate(ranges):
            # Groups are in order, so two blocks of one group have nothing to compare.
            others = [(c, d) for c, d in ranges[i:] if groups[a] != groups[d - 1]]
            if others:
                of = lambda values, spans: pa.array([values[c:d].tobytes() for c, d in spans], pa.binary())
                same, none = [(a, b)] * len(others), pa.nulls(len(others), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, of(nodes, same), of(nodes, others), of(groups, same), of(groups, others)], ["a", "b", "left", "right", "left_groups", "right_groups"]
                )


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of pairs of blocks, and the other pairs as they are."""
    for batch in batches:
        plain = batch.filter(batch.column("a").is_valid())
        if len(plain):
            yield plain.select(["a", "b"])
        blocks = batch.filter(batch.column("left").is_valid())
        for k in range(len(blocks)):
            left, right, of_left, of_right = (np.frombuffer(blocks.column(c)[k].as_py(), np.int64) for c in ("left", "right", "left_groups", "right_groups"))
            apart = of_left[:, None] != of_right[None, :]
            if left[0] == right[0]:
                apart &= np.arange(len(left))[:, None] < np.arange(len(right))
            i, j = np.nonzero(apart)
            if len(i):
                a, b = left[i], right[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _sets(items: DataFrame) -> DataFrame:
    """A written table of the items that can have a match: ``node, id, category, words, marks, key``.

    ``words`` are the different words in order, joined by blanks, which no word has; ``marks`` are their hashes in two
    bytes each.
    """
    words = items.where(F.col("id").isNotNull() & F.col("category").isNotNull() & F.col("text").isNotNull()).select(
        "id", "category", F.array_sort(F.array_distinct(lower_words(F.col("text")))).alias("words")
    )
    marks = F.array_distinct(F.transform("words", lambda w: F.shiftright(F.xxhash64(w), 48).cast("smallint")))
    packed = words.where(F.size("words") >= LEAST_WORDS).select(
        "id", "category", F.array_join("words", " ").alias("words"), F.size("words").alias("n"), marks.alias("marks")
    )
    keyed = packed.select("*", F.xxhash64("category", "words").alias("key"))
    kind = "node bigint, id string, category string, words string, n int, marks array<smallint>, key bigint"
    return written(keyed.mapInArrow(_numbered, kind), "item-sets")


def _candidates(sets: DataFrame, rows: int, bands: int, hot: int, star: bool = False) -> DataFrame:
    """Pairs of nodes ``(a, b)`` that share a bucket; ``sets`` may have a ``group``, in which nodes are not compared."""
    grouped, parts = "group" in sets.columns, -(-sets.count() // PART_ITEMS) or 1

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = word_hashes(pc.split_pattern(batch.column("words"), " "))
            seeds = pd.util.hash_array(batch.column("category").to_numpy(zero_copy_only=False).astype(object))
            signature = signatures(hashes, offsets, rows * bands)
            nodes = batch.column("node").to_numpy()
            groups = batch.column("group").to_numpy() if grouped else None
            out = {name: [] for name in ("band", "part", "block", "buckets", "places", "groups")}
            for band, bucket in enumerate(band_buckets(signature, seeds, rows)):
                of = (bucket >> np.uint64(32)) % np.uint64(parts)
                for part in np.unique(of):
                    for block in np.unique(nodes >> 16):
                        mine = (of == part) & (nodes >> 16 == block)
                        out["band"].append(band)
                        out["part"].append(int(part))
                        out["block"].append(int(block))
                        out["buckets"].append(bucket[mine].astype(np.uint32).view(np.int32))
                        out["places"].append((nodes[mine] & 0xFFFF).astype(np.uint16).view(np.int16))
                        out["groups"].append(groups[mine] if grouped else None)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], list(out))

    def pairs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs_in(batches, star, hot)

    found = sets.select("node", "category", "words", *["group"] * grouped).mapInArrow(entries, _ENTRIES)
    pairs = found.groupBy("band", "part").applyInArrow(pairs_in, _PAIRS)
    spread = F.xxhash64("a", "b", "left", "right")
    return pairs.repartition(spread).mapInArrow(_expanded, "a bigint, b bigint").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A list of numbers, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows * 16 <= BROADCAST_BYTES else df


def _classes(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The word sets of items, those of them that stand for all equal ones, and the copies ``(rep, rep_id, node, id)``."""
    sets = _sets(items)
    shared = cut(sets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    alike = sets.join(_small(shared, shared.count()), "key").select("key", "category", "words", "node", "id")
    # A key may be shared by chance; equal classes have the same category and words.
    alike = written(alike, "item-copies")
    first = alike.groupBy("key", "category", "words").agg(F.min(F.struct("node", "id")).alias("r"))
    copies = cut(
        alike.join(first, ["key", "category", "words"]).where("node <> r.node").select(F.col("r.node").alias("rep"), F.col("r.id").alias("rep_id"), "node", "id")
    )
    return sets, sets.join(_small(copies.select("node"), copies.count()), "node", "left_anti"), copies


def _alike(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidate pairs that are similar: ``a, b, id_a, id_b``.

    The same columns are joined on the same key twice, so that one exchange serves both. The short marks go first. Every
    shared word gives a shared mark, and of the shared words at most as many fall on one mark as an item has words more
    than marks. So two items share at most that many words more than marks, and a pair that is not similar even then is
    left out; no similar one is.
    """
    likely = lambda both, n: both >= F.lit(similarity) * (n - both) - 1e-9
    marks = sets.select("node", "n", "marks")
    rough = candidates.withColumnRenamed("a", "node").join(marks, "node")
    rough = rough.select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("n").alias("n_a"), F.col("marks").alias("m")).join(marks, "node")
    most = F.size(F.array_intersect("m", "marks")) + F.least(F.col("n_a") - F.size("m"), F.col("n") - F.size("marks"))
    close = cut(rough.where(likely(most, F.col("n_a") + F.col("n"))).select("a", F.col("node").alias("b")))
    ends = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    known = sets.select("node", "id", "category", "words").join(_small(ends, 2 * close.count()), "node", "left_semi")
    pairs = close.withColumnRenamed("a", "node").join(known, "node")
    pairs = pairs.select(F.col("node").alias("a"), F.col("b").alias("node"), F.struct("id", "category", "words").alias("x")).join(known, "node")
    pairs = pairs.select("a", F.col("node").alias("b"), F.col("x.id").alias("id_a"), F.col("id").alias("id_b"), "x", "category", F.split("x.words", " ").alias("v"), F.split("words", " ").alias("w"))
    both = F.size(F.array_intersect("v", "w"))
    exact = (F.col("x.category") == F.col("category")) & likely(both, F.size("v") + F.size("w"))
    return pairs.where(exact).select("a", "b", "id_a", "id_b")


def similar_pairs(items: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """The pairs of items of one category that share enough of their different words: ``(id_a, id_b)``, smaller first.

    Equal word sets are one class before the comparison and are expanded to pairs at the end. Signatures are cut into
    bands; buckets of a band are spread over as many tasks as its size takes, with 6 bytes for each signature and band,
    and a hot bucket over as many tasks as it has pairs of blocks. Candidates are few, since background similarity is low
    to the sixth power; each is compared exactly.

    Nulls: an item with a null id, category or text matches nothing, nor does one with fewer than 8 different words.
    Repeated rows of one id do not match themselves. Extra columns are ignored. An empty table gives no rows.
    """
    sets, single, copies = _classes(items)
    pairs = written(_alike(_candidates(single, rows, bands, hot), sets, similarity), "similar-pairs")
    of = lambda end: copies.select(F.col("rep").alias(end), F.col("id").alias("copy"))
    left = pairs.unionByName(pairs.join(of("a"), "a").select("a", "b", F.col("copy").alias("id_a"), "id_b"))
    full = left.unionByName(left.join(of("b"), "b").select("a", "b", "id_a", F.col("copy").alias("id_b")))
    to_first = copies.select(F.col("rep_id").alias("id_a"), F.col("id").alias("id_b"))
    among = copies.select("rep", F.col("id").alias("id_a")).join(copies.select("rep", F.col("id").alias("id_b")), "rep").where("id_a < id_b")
    every = full.select("id_a", "id_b").unionByName(to_first).unionByName(among.select("id_a", "id_b"))
    return every.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def similar_groups(items: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """Each item that has a similar one, with its group: ``(id, group_id)``, the group being named by its least id.

    Copies link only to their representative, so a group of n copies has n - 1 links. The items of a hot bucket are first
    compared with its least one; only those that this leaves in different groups are then compared with each other.
    """
    sets, single, copies = _classes(items)
    found = written(_candidates(single, rows, bands, hot, star=True), "item-links")
    pairs = written(_alike(found.where("a <> b"), sets, similarity), "similar-pairs")
    parts = connected_components(pairs, "a", "b")
    more = found.where("a = b").select(F.col("a").alias("node"))
    if not more.isEmpty():
        grouped = single.join(more, "node", "left_semi").join(parts, "node", "left").withColumn("group", F.coalesce("component", "node"))
        rest = _alike(_candidates(grouped, rows, bands, hot), sets, similarity)
        pairs = written(pairs.unionByName(rest), "similar-pairs")
        parts = connected_components(pairs, "a", "b")
    members = pairs.select(F.col("a").alias("node"), F.col("id_a").alias("id")).unionByName(pairs.select(F.col("b").alias("node"), F.col("id_b").alias("id")))
    members = members.unionByName(copies.select(F.col("rep").alias("node"), "id")).unionByName(copies.select(F.col("rep").alias("node"), F.col("rep_id").alias("id")))
    placed = members.distinct().join(parts, "node", "left").select("id", F.coalesce("component", "node").alias("part"))
    names = placed.groupBy("part").agg(F.min("id").alias("group_id"))
    return placed.join(names, "part").select("id", "group_id").distinct()
