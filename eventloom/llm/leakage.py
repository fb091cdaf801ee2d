"""Test passages in training text, found by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.words import lower_words, mixed, word_hashes
from eventloom.session import cut

#: A shared run of so many words counts; words in one fingerprinted gram.
RUN = 12
GRAM = 8
#: Rows up to which a side may be broadcast (about 40 bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def _chosen(hashes: np.ndarray, offsets: np.ndarray, gram: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the winnowed grams and the hash of the gram at each place."""
    n = len(hashes)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - gram + 1 + j]
    grams = mixed(grams)
    window = run - gram + 1
    places = len(grams) - window + 1
    least, at = grams[:places].copy(), np.arange(places)
    for j in range(1, window):
        other = grams[j : j + places]
        less = other <= least
        np.copyto(least, other, where=less)
        np.copyto(at, np.arange(j, j + places), where=less)
    # A window counts if all of its words are of one text.
    ends = np.repeat(offsets[1:], np.diff(offsets))[:places]
    at = np.unique(at[np.arange(places) + run <= ends])
    return at, grams


def fingerprints(texts: DataFrame, key: str, text: str, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """Winnowed fingerprints: ``(key, hash, place)``, the least gram of every window of ``run`` words.

    Two texts that share ``run`` words in a row share the fingerprint that their common window chooses.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = word_hashes(batch.column("words"))
            at, grams = _chosen(hashes, offsets, gram, run)
            row = np.searchsorted(offsets, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), pa.array(grams[at].view(np.int64)), pa.array((at - offsets[row]).astype(np.int32))],
                ["key", "hash", "place"],
            )

    words = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), lower_words(F.col(text)).alias("words")
    )
    return words.where(F.size("words") >= run).mapInArrow(choose, "key bigint, hash bigint, place int")


def _equal_runs(doc: np.ndarray, item: np.ndarray, shifts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The equal runs on each of the diagonals of two word lists: their first places in ``doc`` and the places after."""
    for shift in shifts:
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        if high > low:
            same = np.concatenate([[False], item[low:high] == doc[low + shift : high + shift], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1]) + low + shift
            yield edges[::2], edges[1::2]


def _longest_runs(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The longest equal run on the diagonals of each pair of word lists."""
    for pdf in pairs:
        best = []
        for doc, item, shifts in zip(pdf["doc_words"], pdf["item_words"], pdf["shifts"], strict=True):
            runs = _equal_runs(np.asarray(doc, object), np.asarray(item, object), shifts)
            best.append(max((int((end - first).max(initial=0)) for first, end in runs), default=0))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "item_id": pdf["item_id"], "run": best})


def _compared(documents: DataFrame, items: DataFrame, run: int, gram: int, broadcast_rows: int) -> DataFrame:
    """Documents and items that share a fingerprint: ``(doc_id, doc_key, item_id, shifts, doc_words, item_words)``.

    ``shifts`` are the diagonals of the shared fingerprints, ``doc_key`` is a hash of the document's text.
    """
    probes = cut(fingerprints(items, "item_id", "text", gram, run))
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    probes = small(probes.select(F.col("key").alias("item_id"), "hash", F.col("place").alias("item_place")))
    hits = (
        fingerprints(documents, "doc_id", "text", gram, run)
        .join(probes, "hash")
        .select(F.col("key").alias("doc_id"), "item_id", (F.col("place") - F.col("item_place")).alias("shift"))
        .distinct()
    )
    hits = cut(hits.groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts")))
    docs = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("doc_text"))
    texts = items.where("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item_text"))
    few = texts.join(small(hits.select("item_id").distinct()), "item_id", "left_semi")
    pairs = docs.join(small(hits), "doc_id").join(small(few), "item_id")
    return pairs.select(
        "doc_id", F.xxhash64("doc_text").alias("doc_key"), "item_id", "shifts",
        lower_words(F.col("doc_text")).alias("doc_words"), lower_words(F.col("item_text")).alias("item_words"),
    )


def leaked_items(
    documents: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The documents that hold ``run`` words in a row of an item: ``(doc_id, item_id, run)``, ``run`` being the longest.

    Fingerprints of both sides are joined on their hash; every hit names a diagonal of the two texts, which is then
    compared word by word, so a hash that two grams share is no error. Items and hits are broadcast only if their
    counted rows are at most ``broadcast_rows``; otherwise the same joins are shuffled. Fingerprints that many
    documents share are no hot key: the join drops what no item has, and hits are collapsed to pairs map-side.

    Nulls: a null id or text, and a text with fewer than ``run`` words, give no row. Repeated rows count once. Extra
    columns are ignored. Either side may be empty.
    """
    pairs = _compared(documents, items, run, gram, broadcast_rows).drop("doc_key")
    found = pairs.mapInPandas(_longest_runs, "doc_id bigint, item_id bigint, run int")
    return found.where(F.col("run") >= run).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


def passages(
    documents: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The passages of items in each document: ``(doc_id, doc_key, spans)``, found as in ``leaked_items``.

    ``spans`` are the first word and the word after of every run of at least ``run`` words shared with an item, counted
    in the document's ``lower_words``; spans of different items may overlap. Documents with one id and different texts
    have a row each, told apart by ``doc_key``, ``xxhash64`` of the text. Documents without a passage have no row.
    """

    def runs(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pairs:
            out = []
            for pair in pdf.itertuples(index=False):
                for first, end in _equal_runs(np.asarray(pair.doc_words, object), np.asarray(pair.item_words, object), pair.shifts):
                    out += [(pair.doc_id, pair.doc_key, a, b) for a, b in zip(first, end, strict=True) if b - a >= run]
            yield pd.DataFrame(out, columns=["doc_id", "doc_key", "first", "end"])

    pairs = _compared(documents, items, run, gram, broadcast_rows).drop("item_id")
    found = pairs.mapInPandas(runs, "doc_id bigint, doc_key bigint, first int, end int")
    return found.groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
