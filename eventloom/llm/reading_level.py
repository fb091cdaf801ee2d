"""Reading level of prose by smoothed unigram models, one for each level and language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.leakage import BROADCAST_ROWS, passages
from eventloom.llm.words import lower_words
from eventloom.session import cut, written

LEVELS = 4
#: Words of a document from which it has a level.
LEAST_WORDS = 40
#: Buckets of hashed words: the fixed size of each unigram model.
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Rounds over the whole corpus in which the models are fitted again to the levels they gave.
ROUNDS = 2
#: Labelled documents that the first models are fitted to, at most; beyond it those with the least hash of their id.
LABEL_BOUND = 50_000
#: Mean words in a sentence above which a text without any labels to learn from has level 2, 3 and 4.
FORMULA = (7.0, 11.0, 18.0)

#: Frequent function words that tell the language of a text; one with none of them is of another language,
#: whose models learn from sentence lengths alone unless it has labels.
FUNCTION_WORDS = {
    "it": "il lo la gli le i un una uno di che con per non alla del della nel ma poi se ogni".split(),
    "de": "der die das den dem ein eine einer und mit ohne nicht von zu am bei aber dann im ist".split(),
    "en": "the a an and of to in is with by at for but so then or that".split(),
    "other": [],
}
_END = "."

#: Fenced code and log lines are no prose, nor are tokens that are paths, identifiers, numbers or markup.
_NOT_PROSE = r"(?s:```.*?```)|(?m:^[ \t]*\[?\d{2}:\d{2}:\d{2}[^\n]*)"
_IDENTIFIER = re.compile(r"[_/\\@=<>{}\d`]|[a-zß-öø-ÿ][A-ZÀ-ÖØ-Þ]")
_WORD = re.compile(r"[^\W\d_]+")
#: The white space that ``prose_chunks`` splits at.
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def prose_chunks(text: Column) -> Column:
    """The prose of a text, split at white space."""
    return F.split(F.regexp_replace(text, _NOT_PROSE, " "), r"\s+")


def text_pieces(text: Column) -> Column:
    """A text as the words and single characters between them, each with its number of ``lower_words``.

    What is no prose is one piece, given out as a blank; the joined pieces are the text that ``prose_chunks`` splits."""
    pieces = F.regexp_extract_all(text, F.lit(_NOT_PROSE + r"|[\p{L}\p{N}]+|(?s:.)"), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(F.regexp_replace(p, _NOT_PROSE, " ").alias("piece"), F.size(lower_words(p)).alias("n")))


def _without_spans(pieces: pa.Array, sizes: np.ndarray, first: np.ndarray, end: np.ndarray) -> str:
    """The text without the words of the spans, the marks between them and those that follow the last one at once.

    ``sizes`` are the words of each piece, ``first`` and ``end`` the words where spans begin and have ended."""
    edges = np.zeros(sizes.sum() + 2, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, end, -1)
    inside = np.cumsum(edges)[:-1] > 0
    upto = np.concatenate([[0], np.cumsum(inside)])
    at = np.cumsum(sizes) - sizes
    word, place = sizes > 0, np.arange(len(sizes))
    hit = word & (upto[at + sizes] > upto[at])
    # A mark goes with the word before it, up to the first blank outside.
    blank = ~word & ~inside[at] & pc.match_substring_regex(pieces, "^[ \t\n\x0b\f\r]").to_numpy(zero_copy_only=False)
    before = np.maximum.accumulate(np.where(word, place, -1))
    stopped = np.maximum.accumulate(np.where(blank, place, -1)) > before
    gone = np.where(word, hit, (before >= 0) & hit[before] & ~stopped)
    return "".join(pc.if_else(pa.array(gone), " ", pieces).to_pylist())


def _set_aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each document; where it has test passages, those of the rest."""
    for batch in batches:
        found = pc.is_valid(batch.column("spans"))
        yield batch.filter(pc.invert(found)).select(["doc_id", "chunks"])
        some, rest = batch.filter(found), []
        for k in range(len(some)):
            pieces, sizes, spans = (some.column(c)[k].values for c in ("pieces", "sizes", "spans"))
            first, end = spans.field("first").to_numpy(), spans.field("end").to_numpy()
            rest.append(_SPACE.split(_without_spans(pieces, sizes.to_numpy(), first, end)))
        yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(rest, pa.list_(pa.string()))], ["doc_id", "chunks"])


def chunk_words(chunk: str) -> list[str]:
    """The lower-case words of a chunk, and a mark if it ends a sentence; an identifier has no words."""
    words = [] if _IDENTIFIER.search(chunk) else _WORD.findall(chunk.lower())
    return [*words, _END] if chunk[-1:] in (".", "!", "?") else words


def _gathered(values: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that begin at ``first`` (with one end more), for each of ``at``, and their sizes."""
    sizes = (first[1:] - first[:-1])[at]
    ends = np.cumsum(sizes)
    return values[np.repeat(first[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as buckets, the language, and the level that the sentence length alone suggests.

    The words of a chunk are found once for each different chunk of a batch."""
    names = list(FUNCTION_WORDS)
    for batch in _set_aside(batches):
        chunks, n = batch.column("chunks"), len(batch)
        coded = chunks.flatten().dictionary_encode()
        lists = [chunk_words(x) for x in coded.dictionary.to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        words = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).astype(object)
        at, sizes = _gathered(words.indices.to_numpy(), first, coded.indices.to_numpy())
        chunk_ends = np.cumsum(pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False))
        offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes)])[chunk_ends]]).astype(np.int32)
        lengths = np.diff(offsets)
        row = np.repeat(np.arange(n), lengths)
        hits = np.stack([np.bincount(row, np.isin(known, FUNCTION_WORDS[x])[at] if len(at) else None, n) for x in names])
        language = np.where(hits.max(0) > 0, hits.argmax(0), len(names) - 1).astype(np.int32)
        ends = np.bincount(row, (known == _END)[at] if len(at) else None, n)
        formula = 1 + np.searchsorted(FORMULA, (lengths - ends) / np.maximum(ends, 1), "right").astype(np.int32)
        bucket = (pd.util.hash_array(known, categorize=False) % np.uint64(BUCKETS)).astype(np.int32)
        codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket[at]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(language), pa.array(formula), codes], ["doc_id", "language", "formula", "codes"]
        )


class _Counts:
    """Tokens by language, level and bucket."""

    def __init__(self):
        self.of = np.zeros(len(FUNCTION_WORDS) * LEVELS * BUCKETS)

    def add(self, language, level, lengths, codes, weight=None):
        base = np.repeat((language.astype(np.int64) * LEVELS + level) * BUCKETS, lengths)
        np.add.at(self.of, base + codes, 1.0 if weight is None else np.repeat(weight, lengths))

    def batch(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.of)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(self.of[at])], ["place", "n"])


def _parts(batch: pa.RecordBatch):
    codes = batch.column("codes")
    lengths = pc.list_value_length(codes).to_numpy(zero_copy_only=False)
    return batch.column("language").to_numpy(), lengths, codes.flatten().to_numpy()


def _fitted(counts: DataFrame) -> np.ndarray:
    """Smoothed log probabilities (language, bucket, level) from counted tokens; a bucket without tokens says nothing.

    The model's size is fixed by ``BUCKETS``, so the driver gets at most that many counts, however large the corpus.
    """
    rows = counts.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(FUNCTION_WORDS) * LEVELS * BUCKETS)
    n[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    n = n.reshape(len(FUNCTION_WORDS), LEVELS, BUCKETS)
    seen = n.sum(1, keepdims=True) > 0
    total = (n + SMOOTHING * seen).sum(2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(seen, np.log((n + SMOOTHING) / total), 0.0)
    return np.ascontiguousarray(logs.transpose(0, 2, 1).astype(np.float32))


def _levels(model: np.ndarray, language, lengths, codes) -> np.ndarray:
    """The level (from 0) of highest likelihood; the levels have equal priors. Ties go to the lower level."""
    each = model[np.repeat(language, lengths), codes].astype(np.float64)
    sums = np.concatenate([np.zeros((1, LEVELS)), np.cumsum(each, 0)])
    ends = np.cumsum(lengths)
    return (sums[ends] - sums[ends - lengths]).argmax(1)


def reading_levels(
    documents: DataFrame,
    labels: DataFrame,
    rounds: int = ROUNDS,
    bound: int = LABEL_BOUND,
    items: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The level of every document with at least 40 words: ``(doc_id, reading_level)`` from 1 to 4.

    The words of the prose are hashed to a fixed number of buckets. Models are fitted to the labelled documents (each
    label weighs its share of the document's labels), then ``rounds`` times to all documents and the levels they were
    given, labels included again. A language without any label starts from levels by a formula on sentence length.
    Every pass over the corpus is a map with per-task counts and a small sum; nothing is shuffled by word.

    Passages of the test ``items`` (runs of at least 12 words, see ``leakage.passages``) are set aside before anything
    is fitted or scored, but count among the 40 words. Their places are joined to the documents by id and text hash,
    broadcast if there are at most ``broadcast_rows``, else shuffled.

    Nulls: a null id or text gives no row; null labels and labels outside 1 to 4 are ignored. Several labels of one
    document count in part each. A document without prose, or with none but passages, gets the lowest level. Repeated document rows give a row
    each. Without labels the formula seeds all models. Empty documents give no rows. Extra columns are ignored.
    """
    spark = documents.sparkSession
    enough = F.regexp_count(F.col("text"), F.lit(r"[\p{L}\p{N}]+")) >= LEAST_WORDS
    read = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).where(enough)
    read = read.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if items is None:
        read = read.withColumn("spans", F.lit(None).cast("array<struct<first:int,end:int>>"))
    else:
        spans = cut(passages(documents, items, broadcast_rows=broadcast_rows))
        spans = F.broadcast(spans) if spans.count() <= broadcast_rows else spans
        read = read.withColumn("doc_key", F.xxhash64("text")).join(spans, ["doc_id", "doc_key"], "left")
    bare = F.col("spans").isNull()
    coded = written(
        read.select(
            "doc_id", F.when(bare, prose_chunks(F.col("text"))).alias("chunks"), F.when(~bare, text_pieces(F.col("text"))).alias("p"), "spans"
        ).select("doc_id", "chunks", F.col("p.piece").alias("pieces"), F.col("p.n").alias("sizes"), "spans").mapInArrow(_coded, "doc_id bigint, language int, formula int, codes array<int>"),
        "reading-codes",
    )
    share = [F.count_if(F.col("reading_level") == k + 1) / F.count("*") for k in range(LEVELS)]
    given = (
        labels.where("doc_id IS NOT NULL AND reading_level BETWEEN 1 AND 4")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.array(*share).alias("share"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(bound)
    )
    labelled = written(coded.join(F.broadcast(given), "doc_id"), "reading-labelled")
    taught = {r[0] for r in labelled.select("language").distinct().collect()}
    untaught = [k for k in range(len(FUNCTION_WORDS)) if k not in taught]

    def of_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            language, lengths, codes = _parts(batch)
            shares = batch.column("share").flatten().to_numpy().reshape(-1, LEVELS)
            for level in range(LEVELS):
                counts.add(language, np.full(len(language), level), lengths, codes, shares[:, level])
        yield counts.batch()

    def of_formula(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            language, lengths, codes = _parts(batch)
            counts.add(language, batch.column("formula").to_numpy() - 1, lengths, codes)
        yield counts.batch()

    kind = "place bigint, n double"
    from_labels = labelled.mapInArrow(of_labels, kind)
    start = from_labels
    if untaught:
        start = start.unionByName(coded.where(F.col("language").isin(untaught)).mapInArrow(of_formula, kind))
    model = _fitted(start)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def of_levels(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts = _Counts()
            for batch in batches:
                language, lengths, codes = _parts(batch)
                counts.add(language, _levels(sent.value, language, lengths, codes), lengths, codes)
            yield counts.batch()

        model = _fitted(coded.mapInArrow(of_levels, kind).unionByName(from_labels))
    sent = spark.sparkContext.broadcast(model)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _levels(sent.value, *_parts(batch)) + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.astype(np.int32))], ["doc_id", "reading_level"])

    return coded.mapInArrow(level, "doc_id bigint, reading_level int")
