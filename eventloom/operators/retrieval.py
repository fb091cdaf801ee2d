"""Ranking of items for queries: BM25, metadata scores, vectors, fusion, one graph hop and packing under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.session import written

K1, B = 1.2, 0.75
#: Vectors in one block of a similarity search, queries in one block of a keyword search, those of either that are scored
#: at once, and places of a vector of hashed terms.
BLOCK, QUERIES, TILE, WIDTH = 2048, 4096, 128, 32

# Weights of importance in the metadata score, kinds of exact tokens, and the weights they ask for.
IMPORTANCE_WEIGHT = {"critical": 2.2, "high": 1.6, "medium": 1.0, "low": 0.6, "ephemeral": 0.3}
EXACT_KINDS = {
    "uuid": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "path": r"(?i)[\w.-]+/[\w.-]+|\b[\w-]{2,}\.[a-z][a-z0-9]{0,5}\b",
    "memory_id": r"\bmem_[a-z0-9_]+\b|\b[a-z]{1,3}\d{1,4}\b",
    "identifier": r"\b[a-z]+[A-Z][A-Za-z0-9]*\b|\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*\b|\b[A-Za-z0-9]+_[A-Za-z0-9_]+\b",
    "version": r"\bv?\d+\.\d+(?:\.\d+)*\b",
    "number": r"\b\d{3,}\b",
    "flag": r"(?i)(?:^|\s)--?[a-z][\w-]*",
}
STRONG_KINDS = ("uuid", "path", "memory_id")


_TERM = r"[\p{L}\p{N}_]+"


def terms(text: Column) -> Column:
    """The search terms of a text, in lower case, repeated as often as they stand."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def query_terms(text: Column) -> Column:
    """The first 24 terms of a query that have two characters and are no stop words."""
    kept = F.filter(terms(text), lambda t: (F.length(t) >= 2) & ~t.isin(*T.STOPWORDS))
    return F.array_distinct(F.slice(kept, 1, 24))


def bm25(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """BM25 scores ``(query_id, doc_id, score)`` of every document that shares a term with a query.

    ``queries`` has ``query_id, text``, ``docs`` ``doc_id, text``. Postings are joined with the queries' terms only, so
    the frequent words that no query has are dropped before any shuffle. Null ids and texts match nothing.
    """
    asked = queries.where(F.col("query_id").isNotNull()).select("query_id", F.explode(query_terms("text")).alias("term"))
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    totals = rows.agg(F.count("*").alias("total"), F.avg(F.regexp_count(F.lower("text"), F.lit(_TERM))).alias("mean_length"))
    wanted = asked.select("term").distinct()
    # The length stands beside the terms before they are spread, so that no row carries the whole list.
    sized = rows.select("doc_id", terms(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("length"), "ts")
    places = sized.select("doc_id", "length", F.explode("ts").alias("term"))
    postings = places.join(wanted, "term", "left_semi").groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))
    found = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(totals)  # one row of totals
    idf = F.log1p((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = postings.join(found, "term").select("term", "doc_id", weight.alias("w"))
    return asked.join(scored, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))


def best_by_bm25(queries: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The ``n`` best documents of each query by the scores of ``bm25``: ``(query_id, doc_id, score, rank)``.

    For many queries: their terms meet most documents, so the scores, not the texts, are what is large. Documents are
    indexed by Arrow batches, each batch with all of its terms; each block of queries is scored against each index in a
    task, and only the best go on. A query counts each of its terms once; rows of one document are one document, those
    of one length are one text.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", terms(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("length"), "ts")
    parts = rows.select("doc_id", F.array(F.struct("length", "ts")).alias("parts"))
    again = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not again.isEmpty():
        texts = rows.join(again, "doc_id", "left_semi").groupBy("doc_id", "length").agg(F.flatten(F.collect_list("ts")).alias("ts"))
        merged = texts.groupBy("doc_id").agg(F.collect_list(F.struct("length", "ts")).alias("parts"))
        parts = parts.join(again, "doc_id", "left_anti").unionByName(merged)
    kind, asks = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (queries, "query_id")))
    index = written(parts.mapInArrow(_indexed, f"ids array<{kind}>, owners array<int>, lengths array<int>, terms array<string>, counts array<int>, places array<int>, tfs array<int>, said bigint"), "term-index")
    total = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).count()
    mean = (index.agg(F.sum("said")).first()[0] or 0) / max(1, total)
    found = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    asked = queries.where(F.col("query_id").isNotNull()).select("query_id", F.explode(query_terms(F.col("text"))).alias("term")).distinct()
    idf = F.log1p((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = written(asked.join(found, "term").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list(idf).alias("idfs")), "asked-terms")
    block = F.pmod(F.xxhash64("query_id"), F.lit(-(-asked.count() // QUERIES) or 1))
    blocks = asked.groupBy(block.alias("block")).agg(F.collect_list("query_id").alias("q_ids"), F.collect_list("terms").alias("q_terms"), F.collect_list("idfs").alias("q_idfs"))

    names = ["ids", "owners", "lengths", "terms", "counts", "places", "tfs", "q_ids", "q_terms", "q_idfs"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}  # of each query the least score that is among the best of one index
        for batch in batches:
            for row in range(len(batch)):
                ids, owners, lengths, words, counts, places, tfs, q_ids, q_terms, q_idfs = (batch.column(c)[row].values for c in names)
                owners, places, tfs = owners.to_numpy(), places.to_numpy(), tfs.to_numpy()
                size = K1 * (1 - B + B * lengths.to_numpy() / mean)
                weights, at, rank = tfs * (K1 + 1) / (tfs + size[places]), owners[places], pc.rank(ids).to_numpy().astype(np.int64)
                ends, idfs = np.r_[0, np.cumsum(counts.to_numpy())], q_idfs.flatten().to_numpy()
                own, where = np.r_[0, np.cumsum(pc.list_value_length(q_terms).to_numpy())], pc.fill_null(pc.index_in(q_terms.flatten(), value_set=words), -1).to_numpy()
                floor = floors.setdefault(batch.column("block")[row].as_py(), np.zeros(len(q_ids)))
                for low in range(0, len(q_ids), TILE):
                    high = min(low + TILE, len(q_ids))
                    sums = np.zeros((high - low, len(ids)))
                    for q in range(low, high):
                        met = [(slice(ends[t], ends[t + 1]), i) for t, i in zip(where[own[q] : own[q + 1]], idfs[own[q] : own[q + 1]], strict=True) if t >= 0]
                        if met:
                            sums[q - low] = np.bincount(np.concatenate([at[x] for x, _ in met]), np.concatenate([weights[x] * i for x, i in met]), len(ids))
                    i, j = _best(sums, rank, n, floor[low:high], sums > 0)
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i + low)), ids.take(pa.array(j)), pa.array(sums[i, j])], ["query_id", "doc_id", "score"])

    scored = index.crossJoin(blocks).mapInArrow(score, f"query_id {asks}, doc_id {kind}, score double")  # blocks with blocks
    return top(scored.withColumn("score", F.round("score", 6)), n)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An index of each batch: its ids, the document and the length of each text, its terms, how many texts have each,
    these texts with how often they have it, and the sum of that."""
    for batch in batches:
        parts = batch.column("parts")
        owners, texts = np.repeat(np.arange(len(batch)), pc.list_value_length(parts).to_numpy()), parts.flatten()
        lists = texts.field("ts")
        words = lists.flatten().dictionary_encode()
        of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        met, tfs = np.unique(words.indices.to_numpy().astype(np.int64) * len(lists) + of, return_counts=True)
        term, place = np.divmod(met, max(1, len(lists)))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        ints = lambda x: one(pa.array(x.astype(np.int32)))
        columns = [one(batch.column("doc_id")), ints(owners), one(texts.field("length")), one(words.dictionary), ints(np.bincount(term, minlength=len(words.dictionary))), ints(place), ints(tfs), pa.array([int(tfs.sum())])]
        yield pa.RecordBatch.from_arrays(columns, ["ids", "owners", "lengths", "terms", "counts", "places", "tfs", "said"])


def _best(scores: np.ndarray, rank: np.ndarray, k: int, floor: np.ndarray | None = None, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best of each row by the score to six places, then by the column's rank. Nothing below
    ``floor`` counts, which rises to the least that was taken; ``among`` marks what can count at all."""
    r = np.floor(scores * 1e6 + 0.5)
    m = min(k, r.shape[1])
    least = np.partition(r, r.shape[1] - m, axis=1)[:, r.shape[1] - m]
    if floor is not None:
        np.maximum(floor, least, out=floor)
        least = floor
    i, j = np.nonzero((r >= least[:, None]) if among is None else (r >= least[:, None]) & among)
    order = np.lexsort((rank[j], -r[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < m
    return i[first], j[first]


def top(scores: DataFrame, n: int, key: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The ``n`` best items of each query with their rank from 1; ties go to the lesser id."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def metadata_score(relevance: Column, importance: Column, confidence: Column, age_days: Column) -> Column:
    """Relevance (to 1) and recency (half in a week, a missing age is 30 days), weighed by importance and confidence."""
    weight = F.coalesce(*[F.when(importance == k, F.lit(v)) for k, v in IMPORTANCE_WEIGHT.items()])
    recency = F.pow(F.lit(0.5), F.coalesce(age_days, F.lit(30.0)) / 7)
    return (F.least(F.lit(1.0), relevance / 10) + 0.35 * recency) * weight * (0.5 + 0.5 * confidence)


def exact_kinds(text: Column) -> Column:
    """The kinds of exact tokens that a query has."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in EXACT_KINDS.items()]))


def keyword_weight(text: Column, base: float) -> Column:
    """The weight of the keyword list for a query: raised for exact tokens, never lowered; 0 stays 0."""
    kinds = exact_kinds(text)
    strong = F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in STRONG_KINDS]))
    raised = F.when(strong, 0.8).when(F.size(kinds) > 0, 0.7).otherwise(base)
    return F.greatest(F.lit(base), raised) if base > 0 else F.lit(base)


def fused(lists: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``(query_id, doc_id, rank)`` with their weights."""
    parts = [df.select("query_id", "doc_id", (F.lit(w) / (k + F.col("rank"))).alias("s")) for df, w in lists]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    return every.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 8).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Cosine similarities: the ``k`` nearest vectors of each query and the query's mean and deviation over all rows:
    ``(query_id, doc_id, score, mean, deviation)``.

    Both sides are gathered into blocks of at most about ``block`` vectors; each pair of blocks is one matrix product
    in a task, which gives on its best ``k`` for each query and sums. So nothing but blocks is paired. A vector of another
    length or of norm 0 has similarity 0; null vectors and null ids are left out; a query meets itself too.
    """
    kind = vectors.schema[key].dataType.simpleString()
    kind = "string" if kind == "string" else "bigint"
    ready = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast(kind).alias("i"), F.col(vector).cast("array<double>").alias("v"))

    def blocks(df: DataFrame, side: str) -> DataFrame:
        n = -(-df.count() // block) or 1
        return df.groupBy(F.pmod(F.xxhash64("i"), F.lit(n)).alias("b")).agg(F.collect_list("i").alias(f"{side}_ids"), F.collect_list("v").alias(f"{side}_vectors")).drop("b")

    def unit(rows: pa.ListArray, width: int) -> np.ndarray:
        """Rows of unit length from Arrow's buffer; those of another width or without norm are 0."""
        sizes = pc.list_value_length(rows).to_numpy()
        fits, out = sizes == width, np.zeros((len(rows), width))
        out[fits] = rows.flatten().to_numpy()[np.repeat(fits, sizes)].reshape(-1, width)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "doc_id", "score", "total", "squares", "n"]
        for batch in batches:
            for row in range(len(batch)):
                q_ids, q_rows, ids, rows = (batch.column(c)[row].values for c in ("q_ids", "q_vectors", "d_ids", "d_vectors"))
                width = len(q_rows[0])
                queries, rows, m = unit(q_rows, width), unit(rows, width).T, min(k, len(ids))
                rank = pc.rank(ids).to_numpy().astype(np.int64)
                for low in range(0, len(q_ids), TILE):
                    sims = queries[low : low + TILE] @ rows
                    i, j = _best(sims, rank, k)
                    yield pa.RecordBatch.from_arrays(
                        [q_ids.take(pa.array(i + low)), ids.take(pa.array(j)), pa.array(sims[i, j]), pa.array(sims.sum(1)[i] / m), pa.array((sims**2).sum(1)[i] / m), pa.array(np.full(len(i), len(ids) / m))],
                        names,
                    )

    pairs = blocks(ready(vectors), "d").crossJoin(blocks(ready(queries), "q"))  # a task holds the blocks of the latter, the fewer
    found = pairs.mapInArrow(compare, f"query_id {kind}, doc_id {kind}, score double, total double, squares double, n double")
    whole = Window.partitionBy("query_id")
    mean = F.sum("total").over(whole) / F.sum("n").over(whole)
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.sum("squares").over(whole) / F.sum("n").over(whole) - mean * mean))
    ranked = found.withColumn("mean", mean).withColumn("deviation", deviation).withColumn("score", F.round("score", 6))
    return top(ranked, k).select("query_id", "doc_id", "score", "rank", "mean", "deviation")


def standing_out(ranked: DataFrame, floor: float) -> DataFrame:
    """The nearest rows whose score is above zero and at least the floor and one deviation above the mean."""
    return ranked.where((F.col("score") > 0) & (F.col("score") >= F.greatest(F.lit(floor), F.col("mean") + F.col("deviation")) - 1e-6))


def neighbours(edges: DataFrame, seeds: DataFrame, allowed: DataFrame) -> DataFrame:
    """One hop from the seeds over edges ``(a, b, weight)`` in either direction: ``(id, score)``, the best edge of each
    neighbour that is no seed itself and among the ``allowed`` ids. ``seeds`` has ``id, score``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    reached = both.join(seeds.select(F.col("id").alias("a"), F.col("score").alias("from_score")), "a")
    best = reached.groupBy(F.col("b").alias("id")).agg(F.max(F.col("from_score") * F.col("weight")).alias("score"))
    return best.join(seeds.select("id"), "id", "left_anti").join(allowed.select("id"), "id", "left_semi")


def text_vectors(rows: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """Vectors of texts without a model: ``key, embedding``. Each term falls on one of ``width`` places by its FNV hash and
    counts up or down there by another bit of it; a text without terms has a vector of zeros, a null text none."""
    kind = rows.schema[key].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("ts"), len(batch)
            words = lists.flatten().dictionary_encode()
            hashes = np.array([_fnv1a(w) for w in words.dictionary.to_pylist()], np.int64)
            of = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
            each = np.unique(of * max(1, len(hashes)) + words.indices.to_numpy())
            of, term = np.divmod(each, max(1, len(hashes)))
            sums = np.bincount(of * width + hashes[term] % width, np.where((hashes[term] >> 16) % 2 == 0, 1.0, -1.0), n * width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(sums))], [key, "embedding"])

    ready = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, terms(F.col(text)).alias("ts"))
    return ready.mapInArrow(spread, f"{key} {kind}, embedding array<double>")


def _fnv1a(term: str) -> int:
    """``text.fnv1a`` of one term."""
    h = 2166136261
    for c in term:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def fused_by_query(keyword: DataFrame, vector: DataFrame, weights: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of a keyword and a vector list ``(query_id, doc_id, rank)``; ``weights`` has the weight of the
    keyword list of each query, the vector list has the rest of 1."""
    score = lambda df, w: df.join(weights, "query_id").select("query_id", "doc_id", (w / (k + F.col("rank"))).alias("s"))
    every = score(keyword, F.col("weight")).unionAll(score(vector, 1 - F.col("weight")))
    return every.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 8).alias("score"))


def packed(rows: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Greedy packing: in the given order take each row that still fits the group's budget, and skip those that do not:
    ``(group, used, place, id)``. ``order`` are columns whose ascending order counts, such as a negative rank.

    Once a row of some cost does not fit, none of that cost fits later. So of each cost c only the first ``budget / c`` rows
    can be taken, and a group of any size is decided by a list of at most ``budget`` times its logarithm; the rank by
    group and cost is cut to ``budget`` before any shuffle. Rows without cost are always taken; rows with a null cost or
    group are left out.
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    one = rows.where(F.col(group).isNotNull()).select(group, F.col(cost).cast("bigint").alias("c"), F.struct(*keys, "id", F.col(cost).cast("bigint").alias("cost")).alias("x"))
    rank = F.row_number().over(Window.partitionBy(group, "c").orderBy("x"))
    paid = one.where((F.col("c") > 0) & (F.col("c") <= budget)).withColumn("rank", rank).where(F.col("rank") <= budget).where(F.col("rank") * F.col("c") <= budget)
    lists = paid.groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("run"))
    taken = F.aggregate(
        "run",
        F.struct(F.lit(0).cast("bigint").alias("used"), F.filter("run", lambda x: F.lit(False)).alias("kept")),
        lambda a, x: F.when(
            a["used"] + x["cost"] <= budget, F.struct((a["used"] + x["cost"]).alias("used"), F.array_append(a["kept"], x).alias("kept"))
        ).otherwise(a),
    )
    decided = lists.select(group, taken.alias("t"))
    every = decided.select(group, F.explode("t.kept").alias("x")).unionByName(one.where("c = 0").select(group, "x"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("x")) - 1
    return every.withColumn("place", place).join(decided.select(group, "t.used"), group, "left").select(
        group, F.coalesce("used", F.lit(0).cast("bigint")).alias("used"), "place", F.col("x.id").alias("id")
    )
