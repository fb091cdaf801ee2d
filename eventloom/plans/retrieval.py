"""Queries of retrieval and their SQL. Searches ask with every row whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import retrieval as R
from eventloom.operators.state import live
from eventloom.session import written

AS_OF = "2026-07-01 00:00:00"
HOPS = {"supersedes": 0.6, "evidence": 0.4}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _questions(spark, sf_dir):
    return _read(spark, sf_dir, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def _item_texts(spark, sf_dir):
    items = _read(spark, sf_dir, "memory_items")
    text = F.concat_ws(" ", "text", F.concat_ws(" ", "tags"), "reason")
    return items.select(F.col("id").alias("doc_id"), text.alias("text"))


def keyword_search(spark, sf_dir):
    """The ten best documents of each question by BM25."""
    return R.top(R.bm25(_questions(spark, sf_dir), _read(spark, sf_dir, "documents").select("doc_id", "text")), 10)


def item_search(spark, sf_dir):
    """The ten best active memory items of each question by BM25 with importance, recency and confidence."""
    found = R.bm25(_questions(spark, sf_dir), _item_texts(spark, sf_dir))
    items = _read(spark, sf_dir, "memory_items").where("status = 'active'")
    seen = F.greatest("last_validated_at", "last_used_at", "updated_at")
    age = (F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - F.unix_seconds(seen.cast("timestamp"))) / 86400.0
    scored = found.join(items.select(F.col("id").alias("doc_id"), "importance", "confidence", age.alias("age")), "doc_id")
    score = R.metadata_score(F.col("score"), F.col("importance"), F.coalesce("confidence", F.lit(0.5)), F.col("age"))
    return R.top(scored.select("query_id", "doc_id", F.round(score, 6).alias("score")).where("score IS NOT NULL"), 10)


def term_overlap(spark, sf_dir):
    """The ten documents of each question that share most of its terms."""
    asked = _questions(spark, sf_dir).select("query_id", F.explode(R.query_terms(F.col("text"))).alias("term"))
    rows = _read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(R.terms(F.col("text")))).alias("term"))
    return R.top(asked.join(rows, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("score")), 10)


def hybrid_search(spark, sf_dir):
    """The keyword and overlap lists of each question fused by reciprocal ranks."""
    return R.top(R.fused([(keyword_search(spark, sf_dir), 0.5), (term_overlap(spark, sf_dir), 0.5)]), 10)


def search_quality(spark, sf_dir):
    """How far the overlap list finds what the keyword list finds: recall at ten and reciprocal rank of its best."""
    gold, other = keyword_search(spark, sf_dir), term_overlap(spark, sf_dir)
    hits = gold.select("query_id", "doc_id", F.col("rank").alias("gold")).join(other.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    first = F.max(F.when(F.col("gold") == 1, 1 / F.col("rank")))
    return hits.groupBy("query_id").agg(F.round(F.count("rank") / F.count("*"), 6).alias("recall"), F.round(F.coalesce(first, F.lit(0.0)), 6).alias("reciprocal_rank"))


def keyword_weights(spark, sf_dir):
    """The kinds of exact tokens in each test item and the keyword weight that they ask for."""
    rows = _read(spark, sf_dir, "eval_items")
    text = F.coalesce("text", F.lit(""))
    return rows.select("item_id", F.concat_ws(",", R.exact_kinds(text)).alias("kinds"), R.keyword_weight(text, 0.5).alias("weight"))


def _nearest(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    return R.nearest(rows, rows.where("vec_id % 50 = 0"), 10)


def cosine_nearest(spark, sf_dir):
    """The ten nearest vectors of each fiftieth vector."""
    return _nearest(spark, sf_dir).select("query_id", "doc_id", "score", "rank")


def cosine_standing_out(spark, sf_dir):
    """Of the nearest vectors those that stand out from all."""
    return R.standing_out(_nearest(spark, sf_dir), 0.2).select("query_id", "doc_id", "score", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def _edges(spark, sf_dir):
    items = _read(spark, sf_dir, "memory_items")
    confidence = F.coalesce("confidence", F.lit(0.8))
    older = items.select(F.col("id").alias("a"), F.explode("supersedes").alias("b"), (HOPS["supersedes"] * confidence).alias("weight"))
    newer = items.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("a"), F.col("id").alias("b"), (HOPS["supersedes"] * confidence).alias("weight"))
    named = items.where("id IS NOT NULL").select("id", F.explode(F.array_distinct("evidence")).alias("event"), (HOPS["evidence"] * confidence).alias("weight"))
    least = named.groupBy("event").agg(F.min("id").alias("b"))
    shared = named.join(least, "event").select(F.col("id").alias("a"), "b", "weight")
    return older.unionByName(newer).unionByName(shared).where("a <> b")


def graph_neighbours(spark, sf_dir):
    """Active items one hop from the active critical ones over supersession and shared evidence, with the best edge's score."""
    items = _read(spark, sf_dir, "memory_items")
    seeds = items.where("status = 'active' AND importance = 'critical'").select("id", F.coalesce("confidence", F.lit(0.5)).alias("score"))
    return R.neighbours(_edges(spark, sf_dir), seeds, items.where("status = 'active'")).select("id", F.round("score", 6).alias("score"))


def item_keyword_weights(spark, sf_dir):
    """The kinds of exact tokens in each memory item and the keyword weight that a search for it asks for."""
    text = F.coalesce("text", F.lit(""))
    return _read(spark, sf_dir, "memory_items").select("id", F.concat_ws(",", R.exact_kinds(text)).alias("kinds"), R.keyword_weight(text, 0.5).alias("weight"))


def _live(spark, sf_dir):
    """Active items within their time to live."""
    return _read(spark, sf_dir, "memory_items").where(live(AS_OF)).select("id")


def _three_lists(queries: DataFrame, docs: DataFrame, n: int) -> dict[str, DataFrame]:
    """The best ``n`` of each query by keywords, by vectors of hashed terms, and by both."""
    keyword = written(R.best_by_bm25(queries, docs, n), "keyword-list")
    vectors = written(R.text_vectors(docs, "doc_id", "text"), "text-vectors")  # counted before they are compared
    asked = R.text_vectors(queries.withColumn("doc_id", F.col("query_id")), "doc_id", "text")
    vector = written(R.nearest(vectors, asked, n, "doc_id", block=4 * R.BLOCK).where("score > 0"), "vector-list")
    weights = queries.select("query_id", R.keyword_weight(F.coalesce("text", F.lit("")), 0.5).alias("weight"))
    return {"keyword": keyword, "vector": vector, "both": R.top(R.fused_by_query(keyword, vector, weights), n)}


def hybrid_items(spark, sf_dir):
    """The ten best live memory items of each question by keywords and vectors, and the live items one hop from them."""
    questions = _questions(spark, sf_dir).withColumn("query_id", F.col("query_id").cast("string"))
    alive = written(_live(spark, sf_dir), "live-items")
    docs = _item_texts(spark, sf_dir).join(alive, F.col("doc_id") == F.col("id"), "left_semi")
    best = written(_three_lists(questions, docs, 10)["both"].select("query_id", "doc_id", "score"), "best-items")
    edges = _edges(spark, sf_dir)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    hop = best.join(both, F.col("doc_id") == F.col("a")).groupBy("query_id", F.col("b").alias("doc_id")).agg(F.round(F.max(F.col("score") * F.col("weight")), 8).alias("score"))
    hop = hop.join(alive, F.col("doc_id") == F.col("id"), "left_semi").join(best, ["query_id", "doc_id"], "left_anti")
    return best.withColumn("hop", F.lit(0)).unionByName(hop.withColumn("hop", F.lit(1)))


def retrieval_evaluation(spark, sf_dir):
    """How well each kind of search finds every fiftieth document by eight words of it: recall at 5 and mean reciprocal rank.

    A document counts as found where any with the same text is."""
    docs = _read(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    words = R.terms(F.col("text"))
    queries = docs.where("doc_id % 50 = 0").where(F.size(words) >= 20).select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 9, 8), " ").alias("text"))
    queries = written(queries, "golden-queries")
    same = docs.select("doc_id", F.xxhash64("text").alias("h"))
    gold = queries.join(same, F.col("query_id") == F.col("doc_id")).select("query_id", F.col("h").alias("wanted"))
    out = None
    for mode, found in _three_lists(queries, docs, 10).items():
        hits = found.join(same, "doc_id").join(gold, "query_id").where("h = wanted").groupBy("query_id").agg(F.min("rank").alias("rank"))
        each = gold.join(hits, "query_id", "left")
        row = each.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0))), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
        row = row.select(F.lit(mode).alias("mode"), "queries", "recall", "mrr")
        out = row if out is None else out.unionByName(row)
    return out


def packed_context(spark, sf_dir):
    """The items of each category that a budget of 600 tokens takes, by importance and last change."""
    items = _read(spark, sf_dir, "memory_items").where("status = 'active' AND category IS NOT NULL")
    rows = items.select("id", "category", "updated_at", T.importance_rank(F.col("importance")).alias("level"), T.estimated_tokens(F.coalesce("text", F.lit(""))).alias("cost"))
    order = [-F.coalesce("level", F.lit(-9)), -F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62)))]
    return R.packed(rows, "category", order, "cost", 600)


QUERIES = {
    f.__name__: f
    for f in (
        keyword_search, item_search, term_overlap, hybrid_search, search_quality, keyword_weights, cosine_nearest, cosine_standing_out,
        graph_neighbours, packed_context, item_keyword_weights, hybrid_items, retrieval_evaluation,
    )
}

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_PATTERN = "'[\\p{L}\\p{N}_]+'"
_ASKED = f"""asked AS (
    SELECT DISTINCT query_id, unnest(list_filter(ts, lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))[1:24]) AS term
    FROM (SELECT item_id AS query_id, regexp_extract_all(lower(text), {_PATTERN}) AS ts FROM eval_items WHERE item_id % 50 = 0))"""


_KINDS = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k}' END" for k, p in R.EXACT_KINDS.items())


def _asked(queries: str) -> str:
    return f"""asked AS (
    SELECT DISTINCT query_id, unnest(list_filter(ts, lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))[1:24]) AS term
    FROM (SELECT query_id, regexp_extract_all(lower(text), {_PATTERN}) AS ts FROM ({queries})))"""


def _vectors(name: str, rows: str, key: str) -> str:
    """Vectors of hashed terms; terms are hashed code point by code point."""
    fnv = "list_reduce(list_transform(string_split(t, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT)"
    return f"""{name}_h AS (SELECT {key} AS k, list_transform(list_distinct(regexp_extract_all(lower(text), {_PATTERN})), lambda t: {fnv}) AS hs FROM ({rows}) WHERE text IS NOT NULL),
    {name} AS (SELECT k, list_transform(range({R.WIDTH}), lambda d: CAST(coalesce(list_sum(list_transform(list_filter(hs, lambda h: h % {R.WIDTH} = d),
        lambda h: CASE WHEN (h >> 16) % 2 = 0 THEN 1.0 ELSE -1.0 END)), 0) AS DOUBLE)) AS v FROM {name}_h)"""


def _lists(queries: str, docs: str) -> str:
    """Common tables ``keyword``, ``vector`` and ``fused``: the ten best of each query."""
    top = lambda of: f"SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM {of} QUALIFY rank <= 10"
    weight = f"""SELECT query_id, CASE WHEN regexp_matches(kinds, '(^|,)(uuid|path|memory_id)(,|$)') THEN 0.8 WHEN kinds <> '' THEN 0.7 ELSE 0.5 END::DOUBLE AS weight
        FROM (SELECT query_id, concat_ws(',', {_KINDS}) AS kinds FROM (SELECT query_id, coalesce(text, '') AS t FROM ({queries})))"""
    return f"""{_bm25(docs, _asked(queries))}, keyword AS ({top('scores')}), {_vectors('qv', queries, 'query_id')}, {_vectors('dv', docs, 'doc_id')},
    cosines AS (SELECT q.k AS query_id, d.k AS doc_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM qv q, dv d WHERE list_sum(list_transform(q.v, lambda x: abs(x))) > 0
        AND list_sum(list_transform(d.v, lambda x: abs(x))) > 0),
    vector AS ({top('(SELECT * FROM cosines WHERE score > 0)')}), weights AS ({weight}),
    summed AS (SELECT query_id, doc_id, round(sum(s), 8) AS score FROM (
        SELECT query_id, doc_id, weight / (60 + rank) AS s FROM keyword JOIN weights USING (query_id)
        UNION ALL SELECT query_id, doc_id, (1 - weight) / (60 + rank) FROM vector JOIN weights USING (query_id)) GROUP BY ALL),
    fused AS ({top('summed')})"""


def _bm25(docs: str, asked: str = _ASKED) -> str:
    return f"""{asked}, docs AS (SELECT doc_id, regexp_extract_all(lower(text), {_PATTERN}) AS ts FROM ({docs}) WHERE text IS NOT NULL),
    totals AS (SELECT count(*) AS total, avg(len(ts)) AS mean_length FROM docs),
    postings AS (SELECT term, doc_id, length, count(*) AS tf FROM (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM docs)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    found AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    scores AS (SELECT query_id, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
        FROM asked JOIN postings USING (term) JOIN found USING (term), totals GROUP BY query_id, doc_id)"""


_DOCS = "SELECT doc_id, text FROM documents"
_KEYWORD = f"""SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores) WHERE rank <= 10"""
_OVERLAP = f"""SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (
    SELECT query_id, doc_id, count(*) AS score FROM asked JOIN (
        SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), {_PATTERN}))) AS term FROM documents WHERE text IS NOT NULL) USING (term) GROUP BY ALL)) WHERE rank <= 10"""
_SIMS = """sims AS (
    SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS s
    FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings d),
    stats AS (SELECT query_id, avg(s) AS mean, stddev_pop(s) AS deviation FROM sims GROUP BY query_id),
    near AS (SELECT * FROM (SELECT query_id, doc_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS INT) AS rank FROM sims) WHERE rank <= 10)"""
_EDGES = """named AS (SELECT id, unnest(list_distinct(evidence)) AS event, 0.4 * coalesce(confidence, 0.8) AS w FROM memory_items WHERE id IS NOT NULL),
    leads AS (SELECT event, min(id) AS b FROM named GROUP BY event),
    e AS (
        SELECT id AS a, unnest(supersedes) AS b, 0.6 * coalesce(confidence, 0.8) AS w FROM memory_items
        UNION ALL SELECT superseded_by, id, 0.6 * coalesce(confidence, 0.8) FROM memory_items WHERE superseded_by IS NOT NULL
        UNION ALL SELECT id, b, w FROM named JOIN leads USING (event))"""
SQL = {
    "keyword_search": f"WITH {_bm25(_DOCS)} {_KEYWORD}",
    "item_search": f"""
        WITH {_bm25("SELECT id AS doc_id, concat_ws(' ', text, CASE WHEN tags IS NULL THEN '' ELSE array_to_string(tags, ' ') END, reason) AS text FROM memory_items")},
        joined AS (
            SELECT query_id, doc_id, round((least(1.0, score / 10) + 0.35 * pow(0.5, coalesce(
                (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(greatest(last_validated_at, last_used_at, updated_at)))) / 86400.0, 30.0) / 7))
                * CASE importance WHEN 'critical' THEN 2.2 WHEN 'high' THEN 1.6 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.6 WHEN 'ephemeral' THEN 0.3 END
                * (0.5 + 0.5 * coalesce(confidence, 0.5)), 6) AS score
            FROM scores JOIN memory_items ON id = doc_id WHERE status = 'active')
        SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank
            FROM joined WHERE score IS NOT NULL) WHERE rank <= 10""",
    "term_overlap": f"WITH {_ASKED} {_OVERLAP}",
    "hybrid_search": f"""
        WITH {_bm25(_DOCS)}, k AS ({_KEYWORD}), o AS ({_OVERLAP}), s AS (
            SELECT query_id, doc_id, round(sum(w), 8) AS score FROM (
                SELECT query_id, doc_id, 0.5 / (60 + rank) AS w FROM k UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM o) GROUP BY ALL)
        SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= 10""",
    "search_quality": f"""
        WITH {_bm25(_DOCS)}, k AS ({_KEYWORD}), o AS ({_OVERLAP})
        SELECT k.query_id, round(count(o.rank) / count(*), 6) AS recall, round(coalesce(max(1 / o.rank) FILTER (k.rank = 1), 0.0), 6) AS reciprocal_rank
        FROM k LEFT JOIN o ON o.query_id = k.query_id AND o.doc_id = k.doc_id GROUP BY k.query_id""",
    "keyword_weights": f"""
        SELECT item_id, kinds, CASE WHEN regexp_matches(kinds, '(^|,)(uuid|path|memory_id)(,|$)') THEN 0.8 WHEN kinds <> '' THEN 0.7 ELSE 0.5 END::DOUBLE AS weight
        FROM (SELECT item_id, concat_ws(',', {_KINDS}) AS kinds FROM (SELECT item_id, coalesce(text, '') AS t FROM eval_items))""",
    "cosine_nearest": f"WITH {_SIMS} SELECT query_id, doc_id, score, rank FROM near",
    "cosine_standing_out": f"""
        WITH {_SIMS} SELECT query_id, doc_id, score, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM near JOIN stats USING (query_id)
        WHERE score > 0 AND score >= greatest(0.2, mean + deviation) - 1e-6""",
    "graph_neighbours": f"""
        WITH {_EDGES},
        both_ways AS (SELECT a, b, w FROM e WHERE a <> b UNION ALL SELECT b, a, w FROM e WHERE a <> b),
        seeds AS (SELECT id, coalesce(confidence, 0.5) AS score FROM memory_items WHERE status = 'active' AND importance = 'critical')
        SELECT b AS id, round(max(score * w), 6) AS score FROM both_ways JOIN seeds ON seeds.id = a
        WHERE b NOT IN (SELECT id FROM seeds) AND b IN (SELECT id FROM memory_items WHERE status = 'active') GROUP BY b""",
    "packed_context": """
        WITH RECURSIVE r AS (
            SELECT id, category, CAST(ceil((length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0) AS BIGINT) AS cost,
                   row_number() OVER (PARTITION BY category ORDER BY list_position(['ephemeral', 'low', 'medium', 'high', 'critical'], importance) DESC NULLS LAST,
                                      updated_at DESC NULLS LAST, id) AS k
            FROM memory_items WHERE status = 'active' AND category IS NOT NULL),
        walk AS (
            SELECT category, k, id, CASE WHEN cost <= 600 THEN cost ELSE 0 END AS used, cost <= 600 AS kept FROM r WHERE k = 1
            UNION ALL
            SELECT r.category, r.k, r.id, CASE WHEN w.used + r.cost <= 600 THEN w.used + r.cost ELSE w.used END, w.used + r.cost <= 600
            FROM walk w JOIN r ON r.category = w.category AND r.k = w.k + 1)
        SELECT category, max(used) OVER (PARTITION BY category) AS used, CAST(row_number() OVER (PARTITION BY category ORDER BY k) - 1 AS INT) AS place, id
        FROM walk WHERE kept""",
    "item_keyword_weights": f"""
        SELECT id, kinds, CASE WHEN regexp_matches(kinds, '(^|,)(uuid|path|memory_id)(,|$)') THEN 0.8 WHEN kinds <> '' THEN 0.7 ELSE 0.5 END::DOUBLE AS weight
        FROM (SELECT id, concat_ws(',', {_KINDS}) AS kinds FROM (SELECT id, coalesce(text, '') AS t FROM memory_items))""",
    "hybrid_items": f"""
        WITH alive AS (
            SELECT *, concat_ws(' ', text, CASE WHEN tags IS NULL THEN '' ELSE array_to_string(tags, ' ') END, reason) AS words FROM memory_items
            WHERE status = 'active' AND (ttl_seconds IS NULL OR coalesce(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(coalesce(last_validated_at, updated_at, created_at))) <= ttl_seconds, true))),
        {_lists("SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM eval_items WHERE item_id % 50 = 0", "SELECT id AS doc_id, words AS text FROM alive")},
        {_EDGES},
        both_ways AS (SELECT a, b, w FROM e WHERE a <> b UNION ALL SELECT b, a, w FROM e WHERE a <> b)
        SELECT query_id, doc_id, score, 0 AS hop FROM fused
        UNION ALL
        SELECT query_id, b, round(max(score * w), 8), 1 FROM fused f JOIN both_ways ON a = doc_id
        WHERE b IN (SELECT id FROM alive) AND NOT EXISTS (SELECT 1 FROM fused x WHERE x.query_id = f.query_id AND x.doc_id = b) GROUP BY query_id, b""",
    "retrieval_evaluation": f"""
        WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), {_PATTERN}) AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        golden AS (SELECT doc_id AS query_id, array_to_string(ws[9:16], ' ') AS text FROM d WHERE doc_id % 50 = 0 AND len(ws) >= 20),
        {_lists("SELECT * FROM golden", "SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL")},
        every AS (SELECT 'keyword' AS mode, * FROM keyword UNION ALL SELECT 'vector', * FROM vector UNION ALL SELECT 'both', * FROM fused),
        hits AS (
            SELECT mode, query_id, min(rank) AS rank FROM every e JOIN documents f ON f.doc_id = e.doc_id JOIN documents g ON g.doc_id = e.query_id
            WHERE f.text = g.text GROUP BY ALL)
        SELECT mode, count(*) AS queries, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1 / rank, 0.0)), 6) AS mrr
        FROM golden CROSS JOIN (SELECT unnest(['keyword', 'vector', 'both']) AS mode) LEFT JOIN hits USING (mode, query_id) GROUP BY mode""",
}
