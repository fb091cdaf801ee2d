"""Best documents of many queries against brute force, and what a search of many queries shuffles."""

import math
import random
import re
import time

from eventloom.functions import text as T
from eventloom.operators import retrieval as R
from eventloom.plans import retrieval as plans

WORDS = "cache index server retry token budget queue merge branch deploy über naïve 12 v2 a_b x the of and".split()


def _terms(text):
    return re.findall(r"\w+", text.lower())


def _scores(queries, docs):
    """Document, score of each query: rows of one document and length are one text."""
    texts = {}
    for d, text in docs:
        if d is not None and text is not None:
            texts.setdefault((d, len(_terms(text))), []).extend(_terms(text))
    rows = [_terms(t) for d, t in docs if d is not None and t is not None]
    mean, total, out = sum(map(len, rows)) / len(rows), len(rows), {}
    asked = {}
    for q, text in queries:
        if q is not None and text is not None:
            asked.setdefault(q, set()).update([t for t in _terms(text) if len(t) >= 2 and t not in T.STOPWORDS][:24])
    for q, ts in asked.items():
        for t in ts:
            df = sum(t in x for x in texts.values())
            for (d, n), x in texts.items():
                if tf := x.count(t):
                    out[q, d] = out.get((q, d), 0) + math.log1p((total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    return out


def test_best_documents_of_random_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERIES", 7)
    monkeypatch.setattr(R, "TILE", 3)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    docs = [(rng.randrange(70), text(12)) for _ in range(120)] + [(1, "cache cache"), (1, "cache index"), (1, "queue"), (None, "cache"), (200, None), (201, "")]
    queries = [(i, text(9)) for i in range(30)] + [(3, "cache queue cache"), (3, "queue"), (40, "nothing"), (41, ""), (42, None), (None, "cache")]
    frames = spark.createDataFrame(queries, "query_id bigint, text string").repartition(2), spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 5)) for r in R.best_by_bm25(*frames, 4).collect()}
    want = {}
    scores = _scores(queries, docs)
    for q in {q for q, _ in scores}:
        for rank, (s, d) in enumerate(sorted((-round(s, 6), d) for (k, d), s in scores.items() if k == q)[:4], 1):
            want[q, rank] = (d, round(-s, 5))
    assert got == want


def test_ties_go_to_the_lesser_id(spark):
    docs = spark.createDataFrame([(i, "cache index") for i in range(400, 0, -1)], "doc_id bigint, text string").repartition(7)
    queries = spark.createDataFrame([("q", "index")], "query_id string, text string")
    assert [r.doc_id for r in R.best_by_bm25(queries, docs, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_vectors_equal_the_hashes_of_terms(spark):
    df = spark.createDataFrame([("a", "cache Cache über 12"), ("b", ""), ("c", None), (None, "x")], "id string, text string")
    rows = {r.id: r.embedding for r in R.text_vectors(df, "id", "text").collect()}
    hashes = [r.h for r in spark.createDataFrame([("cache",), ("über",), ("12",)], "t string").select(T.fnv1a("t").alias("h")).collect()]
    want = [0.0] * R.WIDTH
    for h in hashes:
        want[h % R.WIDTH] += 1.0 if (h >> 16) % 2 == 0 else -1.0
    assert rows == {"a": want, "b": [0.0] * R.WIDTH}


def test_many_queries_shuffle_little(spark):
    """A million pairs of a query and a document that share a word: of an index only the best of a query are shuffled."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    queries = spark.createDataFrame([(i, t[:60]) for i, t in rows[::4]], "query_id bigint, text string")

    def shuffled():
        time.sleep(1)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    lists = plans._three_lists(queries, docs, 10)
    assert lists["keyword"].count() == lists["vector"].count() == 5000
    assert shuffled() - before < 2_000_000
