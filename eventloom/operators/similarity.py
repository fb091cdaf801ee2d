"""Exact set similarity by prefix filtering, restatements and contradictions among items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as T

#: Trigram similarity from which two statements say the same, and from which they share a subject.
RESTATED, SUBJECT = 0.42, 0.2

# The categories that can contradict each other, words that turn a statement round, and words that name no subject.
COMPARED = ("decisions", "constraints", "requirements", "architecture", "conventions", "goals")
COMPARABLE = (
    ("constraints", "decisions"), ("constraints", "architecture"), ("constraints", "conventions"), ("requirements", "decisions"),
    ("requirements", "architecture"), ("goals", "decisions"), ("architecture", "decisions"),
)
NEGATED = T.any_word("not", "never", "no longer", "don'?t", "does ?n'?t", "avoid", "stop", "without", "non", "mai", "senza", "evitare")
NO_SUBJECT = (
    "must", "should", "always", "never", "need", "needs", "used", "using", "with", "from", "into", "this", "that", "them", "they", "when", "where",
    "while", "only", "also", "more", "than", "then", "each", "every", "have", "been", "will", "would", "shall", "does", "deve", "devono", "sempre",
    "anche", "come", "quando", "tutti", "tutte", "essere",
)


def jaccard_pairs(rows: DataFrame, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of rows whose token sets have at least the given Jaccard similarity: ``(a, b, similarity)``, ``a < b``.

    ``rows`` has ``id, tokens`` and the columns in ``keys``, which must be equal in a pair. Two such sets share one of
    the rarest ``n - ceil(threshold * n) + 1`` tokens of each, so only these prefixes are joined, with sets of near
    enough size; the pairs are then compared in full. Rows with equal keys and tokens should be one row before. A null
    id, key or empty set matches nothing.
    """
    sets = rows.where(F.col("id").isNotNull() & (F.size("tokens") > 0)).select("id", *keys, F.array_distinct("tokens").alias("tokens"))
    tokens = sets.select("id", *keys, F.size("tokens").alias("n"), "tokens").select("id", *keys, "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy(*keys, "token").agg(F.count("*").alias("seen")).where("seen > 1")
    # A token that one row alone has can be left out of the join, but counts in the length of its row's prefix.
    rare = F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(1)).alias("seen"), "token")))
    ordered = tokens.join(counts, [*keys, "token"], "left").groupBy("id", *keys, "n").agg(rare.alias("order"))
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    prefix = ordered.select("id", *keys, "n", F.explode(F.slice("order", F.lit(1), length.cast("int"))).alias("p")).where("p.seen > 1")
    side = lambda name: prefix.select(*keys, F.col("p.token").alias("token"), F.col("id").alias(name), F.col("n").alias(f"n_{name}"))
    near = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9)
    pairs = side("a").join(side("b"), [*keys, "token"]).where(near).select("a", "b").distinct()
    full = lambda name, words: sets.select(F.col("id").alias(name), F.col("tokens").alias(words))
    both = F.size(F.array_intersect("v", "w"))
    alike = (both / (F.size("v") + F.size("w") - both)).alias("similarity")
    return pairs.join(full("a", "v"), "a").join(full("b", "w"), "b").select("a", "b", alike).where(F.col("similarity") >= threshold - 1e-9)


def statements(items: DataFrame, by_words: bool = False) -> DataFrame:
    """Different statements of each category, named by the least id that says them: ``id, category, plain, tokens``.

    The tokens are trigrams, or words, of which many are rare, so that their prefixes meet far less."""
    plain = items.where(F.col("category").isNotNull() & F.col("text").isNotNull()).select("id", "category", T.comparable_text(F.col("text")).alias("plain"))
    first = plain.where("plain <> ''").groupBy("category", "plain").agg(F.min("id").alias("id"))
    tokens = F.array_distinct(F.split("plain", " ")) if by_words else T.trigrams(F.col("plain"))
    return first.select("id", "category", "plain", tokens.alias("tokens"))


def restatements(items: DataFrame, threshold: float = RESTATED, by_words: bool = False) -> DataFrame:
    """Pairs of different statements of one category with alike trigrams or words: ``(id_a, id_b, similarity)``."""
    found = jaccard_pairs(statements(items, by_words), threshold, ("category",))
    return found.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("similarity", 6).alias("similarity"))


def _subjects(plain: Column) -> Column:
    return F.filter(F.array_distinct(F.split(plain, " ")), lambda w: (F.length(w) >= 4) & ~w.isin(*NO_SUBJECT))


def contradictions(items: DataFrame, restated: float = RESTATED, subject: float = SUBJECT) -> DataFrame:
    """Pairs of active, important items of comparable categories that may contradict each other:
    ``(id_a, id_b, similarity, reason)``.

    ``polarity``: one is negated, they share two subject words and half the restatement threshold; ``similar_statement``:
    they reach it; ``same_subject``: they share two subject words and lie between. Supersession takes a pair out.
    """
    chosen = items.where((F.col("status") == "active") & F.col("category").isin(*COMPARED) & T.at_least(F.col("importance"), "medium") & F.col("text").isNotNull())
    rows = chosen.select(
        "id", "category", "superseded_by", F.coalesce("supersedes", F.array().cast("array<string>")).alias("older"), F.col("text").rlike(NEGATED).alias("negated"),
        _subjects(T.comparable_text(F.col("text"))).alias("subjects"), T.trigrams(F.col("text")).alias("tokens"),
    )
    side = lambda x: rows.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "category", "superseded_by", "older", "negated", "subjects")])
    pairs = jaccard_pairs(rows, subject).join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    low, high = F.least("category_a", "category_b"), F.greatest("category_a", "category_b")
    named = [F.struct(F.lit(min(p)), F.lit(max(p))) for p in COMPARABLE]
    comparable = (low == high) | F.struct(low, high).isin(*named)
    linked = F.array_contains("older_a", F.col("id_b")) | F.array_contains("older_b", F.col("id_a")) | F.coalesce(F.col("superseded_by_a") == F.col("id_b"), F.lit(False)) | F.coalesce(F.col("superseded_by_b") == F.col("id_a"), F.lit(False))
    shared = F.size(F.array_intersect("subjects_a", "subjects_b")) >= 2
    s = F.col("similarity")
    reason = (
        F.when((F.col("negated_a") != F.col("negated_b")) & shared & (s >= restated / 2), "polarity").when(s >= restated, "similar_statement").when(shared, "same_subject")
    )
    return pairs.where(comparable & ~linked).select("id_a", "id_b", F.round(s, 6).alias("similarity"), reason.alias("reason")).where("reason IS NOT NULL")
