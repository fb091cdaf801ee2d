"""Exact set similarity and contradictions against brute force."""

import random
import re

import pytest

from eventloom.operators import similarity

WORDS = "cache index server retry token budget queue merge branch deploy always never not must strict mode linter tests".split()


@pytest.mark.parametrize("threshold", [0.2, 0.6, 1.0])
def test_pairs_of_random_sets(spark, threshold):
    rng = random.Random(1)
    rows = [(f"r{i}", rng.choice(["a", "b"]), [rng.choice(WORDS) for _ in range(rng.randrange(0, 9))]) for i in range(90)] + [("n", None, ["cache"]), (None, "a", ["cache"]), ("e", "a", None)]
    got = {(r.a, r.b): round(r.similarity, 9) for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "id string, k string, tokens array<string>"), threshold, ("k",)).collect()}
    want, good = {}, [(i, k, set(t)) for i, k, t in rows if i and k and t]
    for i, k, s in good:
        for j, m, t in good:
            if i < j and k == m and len(s & t) / len(s | t) >= threshold - 1e-9:
                want[i, j] = round(len(s & t) / len(s | t), 9)
    assert got == want


ITEM = "id string, category string, text string, status string, importance string, superseded_by string, supersedes array<string>"


def _plain(text):
    return re.sub(r"[\W_]+", " ", re.sub(r"\[[^\]]*\]", " ", text.lower())).strip()


def _grams(text):
    s = f" {_plain(text)} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def test_contradictions_of_random_items(spark):
    rng = random.Random(2)
    rows = [
        (f"m{i:02}", rng.choice([*similarity.COMPARED, "discoveries"]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(2, 8))), rng.choice(["active", "active", "stale"]),
         rng.choice(["low", "medium", "critical"]), rng.choice([None, "m03"]), rng.choice([None, [], ["m05"]])) for i in range(70)
    ] + [("n1", None, "cache index", "active", "high", None, None), ("n2", "goals", None, "active", "high", None, None)]
    got = {(r.id_a, r.id_b): r.reason for r in similarity.contradictions(spark.createDataFrame(rows, ITEM)).collect()}
    good = [r for r in rows if r[3] == "active" and r[1] in similarity.COMPARED and r[4] != "low" and r[2]]
    subject = lambda t: {w for w in _plain(t).split(" ") if len(w) >= 4 and w not in similarity.NO_SUBJECT}
    want = {}
    for a in good:
        for b in good:
            if a[0] < b[0] and (a[1] == b[1] or (a[1], b[1]) in similarity.COMPARABLE or (b[1], a[1]) in similarity.COMPARABLE):
                if b[0] in (a[6] or []) or a[0] in (b[6] or []) or a[5] == b[0] or b[5] == a[0]:
                    continue
                g, h = _grams(a[2]), _grams(b[2])
                s, shared = len(g & h) / len(g | h), len(subject(a[2]) & subject(b[2])) >= 2
                turned = bool(re.search(r"\b(not|never)\b", a[2])) != bool(re.search(r"\b(not|never)\b", b[2]))
                reason = "polarity" if turned and shared and s >= 0.21 else "similar_statement" if s >= 0.42 else "same_subject" if shared and s >= 0.2 else None
                if reason:
                    want[a[0], b[0]] = reason
    assert got == want and len(set(want.values())) == 3
