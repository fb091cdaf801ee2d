"""Mistyped paths against brute force, and many paths in one folder."""

import random
import re

from eventloom.functions import commands as C
from eventloom.operators import calls


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _parts(path):
    folder, _, base = path.rpartition("/")
    m = re.fullmatch(r"(.+)\.([^.]*)", base)
    return folder, base, *(m.groups() if m else (base, ""))


def _meant(path, file):
    (f, b, s, e), (g, c, t, d) = _parts(path), _parts(file)
    if not b or not c:
        return False
    if b == c:
        return f != g and s.lower() not in C.COMMON_NAMES
    near = e == d and min(len(s), len(t)) >= 3 and _edits(s, t) <= max(1, max(len(s), len(t)) // 4)
    return f == g and (e != d if s == t else near)


def _found(spark, paths, files):
    frame = lambda rows: spark.createDataFrame([(p,) for p in rows], "path string")
    return sorted((r.path, r.meant) for r in calls.mistyped_paths(frame(paths), frame(files)).collect())


def test_mistyped_paths_of_random_names(spark, monkeypatch):
    monkeypatch.setattr(calls, "BLOCK", 40)
    rng = random.Random(3)
    name = lambda: "".join(rng.choice(["ab", "a", "bo", "ka", "é", "ze", "_", "."]) for _ in range(rng.randrange(1, 9)))
    some = lambda n: [f"{rng.choice(['src', 'src', 'docs/x', ''])}/{name()}{rng.choice(['', '.py', '.py', '.md'])}" for _ in range(n)]
    odd = ["src/Makefile", "src/.env", "src/index.ts", "README.md", "src/", "", "src/" + "long" * 70 + ".py"]
    files = [*some(300), *odd, None]
    paths = [*some(300), "src/Makefil", "src/.env.local", "docs/index.ts", "x/README.md", "src/" + "long" * 69 + ".py", *files[:20], None]
    real = {x for x in files if x is not None}
    want = sorted((p, f) for p in {x for x in paths if x is not None} - real for f in real if _meant(p, f))
    assert ("src/Makefil", "src/Makefile") in want and ("src/.env.local", "src/.env") in want
    assert _found(spark, paths, files) == want


def test_a_folder_of_many_files(spark):
    """Compared one by one, these 36 million pairs take many minutes."""
    rng = random.Random(4)
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "s")]
    names = sorted({"".join(rng.choice(syllables) for _ in range(4)) + "_" + "".join(rng.choice("0123456789") for _ in range(6)) for _ in range(6000)})
    found = set(_found(spark, [f"src/{n[:-1]}.py" for n in names], [f"src/{n}.py" for n in names]))
    assert {(f"src/{n[:-1]}.py", f"src/{n}.py") for n in names} <= found
