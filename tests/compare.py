"""Comparing rows of Spark and DuckDB."""

import math


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    if isinstance(value, list | tuple):
        return str([plain(v) for v in value])
    return str(value)


def check(df, relation):
    columns = sorted(df.columns)
    names = list(relation.columns)
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    want = sorted(tuple(plain(row[i]) for i in order) for row in relation.fetchall())
    assert got == want
