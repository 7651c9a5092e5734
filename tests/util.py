"""Bags of rows."""

from collections import Counter


def frozen(v):
    if isinstance(v, dict):
        return tuple(sorted((k, frozen(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(frozen(x) for x in v)
    return v


def bag(rows):
    return Counter(tuple(sorted((k, frozen(v)) for k, v in (r if isinstance(r, dict) else r.asDict(recursive=True)).items())) for r in rows)


def same(a, b):
    return bag(a) == bag(b)
