"""Names bound by meaning while a plan is built, in the driver."""

from __future__ import annotations

import numpy as np

from semframe.functions.models.roles import Embedding


def ranked(query: str, names: list[str], model: Embedding, threshold: float, metric: str = "ip") -> list[str]:
    """The names beyond the threshold, best first: inner product above it, or
    squared distance below it (``l2``).  Ties keep the order of the names."""
    if not names:
        return []
    q, m = np.asarray(model(query)), np.asarray(model(names))
    if metric == "ip":
        value = m @ q
        ok, order = value > threshold, np.argsort(-value, kind="stable")
    elif metric == "l2":
        value = ((m - q) ** 2).sum(1)
        ok, order = value < threshold, np.argsort(value, kind="stable")
    else:
        raise ValueError(f"no metric {metric}")
    return [names[i] for i in order if ok[i]]


def bind_columns(wanted: list[str], existing: list[str], model: Embedding | None, threshold: float = 0.1, metric: str = "ip") -> dict[str, str]:
    """Each wanted column to an existing one: itself, else the nearest name."""
    out = {}
    for name in wanted:
        if name in existing:
            out[name] = name
            continue
        if model is None:
            raise KeyError(f"no column {name} among {existing}")
        best = ranked(name, existing, model, threshold, metric)
        if not best:
            raise KeyError(f"no column means {name} among {existing}")
        out[name] = best[0]
    return out
