"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from semframe.relation import Relation


def union(relations: list[Relation], distinct: bool = False) -> Relation:
    """Rows of all relations, columns by position, names of the first; with
    ``distinct`` without repeated rows."""
    if not relations:
        raise ValueError("union of nothing")
    widths = {len(r.columns) for r in relations}
    if len(widths) > 1:
        raise ValueError(f"union of relations with {sorted(widths)} columns")
    first = relations[0]
    df = reduce(DataFrame.union, [r.df.toDF(*first.columns) for r in relations])
    return first.derive(df.distinct() if distinct else df, "union distinct" if distinct else "union", *relations[1:])
