"""Grouping by equal keys and by clusters of keys that mean the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.models.roles import Embedding, Generator, with_embeddings
from semframe.functions.serialize import Serializer, quoted, sorted_braced
from semframe.functions.vector import concatenated
from semframe.operators.cluster import Clusterer
from semframe.relation import Relation
from semframe.runtime import staged


@dataclass
class Aggregation:
    """An aggregate of one column under a new name."""

    source: str
    output: str

    def column(self) -> Column:
        raise NotImplementedError

    def __str__(self):
        return f"{type(self).__name__.lower()}({self.source}) as {self.output}"


class Sum(Aggregation):
    """Sum, without nulls."""

    def column(self):
        return F.sum(quoted(self.source))


class Max(Aggregation):
    def column(self):
        return F.max(quoted(self.source))


class Min(Aggregation):
    def column(self):
        return F.min(quoted(self.source))


class Avg(Aggregation):
    """Mean as a double, without nulls."""

    def column(self):
        return F.avg(quoted(self.source))


@dataclass
class Count(Aggregation):
    """Rows; with ``skip_nulls`` those whose value isn't null."""

    skip_nulls: bool = False

    def column(self):
        return F.count(quoted(self.source) if self.skip_nulls else F.lit(1))

    __str__ = Aggregation.__str__


class CountDistinct(Aggregation):
    """Distinct values that aren't null."""

    def column(self):
        return F.count_distinct(quoted(self.source))


@dataclass
class StringAgg(Aggregation):
    """Values that aren't null as text in ascending order, joined."""

    delimiter: str = ", "

    def column(self):
        return F.array_join(F.transform(F.array_sort(F.collect_list(quoted(self.source))), lambda x: x.cast("string")), self.delimiter)

    __str__ = Aggregation.__str__


class SetAgg(Aggregation):
    """Distinct values in ascending order, a null among them last."""

    def column(self):
        return set_of(self.source)


def set_of(name: str) -> Column:
    kept = F.array_sort(F.collect_set(quoted(name)))
    absent = F.max(quoted(name).isNull())
    return F.when(absent, F.array_append(kept, F.lit(None))).otherwise(kept)


@dataclass
class CustomAgg(Aggregation):
    """An aggregate of one's own: ``native`` makes an aggregate expression of
    the column, which combines before the shuffle; ``fold`` (from ``start``, or
    from the first value) is run by parts of a group, whose results are put
    together by ``merge``; ``function`` needs all values of a group in one list,
    so it suits groups that fit a worker only."""

    output_type: str = "double"
    function: Callable[[list], object] | None = field(default=None, compare=False)
    fold: Callable[[object, object], object] | None = field(default=None, compare=False)
    start: object = None
    merge: Callable[[object, object], object] | None = field(default=None, compare=False)
    native: Callable[[Column], Column] | None = field(default=None, compare=False)

    def __post_init__(self):
        if sum(x is not None for x in (self.function, self.fold, self.native)) != 1:
            raise ValueError("give either a function, a fold or a native expression")
        if self.merge is not None and self.fold is None:
            raise ValueError("merge goes with a fold")

    def column(self):
        if self.native is not None:
            return self.native(quoted(self.source))
        return self._over(self.source, self.function, self.fold, self.start)

    def _over(self, source, function, fold, start):
        from functools import reduce

        def run(values: pd.Series):
            told = values.tolist()
            if function is not None:
                return function(told)
            return reduce(fold, told) if start is None else reduce(fold, told, start)

        run.__annotations__ = {"values": pd.Series, "return": float}
        return F.pandas_udf(run, self.output_type)(quoted(source))

    def parts(self) -> tuple[Column, Column]:
        """The aggregate of a part of a group and that of the parts."""
        return self._over(self.source, None, self.fold, self.start).alias(self.output), self._over(self.output, None, self.merge, None).alias(self.output)

    __str__ = Aggregation.__str__


def _in_parts(relation: Relation, keys: list[str], aggregations: list[Aggregation], rows: int = 10_000) -> DataFrame | None:
    """Groups in salted parts of about ``rows`` values, if all aggregates are
    folds with a merge."""
    if not keys or not all(isinstance(a, CustomAgg) and a.merge is not None for a in aggregations):
        return None
    told = [a.parts() for a in aggregations]
    cells = [quoted(k) for k in keys]
    sizes = relation.df.groupBy(*[c.alias(f"__k{i}") for i, c in enumerate(cells)]).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("__n"))
    same = [c.eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(cells)]
    placed = relation.df.join(sizes, same).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.col("__n")))
    parts = placed.groupBy(*cells, "__part").agg(*[a for a, _ in told])
    return parts.groupBy(*cells).agg(*[b for _, b in told])


def hash_aggregate(relation: Relation, keys: list[str], aggregations: list[Aggregation]) -> Relation:
    """Group by equal keys; null keys form a group.

    Output: keys in the order of the input's columns, then the aggregates.
    Without keys there is one group, and none for empty input.  Built-in
    aggregates combine before the shuffle."""
    for c in [*keys, *[a.source for a in aggregations]]:
        if c not in relation.columns:
            raise KeyError(f"no column {c} among {relation.columns}")
    ordered = [c for c in relation.columns if c in keys]
    cells = [a.column().alias(a.output) for a in aggregations]
    text = f"aggregate [{', '.join(ordered)}; {', '.join(map(str, aggregations))}]"
    if (parts := _in_parts(relation, ordered, aggregations)) is not None:
        return relation.derive(parts, text)
    if ordered:
        return relation.derive(relation.df.groupBy(*[quoted(k) for k in ordered]).agg(*cells), text)
    if any(isinstance(a, CustomAgg) for a in aggregations):
        one = relation.df.withColumn("__one", F.lit(1)).groupBy("__one").agg(*cells).drop("__one")
    else:
        one = relation.df.agg(*cells, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")
    return relation.derive(one, text)


def soft_aggregate(relation: Relation, keys: list[str], aggregations: list[Aggregation], model: Embedding, clusterer: Clusterer, form: str = "FULL_SERIALIZED", serializer: Serializer = sorted_braced, reduce_dimensions: int | None = None, summary: Generator | None = None, summary_prompt: str = "Find one short name for all of these: ") -> Relation:
    """Group by clusters of the embedded keys.

    The key columns of a record are one text (FULL_SERIALIZED) or one text each
    whose vectors are put one after the other (FIELD_SERIALIZED).  A key column
    of the result is the sorted set of its values in the cluster (a null last),
    or all keys become one column ``key`` that ``summary`` writes.  Noise
    points are groups of their own.  ``reduce_dimensions`` projects the vectors
    on that many principal components first.

    Distinct texts are embedded once.  Clustering runs over distinct vectors
    only where the clusterer is told so by its own parameters; empty input
    gives an empty result."""
    if form not in ("FULL_SERIALIZED", "FIELD_SERIALIZED"):
        raise ValueError(f"no form {form}")
    for c in [*keys, *[a.source for a in aggregations]]:
        if c not in relation.columns:
            raise KeyError(f"no column {c} among {relation.columns}")
    ordered = [c for c in relation.columns if c in keys]
    rows = staged(relation.df.withColumn("__id", F.monotonically_increasing_id()), "soft")
    if form == "FULL_SERIALIZED":
        points = with_embeddings(rows.select(F.col("__id").alias("id"), serializer(ordered).alias("__t")), "__t", "v", model)
    else:
        points = rows.select(F.col("__id").alias("id"), *[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(f"__t{i}") for i, c in enumerate(ordered)])
        for i in range(len(ordered)):
            points = with_embeddings(points, f"__t{i}", f"__v{i}", model)
        points = points.withColumn("v", concatenated([F.col(f"__v{i}") for i in range(len(ordered))]))
    points = staged(points.select("id", F.col("v").cast("array<double>").alias("v")), "points")
    if reduce_dimensions:
        points = principal(points, reduce_dimensions)
    labels = clusterer.fit(points)
    labels = labels.select(F.col("id").alias("__id"), F.when(F.col("cluster") < 0, -1 - F.col("id")).otherwise(F.col("cluster")).alias("__cluster"))
    cells = [a.column().alias(a.output) for a in aggregations]
    grouped = rows.join(labels, "__id").groupBy("__cluster")
    sets = [set_of(k).alias(k) for k in ordered]
    df = grouped.agg(*sets, *cells).drop("__cluster")
    if summary is not None:
        listed = F.concat_ws("; ", *[F.array_join(F.transform(quoted(k), lambda x: x.cast("string")), ", ") for k in ordered])
        df = df.select(summary.to_column(F.concat(F.lit(summary_prompt), listed)).alias("key"), *[quoted(a.output) for a in aggregations])
    return relation.derive(df, f"soft aggregate [{', '.join(ordered)}; {', '.join(map(str, aggregations))}]")


def principal(points, dimensions: int):
    """Vectors on their first principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if not points.limit(1).count():
        return points
    told = points.select("id", array_to_vector("v").alias("f"))
    return staged(PCA(k=dimensions, inputCol="f", outputCol="p").fit(told).transform(told).select("id", vector_to_array("p").alias("v")), "principal")
