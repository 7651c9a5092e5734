"""Vector expressions that stay on the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def literal(values) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")))


def norm(u: Column) -> Column:
    return F.sqrt(_sum(F.transform(u, lambda a: a.cast("double") * a.cast("double"))))


def cosine(u: Column, v: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero, null where one is."""
    return bound(norm(u) * norm(v), lambda below: F.when(below == 0, F.lit(0.0)).otherwise(dot(u, v) / below))


def squared_l2(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(u, v, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))


def l2(u: Column, v: Column) -> Column:
    return F.sqrt(squared_l2(u, v))


def l1(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(u, v, lambda a, b: F.abs(a.cast("double") - b.cast("double"))))


def hamming(u: Column, v: Column) -> Column:
    """Places at which two vectors differ in being positive."""
    return _sum(F.zip_with(u, v, lambda a, b: ((a > 0) != (b > 0)).cast("double")))


def jaccard(u: Column, v: Column) -> Column:
    """Distance of the sets of positive places."""
    both = _sum(F.zip_with(u, v, lambda a, b: ((a > 0) & (b > 0)).cast("double")))
    either = _sum(F.zip_with(u, v, lambda a, b: ((a > 0) | (b > 0)).cast("double")))
    return F.when(either == 0, F.lit(0.0)).otherwise(1 - both / either)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used
    there; inside of lambdas Spark would evaluate it for each element."""
    return F.transform(F.array(value), body)[0]


def normalized(u: Column) -> Column:
    """At length 1; a zero vector stays as it is."""
    return bound(u, lambda x: bound(norm(x), lambda n: F.transform(x, lambda a: F.when(n == 0, a.cast("double")).otherwise(a.cast("double") / n))))


def mean_pool(vectors: list[Column]) -> Column:
    """Mean of those of the vectors that aren't null."""
    size = sum((v.isNotNull().cast("double") for v in vectors[1:]), vectors[0].isNotNull().cast("double"))
    sums = reduce(lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y)), [F.transform(v, lambda x: x.cast("double")) for v in vectors])
    return bound(size, lambda n: F.transform(sums, lambda x: x / n))


def concatenated(vectors: list[Column]) -> Column:
    return F.concat(*vectors)


DISTANCES = {"l2": l2, "ip": lambda u, v: -dot(u, v), "cosine": lambda u, v: 1 - cosine(u, v), "l1": l1, "hamming": hamming, "jaccard": jaccard}


def vector_topk(df: DataFrame, column: str, query, k: int = 10, metric: str = "l2", tie: str | None = None) -> DataFrame:
    """The ``k`` rows nearest to a query vector, with their ``distance``, by an
    exact scan that keeps ``k`` rows a task (``TakeOrderedAndProject``)."""
    out = df.withColumn("distance", DISTANCES[metric](F.col(column), literal(query)))
    return out.orderBy("distance", *([tie] if tie else [])).limit(k)


class Measure:
    """A similarity or distance with the direction of its threshold; thresholds
    are inclusive."""

    def __init__(self, expression, is_distance: bool):
        self.expression, self.is_distance = expression, is_distance

    def __call__(self, u: Column, v: Column, threshold: float | None = None) -> tuple[Column, Column]:
        value = self.expression(u, v)
        if threshold is None:
            return value, F.lit(True)
        return value, F.coalesce(value <= threshold if self.is_distance else value >= threshold, F.lit(False))


COSINE, EUCLIDEAN = Measure(cosine, False), Measure(l2, True)
