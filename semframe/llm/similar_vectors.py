"""Most similar vectors for every vector (problem 1)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semframe.llm.multi_index import VectorClasses, best_pairs, fit_index, search_blocks, vector_classes
from semframe.runtime import staged


def class_neighbours(classes: VectorClasses, dim: int, k: int, min_cosine: float = -1.0, wanted: int = 16384, queries: DataFrame | None = None, **fit) -> DataFrame:
    """``(q, e, cosine)``: up to ``k`` most similar distinct vectors of each
    distinct vector (or of ``queries``, a subset with ``vid, vec``)."""
    index = fit_index(classes.distinct, classes.rows, dim, wanted, **fit)

    def keep(cosines, qids, eids, mask):
        r, c = best_pairs(cosines, mask, k, min_cosine)
        return [qids[r], eids[c], cosines[r, c]]

    entries = classes.distinct.select("vid", "vec")
    found = search_blocks(entries, entries if queries is None else queries, index, keep, "q long, e long, cosine float")
    found = found.groupBy("q", "e").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "e")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def most_similar(df: DataFrame, keys: list[str], vector: str, k: int = 5, min_cosine: float = -1.0, dim: int = 64, wanted: int = 16384, **fit) -> DataFrame:
    """The ``k`` most similar other rows of every row, as pairs.

    Returns ``a_<key>.., b_<key>.., cosine``, smaller key first, for pairs of
    which at least one is among the other's ``k`` best and whose cosine is at
    least ``min_cosine``.  The method is an inverted multi-index (see
    ``multi_index``): approximate in that only ``wanted`` or more entries near
    the query are reranked, exact in every cosine it returns.  The default finds
    over nine tenths of the best of any similarity among 200,000 vectors; near
    neighbours alone (a high ``min_cosine``) need far fewer entries.

    Defined results: null, zero, not finite and wrongly sized vectors and rows
    with a null key give no pair; rows repeated under one key count once; of
    ties the smaller vector class wins; each of a class of identical vectors is
    paired with the ``k`` copies next to it in key order, so ``m`` copies give
    at most ``m * k`` pairs; an empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    classes = vector_classes(df, keys, vector, dim)
    ks = [f"k{i}" for i in range(len(keys))]
    found = staged(class_neighbours(classes, dim, k, min_cosine, wanted, **fit), "neighbours")

    # copies: each member with the k next to it, within bounded slices of a class
    sizes = classes.distinct.where("n > 1").select("vid", "n")
    shared = classes.shared.join(sizes, "vid").withColumn("slice", F.pmod(F.xxhash64(*ks), F.ceil(F.col("n") / 1000)))
    line = Window.partitionBy("vid", "slice").orderBy(*ks)
    placed = shared.withColumn("at", F.row_number().over(line))
    nexts = F.array(*[F.struct(*[F.lead(c, d).over(line).alias(f"b{i}") for i, c in enumerate(ks)]) for d in range(1, k + 1)])
    copies = placed.withColumn("nexts", nexts).select(*[F.col(c).alias(f"a{i}") for i, c in enumerate(ks)], F.explode("nexts").alias("b")).where("b.b0 is not null")
    copies = copies.select(*[f"a{i}" for i in range(len(ks))], *[f"b.b{i}" for i in range(len(ks))], F.lit(1.0).cast("double").alias("cosine"))

    # neighbours in other classes: their members in key order until k are found
    counts = classes.distinct.select("vid", "n")
    near = found.join(counts.select(F.col("vid").alias("q"), F.col("n").alias("own")), "q").join(counts.select(F.col("vid").alias("e"), F.col("n").alias("others")), "e")
    before = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("free", F.lit(k + 1) - F.col("own") - F.coalesce(F.sum("others").over(before), F.lit(0))).where("free > 0")
    first = Window.partitionBy("vid").orderBy("at", "slice", *ks)
    few = placed.where(F.col("at") <= k).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).select("vid", *ks, "place")
    few = classes.singles.withColumn("place", F.lit(1)).union(few)
    mine = few.select(F.col("vid").alias("q"), *[F.col(c).alias(f"a{i}") for i, c in enumerate(ks)])
    theirs = few.select(F.col("vid").alias("e"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(ks)], "place")
    cross = near.select("q", "e", "cosine", "free").join(mine, "q").join(theirs, "e").where("place <= free")
    cross = cross.select(*[f"a{i}" for i in range(len(ks))], *[f"b{i}" for i in range(len(ks))], F.col("cosine").cast("double").alias("cosine"))

    a, b = (F.struct(*[F.col(f"{s}{i}") for i in range(len(ks))]) for s in "ab")
    turned = cross.union(copies).select(F.when(a < b, a).otherwise(F.struct(*[F.col(f"b{i}").alias(f"a{i}") for i in range(len(ks))])).alias("a"), F.when(a < b, b).otherwise(F.struct(*[F.col(f"a{i}").alias(f"b{i}") for i in range(len(ks))])).alias("b"), "cosine")
    return turned.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).select(*[F.col(f"a.a{i}").alias(f"a_{n}") for i, n in enumerate(keys)], *[F.col(f"b.b{i}").alias(f"b_{n}") for i, n in enumerate(keys)], "cosine")


def nearest_of(df: DataFrame, keys: list[str], vector: str, every: int = 50, k: int = 5, dim: int = 64, wanted: int = 32768, **fit) -> DataFrame:
    """``<keys>.., rank, near_<keys>.., copies, cosine``: the ``k`` most similar
    vectors of the rows whose first key is divisible by ``every``, against all
    rows.

    A class of identical vectors is one neighbour, told by one of its keys and
    the number of its rows; a row's own copies are counted by the others of its
    class, which isn't its own neighbour.  Otherwise as ``most_similar``."""
    classes = vector_classes(df, keys, vector, dim)
    ks = [f"k{i}" for i in range(len(keys))]
    asked = staged(classes.members.where(F.col("k0") % every == 0), "asked")
    vectors = classes.distinct.join(asked.select("vid").distinct(), "vid", "left_semi").select("vid", "vec")
    found = class_neighbours(classes, dim, k, -1.0, wanted, staged(vectors, "asked"), **fit)
    heads = classes.distinct.select(F.col("vid").alias("e"), *[F.col(c).alias(f"near_{n}") for c, n in zip(ks, keys)], F.col("n").alias("copies"))
    told = found.join(heads, "e").join(asked.withColumnRenamed("vid", "q"), "q")
    return told.select(*[F.col(c).alias(n) for c, n in zip(ks, keys)], "rank", *[f"near_{n}" for n in keys], "copies", F.col("cosine").cast("double").alias("cosine"))


def recall_against_all(df: DataFrame, keys: list[str], vector: str, every: int = 50, k: int = 5, dim: int = 64, wanted: int = 16384, **fit) -> dict[str, float]:
    """Share of the true ``k`` best that the index finds, for the rows whose
    first key is divisible by ``every``, against all rows in blocks."""
    classes = vector_classes(df, keys, vector, dim)
    asked = staged(classes.distinct.where(F.col("k0") % every == 0).select("vid", "vec"), "asked")
    found = class_neighbours(classes, dim, k, -1.0, wanted, asked, **fit).groupBy("q").agg(F.collect_set("e").alias("got"))
    everything = fit_index(classes.distinct, classes.rows, dim, classes.rows + 1, **(fit | {"cell_rows": max(1, classes.rows)}))

    def keep(cosines, qids, eids, mask):
        r, c = best_pairs(cosines, mask, k, -1.0)
        return [qids[r], eids[c], cosines[r, c]]

    exact = search_blocks(classes.distinct.select("vid", "vec"), asked, everything, keep, "q long, e long, cosine float")
    exact = exact.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "e"))).where(F.col("r") <= k)
    both = exact.join(found, "q", "left").agg(F.avg(F.coalesce(F.array_contains("got", F.col("e")), F.lit(False)).cast("double")).alias("recall"), F.countDistinct("q").alias("queries"))
    return both.first().asDict()
