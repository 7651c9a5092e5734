"""Clusters of mutually similar records by density peaks (problem 3)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semframe.llm.multi_index import best_pairs, fit_index, search_blocks, vector_classes
from semframe.operators.cells import Forest
from semframe.operators.components import connected_components
from semframe.runtime import staged


def follow(pointers: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(vid, label)``: the end of each chain of pointers ``(vid, up)``; peaks
    point at themselves.  Doubles the reach each round."""
    now = pointers.select("vid", F.col("up").alias("label"))
    for _ in range(max_rounds):
        ends = now.select(F.col("vid").alias("label"), F.col("label").alias("further"))
        moved = staged(now.join(ends, "label").select("vid", F.col("further").alias("label"), (F.col("label") != F.col("further")).alias("moved")), "pointers")
        now = moved.select("vid", "label")
        if not moved.where("moved").limit(1).count():
            return now
    raise RuntimeError("pointers did not settle")


class Links:
    """What a block tells of one slice of queries after the other: the number
    of entries within the radius, the nearest of them, and a forest of which
    entries and queries are linked, directly or through others of the block."""

    def __init__(self, least: float, near: int):
        self.least, self.near, self.forest = np.float32(least), near, Forest()

    def __call__(self, cosines, qids, eids, mask):
        hit = (cosines >= self.least) & mask
        within = hit.sum(1)
        some = np.flatnonzero(within)
        r, c = best_pairs(cosines[some], mask[some], self.near, float(self.least))
        a, b = self.forest.links(hit, qids, eids)
        kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(some), len(r), len(a)])
        values = np.concatenate([within[some].astype(np.float64), cosines[some[r], c].astype(np.float64), np.ones(len(a))])
        return [kinds, np.concatenate([qids[some], qids[some[r]], a]), np.concatenate([qids[some], eids[c], b]), values]


def density_clusters(df: DataFrame, keys: list[str], vector: str, min_cosine: float = 0.8, min_size: int = 5, dim: int = 64, wanted: int = 1024, near: int = 8, **fit) -> DataFrame:
    """``<keys>.., first_<keys>.., size, density, distance, peak`` of each
    clustered row.

    Density peaks through one blocked neighbour join over the cells of a
    multi-index.  The local density of a vector is the number of vectors within
    ``min_cosine`` of it in the blocks it visits; it points at its most similar
    denser neighbour (ties in density: the smaller id), ``distance`` being one
    less their cosine.  A vector whose nearest denser neighbour is farther than
    the radius is a peak and has no distance.  Pointers are followed to the
    peaks, which are the labels of basins.  A cluster is a maximal set of
    vectors linked at ``min_cosine``, so basins with a link between them are
    one: the same join emits the links of a block as a forest.  A cluster is
    kept if it has ``min_size`` rows.

    ``first_..`` is the smallest key of the cluster, ``peak`` marks the rows of
    its densest vector.  Defined results: unusable vectors and null keys are in
    no cluster; rows repeated under a key count once; identical vectors count
    as one in densities and as rows in sizes; an empty table gives an empty
    result; other columns are ignored.
    """
    classes = vector_classes(df, keys, vector, dim)
    ks = [f"k{i}" for i in range(len(keys))]
    index = fit_index(classes.distinct, classes.rows, dim, wanted, **fit)
    entries = classes.distinct.select("vid", "vec")
    found = staged(search_blocks(entries, entries, index, Links(min_cosine, near), "kind byte, q long, e long, value double"), "around")
    density = found.where("kind = 0").groupBy("q").agg(F.sum("value").cast("long").alias("density"))
    links = found.where("kind = 1").groupBy("q", "e").agg(F.max("value").alias("cosine"))
    ties = found.where("kind = 2 and q <> e").select("q", "e").distinct()
    other = density.select(F.col("q").alias("e"), F.col("density").alias("theirs"))
    denser = links.join(density, "q").join(other, "e", "left").withColumn("theirs", F.coalesce("theirs", F.lit(0)))
    up = denser.where("theirs > density or theirs = density and e < q").groupBy("q").agg(F.max(F.struct("cosine", -F.col("e"))).alias("best"))
    up = up.select(F.col("q").alias("vid"), (-F.col("best.col2")).alias("up"), (1 - F.col("best.cosine")).alias("distance"))
    every = density.select(F.col("q").alias("vid"), "density").union(found.where("kind > 0").select("e", F.lit(0))).groupBy("vid").agg(F.max("density").alias("density"))
    every = staged(every.join(up, "vid", "left").select("vid", "density", "distance", F.coalesce("up", "vid").alias("up")), "density")
    labels = staged(follow(every), "basins")
    across = ties.join(labels.select(F.col("vid").alias("q"), F.col("label").alias("a")), "q").join(labels.select(F.col("vid").alias("e"), F.col("label").alias("b")), "e").where("a <> b")
    merged = connected_components(across.select("a", "b").distinct())
    final = labels.join(merged.withColumnRenamed("label", "whole"), labels.label == merged.node, "left").select("vid", F.coalesce("whole", "label").alias("cluster"))
    final = final.join(every.select("vid", "density", "distance"), "vid").join(classes.distinct.select("vid", "n"), "vid").select("vid", "n", "cluster", "density", "distance")
    # copies of a vector outside every link are a cluster of their own
    copies = classes.distinct.where("n > 1").select("vid", "n").join(final.select("vid"), "vid", "left_anti").select("vid", "n", F.col("vid").alias("cluster"), F.lit(0).alias("density"), F.lit(None).cast("double").alias("distance"))
    final = final.union(copies)
    sizes = final.groupBy("cluster").agg(F.sum("n").alias("size"), F.max(F.struct("density", -F.col("vid"))).alias("top")).where(F.col("size") >= min_size)
    placed = staged(final.join(sizes, "cluster").select("vid", "cluster", "size", "density", "distance", (F.col("vid") == -F.col("top.col2")).alias("peak")), "clusters")
    rows = classes.members.join(placed, "vid")
    firsts = rows.groupBy("cluster").agg(F.min(F.struct(*ks)).alias("first"))
    rows = rows.join(firsts, "cluster")
    return rows.select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], *[F.col(f"first.{k}").alias(f"first_{n}") for k, n in zip(ks, keys)], "size", "density", "distance", "peak")


def describe_clusters(members: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """One row a cluster: its first key, size and the ``top`` most typical
    rows (largest density, ties by key).  ``top`` is the feature, every cluster
    is reported."""
    firsts = [f"first_{k}" for k in keys]
    best = Window.partitionBy(*firsts).orderBy(F.desc("density"), *keys)
    typical = members.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    return typical.groupBy(*firsts).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", *keys))).alias("typical"))
