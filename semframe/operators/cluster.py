"""Clustering of a vector column: ``id, v`` in, ``id, cluster`` out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semframe.functions.vector import normalized
from semframe.operators.cells import Forest, near_blocks
from semframe.operators.components import connected_components
from semframe.runtime import staged


class Clusterer:
    """Noise gets the cluster -1."""

    def fit(self, points: DataFrame) -> DataFrame:
        raise NotImplementedError


class KMeansClusterer(Clusterer):
    """k-means with a fixed seed; ``relative`` is a share of the rows."""

    def __init__(self, k: int | None = None, relative: float | None = None, max_iter: int = 20, seed: int = 7):
        if (k is None) == (relative is None):
            raise ValueError("give either k or relative")
        if relative is not None and not 0 < relative < 1:
            raise ValueError("relative lies between 0 and 1")
        self.k, self.relative, self.max_iter, self.seed = k, relative, max_iter, seed

    def fit(self, points):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = staged(points.select("id", "v"), "points")
        n = rows.count()
        if not n:
            return rows.select("id", F.lit(0).cast("long").alias("cluster"))
        k = max(1, min(n, self.k if self.k is not None else int(self.relative * n)))
        if k == 1:
            return rows.select("id", F.lit(0).cast("long").alias("cluster"))
        features = rows.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
        model = KMeans(k=k, maxIter=self.max_iter, seed=self.seed).fit(features)
        return model.transform(features).select("id", F.col("prediction").cast("long").alias("cluster"))


class DBSCANClusterer(Clusterer):
    """Density clusters: points with at least ``min_samples`` neighbours within
    ``eps`` (themselves included) and what they reach.  Exact; a border point
    joins the cluster with the smallest label among its core neighbours."""

    def __init__(self, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean"):
        if metric not in ("euclidean", "cosine"):
            raise ValueError(f"no metric {metric}")
        self.eps, self.min_samples, self.metric = eps, min_samples, metric

    def fit(self, points):
        """No pair of points is written: neighbours are counted, and links of
        core points come out as a forest, block by block."""
        vectors = points.select("id", (normalized(F.col("v")) if self.metric == "cosine" else F.col("v").cast("array<double>")).alias("v"))
        rows = staged(vectors, "points")
        # next numbers beyond the bound make the strict comparison inclusive
        bound, metric = (float(np.nextafter(1 - self.eps, -2)), "ip") if self.metric == "cosine" else (float(np.nextafter(self.eps**2, np.inf)), "l2")

        def counted(_, hit, qids, eids):
            return [qids, (hit & (qids[:, None] != eids[None, :])).sum(1)]

        many = near_blocks(rows, rows, bound, metric, counted, "id long, n long").groupBy("id").agg((F.sum("n") + 1).alias("n"))
        core = staged(rows.join(many, "id", "left").where(F.coalesce("n", F.lit(1)) >= self.min_samples).select("id", "v"), "core")
        forest = Forest()

        def linked(_, hit, qids, eids):
            return forest.links(hit & (qids[:, None] != eids[None, :]), qids, eids)

        labels = connected_components(near_blocks(core, core, bound, metric, linked, "l long, r long"), "l", "r")
        inside = staged(core.join(labels, core.id == labels.node, "left").select("id", F.coalesce("label", "id").alias("cluster"), "v"), "labels")

        def least(_, hit, qids, labels):
            some = np.flatnonzero(hit.any(1))
            return [qids[some], np.where(hit[some], labels[None, :], np.iinfo(np.int64).max).min(1)]

        outside = staged(rows.join(core, "id", "left_anti"), "border")
        border = near_blocks(outside, inside.select(F.col("cluster").alias("id"), "v"), bound, metric, least, "id long, cluster long").groupBy("id").agg(F.min("cluster").alias("cluster"))
        found = inside.select("id", "cluster").union(border)
        return rows.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


class CallableClusterer(Clusterer):
    """Any function from a matrix to labels, for at most ``max_rows`` rows: the
    matrix is put together in the driver, more rows are refused."""

    def __init__(self, function: Callable[[np.ndarray], np.ndarray], max_rows: int = 20_000):
        self.function, self.max_rows = function, max_rows

    def fit(self, points):
        rows = points.select("id", "v").limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise ValueError(f"more than {self.max_rows} rows for a clusterer that needs them in one place")
        spark = points.sparkSession
        if not rows:
            return spark.createDataFrame([], "id long, cluster long")
        rows.sort(key=lambda r: r.id)
        labels = np.asarray(self.function(np.array([r.v for r in rows], np.float64)))
        return spark.createDataFrame([(r.id, int(c)) for r, c in zip(rows, labels)], "id long, cluster long")


class HDBSCANClusterer(CallableClusterer):
    """Hierarchical density clusters: the minimum spanning tree of mutual
    reachability, condensed at ``min_cluster_size``, the most stable clusters
    chosen.  Needs all points in one place (``max_rows``)."""

    def __init__(self, min_cluster_size: int = 5, min_samples: int | None = None, metric: str = "euclidean", max_rows: int = 20_000):
        self.min_cluster_size, self.min_samples, self.metric = min_cluster_size, min_samples or min_cluster_size, metric
        super().__init__(self.labels, max_rows)

    def labels(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < self.min_cluster_size:
            return np.full(n, -1)
        if self.metric == "cosine":
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        distance_to = (lambda p: 1 - x @ x[p]) if self.metric == "cosine" else (lambda p: np.sqrt(((x - x[p]) ** 2).sum(1)))
        rank = min(self.min_samples, n) - 1
        core = np.array([np.partition(distance_to(p), rank)[rank] for p in range(n)])
        # Prim's tree over mutual reachability, one row of distances at a time
        best, source, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
        at, edges = 0, []
        for _ in range(n - 1):
            left[at] = False
            reach = np.maximum(np.maximum(distance_to(at), core), core[at])
            closer = left & (reach < best)
            best[closer], source[closer] = reach[closer], at
            at = int(np.where(left, best, np.inf).argmin())
            edges.append((best[at], int(source[at]), at))
        edges.sort()
        # single linkage: nodes n, n + 1, ... join two nodes at a distance
        top, children, size, height = list(range(2 * n - 1)), {}, [1] * n + [0] * (n - 1), [0.0] * (2 * n - 1)

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        for i, (d, a, b) in enumerate(edges):
            a, b, new = root(a), root(b), n + i
            top[a] = top[b] = new
            children[new], size[new], height[new] = (a, b), size[a] + size[b], d
        density = lambda d: 1 / max(d, 1e-12)

        def leaves(node: int) -> list[int]:
            out, todo = [], [node]
            while todo:
                k = todo.pop()
                todo.extend(children[k]) if k >= n else out.append(k)
            return out

        # condensed tree: (birth, members falling out, child clusters)
        clusters, todo = [], [(2 * n - 2, 0.0, -1)]
        while todo:
            node, birth, parent = todo.pop()
            own = len(clusters)
            clusters.append({"birth": birth, "stability": 0.0, "children": [], "node": node})
            if parent >= 0:
                clusters[parent]["children"].append(own)
            while node >= n:
                level = density(height[node])
                big = [c for c in children[node] if size[c] >= self.min_cluster_size]
                if len(big) == 2:
                    clusters[own]["stability"] += size[node] * (level - birth)
                    todo += [(c, level, own) for c in big]
                    break
                gone = size[node] - (size[big[0]] if big else 0)
                clusters[own]["stability"] += gone * (level - birth)
                if not big:
                    break
                node = big[0]
        chosen = [False] * len(clusters)
        for i in reversed(range(len(clusters))):
            below = sum(clusters[c]["stability"] for c in clusters[i]["children"])
            if clusters[i]["children"] and below > clusters[i]["stability"]:
                clusters[i]["stability"] = below
            elif i:
                chosen[i] = True
        labels, number, todo = np.full(n, -1), 0, [0]
        while todo:
            i = todo.pop(0)
            if chosen[i]:
                labels[leaves(clusters[i]["node"])] = number
                number += 1
            else:
                todo += clusters[i]["children"]
        return labels
