"""Inverted multi-index over unit vectors.

The two halves of every vector are quantised separately, so ``K`` centroids a
half make ``K * K`` cells while a vector is compared with ``2 * K`` half
centroids only.  A search walks the centroid pairs in the order of their summed
distance with a heap until the visited cells hold enough entries, and reranks
the entries of the visited storage blocks by their exact cosine.

What is held outside the executors is bounded by parameters: the sample the
centroids are fitted on (``sample`` rows), the centroids and one counter a cell
(at most ``max_half ** 2``, four bytes each).  Every row is indexed and every row counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semframe.runtime import shuffle_partitions, staged


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of ``dim`` float32 each, as one matrix."""
    if not len(column):
        return np.zeros((0, dim), np.float32)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw.tobytes(), np.float32).reshape(len(column), dim)


def as_binary(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix, np.float32)
    n, width = len(matrix), matrix.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(matrix.tobytes())])


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``(usable, unit)``: usable marks rows that are neither null nor zero nor
    not finite and have ``dim`` numbers; unit holds those rows at length 1."""
    usable = np.zeros(len(column), bool)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    right = np.nan_to_num(lengths, nan=-1) == dim
    if not right.any():
        return usable, np.zeros((0, dim), np.float32)
    flat = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((matrix * matrix).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        usable[np.flatnonzero(right)[good]] = True
        return usable, (matrix[good] / norm[good, None]).astype(np.float32)


def usable_vectors(df: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """One row a key with its unit vector as bytes.

    Null, zero and not finite vectors, vectors of another length and rows with
    a null key are left out.  Rows repeated under one key count once (the
    smallest vector by bytes, so the choice doesn't depend on order).
    """
    source = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{vector}`").cast("array<float>").alias("v"))
    source = source.where(" and ".join([f"k{i} is not null" for i in range(len(keys))] + [f"size(v) = {dim}"]))
    fields = [source.schema[f"k{i}"] for i in range(len(keys))]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, unit = unit_rows(batch.column("v"), dim)
            mask = pa.array(usable)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(len(keys))] + [as_binary(unit)], names=[f.name for f in fields] + ["vec"])

    unit = source.mapInArrow(clean, T.StructType([*fields, T.StructField("vec", T.BinaryType())]))
    return unit.groupBy(*[f.name for f in fields]).agg(F.min("vec").alias("vec"))


@dataclass
class VectorClasses:
    """Distinct vectors (``vid, vec, n``) and the keys that share each."""

    distinct: DataFrame
    shared: DataFrame  # vid, k0.., of classes with more than one member
    rows: int
    nkeys: int

    @property
    def singles(self) -> DataFrame:
        return self.distinct.where("n = 1").select("vid", *[f"k{i}" for i in range(self.nkeys)])

    @property
    def members(self) -> DataFrame:
        return self.singles.union(self.shared)


def vector_classes(df: DataFrame, keys: list[str], vector: str, dim: int) -> VectorClasses:
    """Copies collapse into one class first, so a vector that a third of all
    rows carry is searched once and its rows never meet in one task."""
    items = staged(usable_vectors(df, keys, vector, dim), "vectors")
    ks = [f"k{i}" for i in range(len(keys))]
    distinct = staged(items.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ks)).alias("low")).select("vec", "n", "low.*").withColumn("vid", F.monotonically_increasing_id()), "classes")
    shared = staged(items.join(distinct.where("n > 1").select("vec", "vid"), "vec").select("vid", *ks), "copies")
    return VectorClasses(distinct, shared, distinct.count(), len(keys))


def half_centroids(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from ``k`` random points, so that dense regions get
    centroids in proportion to their rows.  Ordered along the main axis."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        nearest = (-2 * points @ centroids.T + (centroids**2).sum(1)).argmin(1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids).astype(np.float32)
    centred = centroids - centroids.mean(0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0] if k > 1 else np.ones(points.shape[1], np.float32)
    return centroids[np.argsort(centred @ axis, kind="stable")]


def half_distances(matrix: np.ndarray, halves: list[np.ndarray]) -> list[np.ndarray]:
    cut = halves[0].shape[1]
    return [(part**2).sum(1)[:, None] - 2 * part @ c.T + (c**2).sum(1) for part, c in zip((matrix[:, :cut], matrix[:, cut:]), halves)]


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int, min_cells: int = 1, nearest: int = 64) -> Iterator[list[tuple[int, int]]]:
    """For each row of the distances: the centroid pairs in the order of their
    summed distance, until the visited cells hold ``wanted`` entries and at
    least ``min_cells`` of them hold any; a dense cell alone doesn't end it.

    Only the ``nearest`` centroids of either half are sorted; a walk that comes
    to their end is made again with all of them."""

    def ordered(distances: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        if most < distances.shape[1]:
            some = np.argpartition(distances, most - 1, axis=1)[:, :most]
            some.sort(axis=1)  # of equal distances the first centroid
            own = np.take_along_axis(distances, some, 1)
            order = np.argsort(own, axis=1, kind="stable")
            return np.take_along_axis(some, order, 1), np.take_along_axis(own, order, 1)
        order = np.argsort(distances, axis=1, kind="stable")
        return order, np.take_along_axis(distances, order, 1)

    height, width = sizes.shape
    tops = [ordered(d, min(nearest, d.shape[1])) for d in (first, second)]
    near = nearest < max(height, width)
    for row, (o1, o2, d1, d2) in enumerate(zip(*(x.tolist() for x in (tops[0][0], tops[1][0], tops[0][1], tops[1][1])))):
        visited = _walked(o1, o2, d1, d2, sizes, wanted, min_cells, near and (len(o1) < height, len(o2) < width))
        if visited is None:
            (o1, d1), (o2, d2) = (tuple(x[0].tolist() for x in ordered(d[row : row + 1], d.shape[1])) for d in (first, second))
            visited = _walked(o1, o2, d1, d2, sizes, wanted, min_cells, False)
        yield visited


def _walked(o1: list[int], o2: list[int], d1: list[float], d2: list[float], sizes: np.ndarray, wanted: int, min_cells: int, more: tuple[bool, bool] | bool) -> list[tuple[int, int]] | None:
    """The visited pairs, or None where a centroid beyond the lists is needed."""
    heap, got, visited = [(d1[0] + d2[0], 0, 0)], 0, []
    while heap and (got < wanted or len(visited) < min_cells):
        _, a, b = heapq.heappop(heap)
        n = int(sizes[o1[a], o2[b]])
        if n:
            got += n
            visited.append((o1[a], o2[b]))
        if b + 1 < len(o2):
            heapq.heappush(heap, (d1[a] + d2[b + 1], a, b + 1))
        elif more and more[1]:
            return None
        if b == 0 and a + 1 < len(o1):
            heapq.heappush(heap, (d1[a + 1] + d2[0], a + 1, 0))
        elif b == 0 and more and more[0]:
            return None
    return visited


@dataclass
class MultiIndex:
    """Centroids of both halves and the layout of the cells in storage blocks."""

    halves: list[np.ndarray]
    sizes: np.ndarray  # entries a cell
    first_block: np.ndarray  # first block of a cell
    spread: np.ndarray  # blocks a cell is spread over (over 1: a hot cell)
    salts: np.ndarray  # copies of a block's entries, among which its probes are split
    dim: int
    wanted: int
    min_cells: int

    @property
    def blocks(self) -> int:
        return len(self.salts)


def fit_index(distinct: DataFrame, rows: int, dim: int, wanted: int, cell_rows: int = 64, block_rows: int = 2048, sample: int = 16384, max_half: int = 4096, rounds: int = 8, probes_a_task: int = 50_000, min_cells: int = 8, seed: int = 7) -> MultiIndex:
    """Fit on at most ``sample`` rows (or eight a centroid, if that is more),
    then count the entries of every cell.  The number of centroids follows the
    rows up to ``max_half`` a half, which is a billion distinct vectors; beyond
    that cells grow.

    Cells are packed into blocks of about ``block_rows`` entries along the
    centroid order; a hot cell is spread over several blocks, each of which is
    searched.  Blocks that many queries will visit (estimated from the sample)
    are copied and their probes salted.
    """
    k = max(1, min(max_half, round((rows / cell_rows) ** 0.5)))
    sample = max(sample, 8 * k)
    share = min(1.0, 1.2 * sample / max(rows, 1))
    picked = distinct.select("vec", F.xxhash64("vec").alias("h"))
    if share < 1:
        picked = picked.where(F.abs(F.col("h")) < int(share * (2**63 - 1)))
    taken = [bytes(r.vec) for r in picked.orderBy("h").limit(sample).collect()]
    points = np.frombuffer(b"".join(taken), np.float32).reshape(-1, dim)
    k = max(1, min(k, len(points)))
    cut = dim // 2
    halves = [half_centroids(p, k, rounds, seed) for p in (points[:, :cut], points[:, cut:])] if len(points) else [np.zeros((1, cut), np.float32), np.zeros((1, dim - cut), np.float32)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k * k, np.int64)
        for batch in batches:
            first, second = half_distances(as_matrix(batch.column(0), dim), halves)
            counts += np.bincount(first.argmin(1) * k + second.argmin(1), minlength=k * k)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    sizes = np.zeros(k * k, np.int64)
    for r in distinct.select("vec").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[r.cell] = r.n
    first_block, spread, block, filled = np.zeros(k * k, np.int32), np.ones(k * k, np.int32), 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if cell % k == 0 or filled + n > block_rows:
            block, filled = block + (filled > 0), 0
        first_block[cell] = block
        if n > block_rows:
            spread[cell] = -(-n // block_rows)
            block, filled = block + int(spread[cell]), 0
        else:
            filled += n
    index = MultiIndex(halves, np.minimum(sizes, 2**31 - 1).astype(np.int32).reshape(k, k), first_block.reshape(k, k), spread.reshape(k, k), np.ones(block + 1, np.int64), dim, wanted, min_cells)
    visits = np.zeros(block + 1)
    tried = points[:: max(1, len(points) // 2048)]
    for blocks in _visited(index, tried) if len(tried) else ():
        visits[blocks] += rows / len(tried)
    index.salts = np.maximum(1, np.ceil(visits / probes_a_task)).astype(np.int64)
    return index


def _visited(index: MultiIndex, matrix: np.ndarray) -> Iterator[list[int]]:
    first, second = half_distances(matrix, index.halves)
    blocks, spread = index.first_block, index.spread
    for cells in walk(first, second, index.sizes, index.wanted, index.min_cells):
        seen: set[int] = set()
        for i, j in cells:
            at = int(blocks[i, j])
            seen.update(range(at, at + int(spread[i, j])))
        yield sorted(seen)


Reducer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def search_blocks(entries: DataFrame, queries: DataFrame, index: MultiIndex, reducer: Reducer, schema: str) -> DataFrame:
    """Send each query to the blocks its walk visits and reduce each block.

    ``entries`` and ``queries`` have ``vid, vec``.  ``reducer(C, query ids,
    entry ids, pair mask)`` gets the cosines of a slice of queries against one
    block and returns the output columns; all slices of a block come one after
    the other with one and the same array of entry ids.  Entries of a block are
    bounded, queries stream through in Arrow batches.
    """
    dim, salts, shared = index.dim, index.salts, entries is queries
    fields = "slot int, kind byte, vid long, vec binary"
    offsets = np.concatenate([[0], np.cumsum(salts)[:-1]])

    def route(as_entry: bool, as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(index.halves[0])
            for big in batches:
                for at in range(0, big.num_rows, 2000):
                    batch = big.slice(at, 2000)
                    vid = batch.column(0).to_numpy(zero_copy_only=False)
                    matrix = as_matrix(batch.column(1), dim)
                    rows, slots, kinds = [], [], []
                    if as_entry:
                        first, second = half_distances(matrix, index.halves)
                        cell = first.argmin(1) * k + second.argmin(1)
                        block = index.first_block.ravel()[cell] + (vid * 2654435761 >> 16) % index.spread.ravel()[cell]
                        copies = salts[block]
                        row = np.repeat(np.arange(len(vid)), copies)
                        inner = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                        rows.append(row), slots.append(offsets[block[row]] + inner), kinds.append(np.zeros(len(row), np.int8))
                    if as_query:
                        found = list(_visited(index, matrix))
                        row = np.repeat(np.arange(len(vid)), [len(f) for f in found])
                        block = np.array([b for f in found for b in f], np.int64)
                        rows.append(row), slots.append(offsets[block] + (vid[row] * 40503 >> 4) % salts[block]), kinds.append(np.ones(len(row), np.int8))
                    row = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots).astype(np.int32)), pa.array(np.concatenate(kinds)), pa.array(vid[row]), as_binary(matrix[row])], names=["slot", "kind", "vid", "vec"])

        return run

    columns = ["vid", "vec"]
    if shared:
        routed = entries.select(*columns).mapInArrow(route(True, True), fields)
    else:
        routed = entries.select(*columns).mapInArrow(route(True, False), fields).union(queries.select(*columns).mapInArrow(route(False, True), fields))
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ids, block = -1, [], [], None
        for batch in batches:
            slot, kind, vid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            matrix = as_matrix(batch.column(3), dim)
            change = np.flatnonzero((np.diff(slot) != 0) | (np.diff(kind) != 0)) + 1
            out = []
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(slot)]):
                if s == e:
                    continue
                if slot[s] != at:
                    at, parts, ids, block = slot[s], [], [], None
                if kind[s] == 0:
                    parts.append(matrix[s:e]), ids.append(vid[s:e])
                    continue
                if not parts:
                    continue
                if block is None:
                    block, eids = np.concatenate(parts), np.concatenate(ids)
                for q in range(s, e, 1024):
                    qs = slice(q, min(e, q + 1024))
                    cosines = matrix[qs] @ block.T
                    out.append(reducer(cosines, vid[qs], eids, vid[qs][:, None] != eids[None, :]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    slots = int(salts.sum())
    # about two slots a task, so that a task stays as large as it is at any size
    parts = max(1, min(slots, max(shuffle_partitions(entries.sparkSession) * 2, -(-slots // 2))))
    return routed.repartition(parts, "slot").sortWithinPartitions("slot", "kind").mapInArrow(search, schema)


def best_pairs(cosines: np.ndarray, mask: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest entries of each row that are masked
    in and at least ``least``."""
    masked = np.where(mask, cosines, np.float32(-2))
    hit = masked >= max(least, -1.5)
    many = np.flatnonzero(hit.sum(1) > k)
    if len(many):
        top = np.argpartition(-masked[many], k - 1, axis=1)[:, :k]
        hit[many] = False
        hit[many[:, None], top] = True
    return np.nonzero(hit)
