"""Near pairs of vectors without comparing all of them.

The entries are parted into cells around pivots.  By the triangle inequality a
query has neighbours only in cells whose pivot is no farther than its own reach
plus the cell's radius, so it is sent to those and compared there in matrices:
exact at any threshold, and the fewer comparisons the closer the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semframe.runtime import shuffle_partitions

Reducer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


@dataclass
class Cells:
    pivots: np.ndarray
    radius: np.ndarray  # distance of the farthest entry of a cell
    longest: np.ndarray  # length of its longest entry
    block: np.ndarray  # first block of a cell
    spread: np.ndarray  # blocks its entries are spread over
    blocks: int

    def visited(self, x: np.ndarray, threshold: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """``(row, block)``: the blocks in which a row can have a neighbour."""
        if metric == "ip":
            room = (x * x).sum(1)[:, None] + (self.longest**2)[None, :] - 2 * threshold
        else:
            room = np.full((1, len(self.pivots)), threshold)
        far = np.sqrt(squared_distances(x, self.pivots))
        near = (room >= -1e-9) & (far <= np.sqrt(np.maximum(room, 0)) + self.radius[None, :] + 1e-6)
        row, cell = np.nonzero(near)
        n = self.spread[cell]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(np.repeat(row, n) * self.blocks + np.repeat(self.block[cell], n) + inner)
        return pairs // self.blocks, pairs % self.blocks


def fit_cells(entries: DataFrame, rows: int, block_rows: int = 8192, most: int = 1024) -> Cells:
    """Pivots are rows drawn by hash, about the square root of all and at most
    ``most``; every row counts for the radius of its cell."""
    told = [r.v for r in entries.where("v is not null").orderBy(F.xxhash64("id")).limit(max(1, min(most, round(rows**0.5)))).select("v").collect()]
    pivots = np.unique(np.array(told, np.float64), axis=0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pivots)
        n, far, long = np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column(0))
            d = squared_distances(x, pivots)
            cell = d.argmin(1)
            n += np.bincount(cell, minlength=k)
            np.maximum.at(far, cell, np.sqrt(d[np.arange(len(x)), cell]))
            np.maximum.at(long, cell, np.sqrt((x * x).sum(1)))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(far[at]), pa.array(long[at])], names=["cell", "n", "far", "long"])

    n, far, long = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    found = entries.select("v").mapInArrow(measure, "cell long, n long, far double, long double")
    for r in found.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.max("long").alias("long")).collect():
        n[r.cell], far[r.cell], long[r.cell] = r.n, r.far, r.long
    block, spread, at, filled = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64), 0, 0
    for cell, size in enumerate(n.tolist()):
        if filled and filled + size > block_rows:
            at, filled = at + 1, 0
        block[cell] = at
        filled += size
        if filled > block_rows:
            spread[cell] = -(-size // block_rows)
            at, filled = at + int(spread[cell]), 0
    return Cells(pivots, far, long, block, spread, at + 1)


def near_blocks(queries: DataFrame, entries: DataFrame, threshold: float, metric: str, reducer: Reducer, schema: str, probes_a_task: int = 50_000, small_bytes: int = 8 << 20, **fit) -> DataFrame:
    """Reduce what lies strictly beyond the threshold, block by block.

    ``queries`` and ``entries`` have ``id, v``, vectors of one length; ``ip`` is
    an inner product above the threshold, ``l2`` a squared distance below it.
    ``reducer(values, hit, query ids, entry ids)`` gets a slice of queries
    against one block and returns the columns of ``schema``; the slices of a
    block follow each other with one array of entry ids.  Entries of at most
    ``small_bytes`` are one block that is sent to all tasks of the queries;
    more are parted into cells.  Blocks that many queries visit are copied and
    their queries salted."""
    spark = entries.sparkSession
    names = T._parse_datatype_string(schema).names

    def reduced(x: np.ndarray, own: np.ndarray, block: np.ndarray, eids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(x), 512):
            mine = slice(at, at + 512)
            values = x[mine] @ block.T if metric == "ip" else squared_distances(x[mine], block)
            out = reducer(values, values > threshold if metric == "ip" else values < threshold, own[mine], eids)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    told = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not told.n:
        return spark.createDataFrame([], schema)
    if told.n * told.dim * 8 <= small_bytes:
        one = entries.select("id", "v").toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((one.column(0).to_numpy(), np.stack(one.column(1).to_pylist()).astype(np.float64)))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            eids, block = sent.value
            for batch in batches:
                if batch.num_rows:
                    yield from reduced(matrix_of(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False), block, eids)

        return queries.select("id", "v").mapInArrow(whole, schema)
    cells = fit_cells(entries, told.n, **fit)
    asked = queries.count()
    sample = [r.v for r in queries.orderBy(F.xxhash64("id", F.lit(1))).limit(2048).select("v").collect()]
    visits = np.zeros(cells.blocks)
    if sample:
        np.add.at(visits, cells.visited(np.array(sample, np.float64), threshold, metric)[1], asked / len(sample))
    salts = np.maximum(1, np.ceil(visits / probes_a_task)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(salts)[:-1]])

    def route(as_entry: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 2000):
                    batch = big.slice(at, 2000)
                    own, x = batch.column(0).to_numpy(zero_copy_only=False), matrix_of(batch.column(1))
                    if as_entry:
                        cell = squared_distances(x, cells.pivots).argmin(1)
                        block = cells.block[cell] + np.arange(len(own)) % cells.spread[cell]
                        row = np.repeat(np.arange(len(own)), salts[block])
                        inner = np.arange(len(row)) - np.repeat(np.cumsum(salts[block]) - salts[block], salts[block])
                        slot = offsets[block[row]] + inner
                    else:
                        row, block = cells.visited(x, threshold, metric)
                        slot = offsets[block] + (own[row] * 40503 >> 4) % salts[block]
                    ends = (np.arange(len(row) + 1) * x.shape[1]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(np.full(len(row), not as_entry)), pa.array(own[row]), pa.ListArray.from_arrays(pa.array(ends), pa.array(x[row].ravel()))], names=["slot", "asks", "id", "v"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ids, block, eids = -1, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, asks, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = matrix_of(batch.column(3))
            change = np.flatnonzero((np.diff(slot) != 0) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(slot)]):
                if slot[s] != at:
                    at, parts, ids, block = slot[s], [], [], None
                if not asks[s]:
                    parts.append(x[s:e]), ids.append(own[s:e])
                    continue
                if not parts:
                    continue
                if block is None:
                    block, eids = np.concatenate(parts), np.concatenate(ids)
                yield from reduced(x[s:e], own[s:e], block, eids)

    fields = "slot int, asks boolean, id long, v array<double>"
    routed = entries.select("id", "v").mapInArrow(route(True), fields).union(queries.select("id", "v").mapInArrow(route(False), fields))
    slots = int(salts.sum())
    parts = max(1, min(slots, max(2 * shuffle_partitions(spark), -(-slots // 2))))
    return routed.repartition(parts, "slot").sortWithinPartitions("slot", "asks").mapInArrow(search, schema)


class Forest:
    """Links of one block as a forest: of queries and entries that are linked,
    directly or through others of the block, each query has one link and each
    two groups that meet have one, never each pair.

    ``root`` holds for each entry of the block the first entry it is known to
    be linked with."""

    def __init__(self):
        self.eids, self.root = None, None

    def links(self, hit: np.ndarray, qids: np.ndarray, eids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(a, b)``: links of the queries (rows of ``hit``) and among entries."""
        if self.eids is not eids:
            self.eids, self.root = eids, np.arange(len(eids))
        some, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        met, before, far = hit[np.ix_(some, columns)], self.root, len(eids)
        lows = np.zeros(0, np.int64)
        while len(some):
            lows = np.where(met, self.root[columns], far).min(1)
            low = np.full(far, far)
            np.minimum.at(low, self.root[columns], np.where(met, lows[:, None], far).min(0))
            moved = np.minimum(self.root, low[self.root])
            if (moved == self.root).all():
                break
            self.root = moved
        old = np.flatnonzero((before == np.arange(far)) & (self.root != before))
        return np.concatenate([qids[some], eids[old]]), np.concatenate([eids[lows], eids[self.root[old]]])
