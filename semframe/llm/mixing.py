"""Mixing sources to target weights by Pfair scheduling (problem 9)."""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semframe.runtime import staged

# fixed value: how the byte-level tokenizer parts a text before it merges
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def token_counts(df: DataFrame, key: str, text: str, source: str, vocabulary: str) -> DataFrame:
    """``doc, source, tokens``: whole texts in tokens of a public byte-level
    vocabulary (a file of ranks), sources trimmed and in lower case.

    Null and empty texts have no tokens; a repeated key counts once."""
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.lower(F.trim(F.col(f"`{source}`"))).alias("source"), F.col(f"`{text}`").alias("text")).where("doc is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc", "source", "tokens"])

    counted = rows.mapInArrow(count, f"doc {rows.schema['doc'].dataType.simpleString()}, source string, tokens long")
    return counted.groupBy("doc").agg(F.min(F.struct("source", "tokens")).alias("m")).select("doc", "m.source", "m.tokens")


def pfair(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[int, str, int]]:
    """``(slot, source, block)``: earliest deadline first among released blocks.

    Block ``j`` (from 0) of a source of weight ``w`` is released at slot
    ``floor(j / w)`` and due by ``ceil((j + 1) / w)``; with weights that sum to
    at most 1 (others are refused) every deadline is met, so after each slot
    every source is within one block of its share.  A source whose blocks run
    out leaves its slots free.  Every block gets a slot.
    """
    if sum(w for w in weights.values() if w > 0) > 1 + 1e-6:
        raise ValueError("the weights sum to more than 1")
    exact = {s: Fraction(w).limit_denominator(10**9) for s, w in weights.items() if w > 0 and blocks.get(s)}
    waiting = [(0, math.ceil(1 / w), s, 0) for s, w in exact.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = -1
    while waiting or ready:
        slot = slot + 1 if ready else max(slot + 1, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        _, s, j = heapq.heappop(ready)
        yield slot, s, j
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (math.floor((j + 1) / exact[s]), math.ceil((j + 2) / exact[s]), s, j + 1))


@dataclass
class Mix:
    """``report``: one row a target; ``placed``: ``slot, start, doc, use,
    source, tokens``, in the order of slot and start the mixed stream."""

    report: DataFrame
    placed: DataFrame


def mix_sources(counted: DataFrame, targets: DataFrame, mix_tokens: int | None = None, slots: int = 50_000, max_targets: int = 10_000, slice_rows: int = 10_000, seed: int = 7) -> Mix:
    """Interleave sources so that each supplies its target share of the tokens.

    ``counted`` is a table of ``doc, source, tokens`` and ``targets`` has
    ``source, target_share, max_repeats``.  The mix is ``mix_tokens`` long, by
    default as long as all documents together, and is scheduled in ``slots``
    blocks by Pfair's release times and deadlines; what the driver holds is one
    row a target and ``slots`` rows.  Within a source, documents stand in the
    order of a seeded hash and the whole order is repeated as far as needed, at
    most ``max_repeats`` times; a document belongs to the block in which its
    first token falls.  Running sums go by bounded slices of a source, so a
    source with a third of all rows is spread.

    ``report``: ``source, target_share, max_repeats, tokens, needed_tokens,
    used_tokens, actual_share, reachable``.  Defined results: a target without
    documents, or whose tokens times ``max_repeats`` are fewer than its share
    of the mix, is not reachable and supplies what it can; targets with a null
    source are ignored and repeated targets count once (the largest share);
    documents of sources without a target take no part but count in the default
    length; an empty corpus gives a report of zeros; shares that sum to more than
    1 and more than ``max_targets`` targets are refused.
    """
    goals = targets.select(F.lower(F.trim("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats")).where("source is not null")
    goals = goals.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("g")).select("source", "g.target_share", "g.max_repeats")
    sums = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = mix_tokens if mix_tokens is not None else int(sums.agg(F.sum("tokens")).first()[0] or 0)
    plan = goals.join(sums, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"))
    plan = plan.withColumn("needed_tokens", F.col("target_share") * F.lit(float(total)))
    rows = plan.limit(max_targets + 1).collect()
    if len(rows) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    block = max(1, -(-total // slots))
    need = {r.source: min(r.needed_tokens, float(r.tokens * r.max_repeats)) for r in rows}
    blocks = {s: math.ceil(n / block) for s, n in need.items()}
    spark = counted.sparkSession
    schedule = spark.createDataFrame(list(pfair({r.source: r.target_share for r in rows}, blocks)), "slot int, source string, block long")

    chosen = plan.where("tokens > 0").select("source", "max_repeats", F.col("tokens").alias("all_tokens"), "docs", F.least(F.col("needed_tokens"), (F.col("tokens") * F.col("max_repeats")).cast("double")).alias("need"))
    lined = counted.where("tokens > 0").join(F.broadcast(chosen), "source").withColumn("h", F.xxhash64("doc", F.lit(seed)))
    # consecutive ranges of the hash, as many as keep a range within slice_rows
    width = F.ceil(F.col("docs") / slice_rows)
    lined = lined.withColumn("slice", F.floor((F.shiftrightunsigned("h", 33) * width) / F.lit(2**31)))
    sums = lined.groupBy("source", "slice").agg(F.sum("tokens").alias("n"))
    ahead = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).select("source", "slice", "before")
    inside = Window.partitionBy("source", "slice").orderBy(F.shiftrightunsigned("h", 33), "h", "doc")
    lined = lined.withColumn("inner", F.sum("tokens").over(inside) - F.col("tokens")).join(ahead, ["source", "slice"])
    lined = lined.withColumn("use", F.explode(F.sequence(F.lit(0), F.least(F.col("max_repeats") - 1, F.floor(F.col("need") / F.col("all_tokens"))).cast("int"))))
    lined = lined.withColumn("start", F.col("use") * F.col("all_tokens") + F.col("before") + F.col("inner")).where("start < need")
    placed = lined.withColumn("block", F.floor(F.col("start") / F.lit(block))).join(F.broadcast(schedule), ["source", "block"])
    placed = staged(placed.select("slot", "start", "doc", "use", "source", "tokens"), "mix")
    used = placed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"))
    report = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    whole = Window.partitionBy(F.lit(0))  # one row a target
    report = report.withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(whole), F.lit(0)), F.lit(0.0)))
    return Mix(report.select("source", "target_share", "max_repeats", "tokens", "needed_tokens", "used_tokens", "actual_share", (F.col("tokens") * F.col("max_repeats") >= F.col("needed_tokens")).alias("reachable")), placed)
