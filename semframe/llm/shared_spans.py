"""Long exact spans shared between records (problem 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semframe.llm.rolling import Powers, Sums, least_blocks, slices
from semframe.operators.tiles import pairs_within
from semframe.runtime import staged


@dataclass
class SharedSpans:
    """``classes``: ``doc, text, size, rep, n`` of every record, ``rep`` being
    the smallest of the ``n`` records with the same text; ``runs``: ``text, run,
    lo, n`` of the anchored runs (``n`` windows from ``lo`` on) of each distinct
    text; ``whole``: the runs that several texts have; ``partial``: ``key, run,
    at``, single windows that runs of different texts have in common."""

    classes: DataFrame
    runs: DataFrame
    whole: DataFrame
    partial: DataFrame
    length: int


def shared_spans(df: DataFrame, key: str, text: str, length: int = 250) -> SharedSpans:
    """All windows of ``length`` characters that stand verbatim in several texts.

    Blocks of half the length are the anchors.  Every rolling block is hashed,
    and of the blocks within each window of ``length`` characters the one with
    the least hash anchors that window: two equal windows have the same anchor,
    wherever they stand, so an index of the anchors (about one in a quarter of
    the length) is enough to find every shared window, without a filter of the
    corpus and in one reading of the texts.  Neighbouring windows with one
    anchor are one run, a row of the index with the hash of its whole stretch.

    Anchors of several texts are hits.  They are extended run by run: stretches
    that are equal as a whole are shared as they are; only where the stretches
    around one anchor differ, one text of each different stretch gives its
    windows one by one, and windows common to different stretches are shared
    parts.  No pair of records is built here, so a stretch that a third of all
    records share costs as much as any other.  All hashes have 64 bits.

    Defined results: null texts and null keys take no part; texts shorter than
    ``length`` share nothing; a key that is repeated with other texts keeps
    one of them; other columns are ignored; empty in, empty out.
    """
    block = max(1, length // 2)
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(f"`{text}`").alias("text"), F.col(f"`{text}`").alias("t")).where("doc is not null and t is not null")
    kind = rows.schema["doc"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, powers = ["doc", "text", "anchor", "run", "lo", "n"], Powers()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), none, none, pa.nulls(len(texts), pa.int32()), pa.array([len(t) for t in texts], pa.int32())], names=names)
            own = batch.column(1).to_numpy(zero_copy_only=False)
            for codes, number, offset, last in slices(texts, length - 1):
                sums = Sums(codes, powers)
                starts, counts, anchor = least_blocks(sums, last, block, length)
                stretch = sums.hashes(starts, starts + counts - 1 + length)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(starts), batch.column(0).type), pa.array(own[number[starts]]), pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(offset[starts].astype(np.int32)), pa.array(counts.astype(np.int32))], names=names)

    read = staged(rows.mapInArrow(anchors, f"doc {kind}, text long, anchor long, run long, lo int, n int"), "anchors")
    told = read.where("anchor is null").select("doc", F.struct("text", F.col("n").alias("size")).alias("mark"))
    kept = told.groupBy("doc").agg(F.min("mark").alias("mark"))
    reps = kept.groupBy("mark").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = staged(kept.join(reps, "mark").select("doc", "mark.text", "mark.size", "rep", "n"), "texts")
    lost = told.select("mark.text").distinct().join(classes.select("text"), "text", "left_anti")  # of keys with several texts
    index = read.where("anchor is not null").select("text", "anchor", "run", "lo", "n").join(lost, "text", "left_anti")
    several = index.groupBy("anchor").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("anchor")
    hits = staged(index.join(several, "anchor", "left_semi").distinct(), "hits")
    whole = hits.groupBy("run").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("run")
    differing = hits.groupBy("anchor").agg(F.min("run").alias("a"), F.max("run").alias("b")).where("a <> b").select("anchor")
    shown = hits.join(differing, "anchor", "left_semi").groupBy("run").agg(F.min(F.struct("text", "lo", "n")).alias("one"), (F.min("text") != F.max("text")).alias("several")).select("run", "one.*", "several")
    shown = shown.groupBy("text").agg(F.collect_list(F.struct("run", "lo", "n", "several")).alias("runs"))  # bounded by one text's length
    shown = shown.join(classes.where("doc = rep").select("doc", "text"), "text").withColumnRenamed("text", "own")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for own, t, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums = Sums(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), powers)
                counts = np.array([r["n"] for r in runs])
                at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                start = np.repeat([r["lo"] for r in runs], counts) + at
                run, several = (np.repeat(np.array([r[c] for r in runs], kind), counts) for c, kind in (("run", np.int64), ("several", bool)))
                yield pa.RecordBatch.from_arrays([pa.array(sums.hashes(start, start + length).view(np.int64)), pa.array(run), pa.array(np.full(len(run), own)), pa.array(several), pa.array(at.astype(np.int32))], names=["key", "run", "text", "several", "at"])

    single = staged(rows.join(shown, "doc").where("text = own").select("own", "t", "runs").mapInArrow(windows, "key long, run long, text long, several boolean, at int"), "windows")
    # of different stretches, and not of one text alone
    common = single.groupBy("key").agg((F.min("run") != F.max("run")).alias("runs"), (F.min("text") != F.max("text")).alias("texts"), F.max("several").alias("several")).where("runs and (texts or several)").select("key")
    partial = staged(single.select("key", "run", "at").join(common, "key", "left_semi").distinct(), "parts")
    return SharedSpans(classes, hits.select("text", "run", "lo", "n"), staged(whole, "whole"), partial, length)


def one_of_each(groups: DataFrame, group: str, member: str) -> DataFrame:
    """Of groups with the same members one, told by count, least member and a
    sum of hashes."""
    signed = groups.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("low"), F.sum(F.xxhash64(member).cast("decimal(38,0)")).alias("sign"))
    return groups.join(signed.groupBy("n", "low", "sign").agg(F.min(group).alias(group)).select(group), group, "left_semi")


def sharing_pairs(spans: SharedSpans, expand: int = 64, tile: int = 512) -> DataFrame:
    """``doc_a, doc_b``: records whose texts share a span.

    Runs and windows that stand in the same set of texts lead to the same
    pairs, so one of each is paired, in salted tiles of ``tile`` texts.  Equal
    texts: the members of a class of at most ``expand`` records are all paired;
    of a larger class each member is paired with the class's first record only,
    which stands for it elsewhere.
    """
    texts = spans.runs.select("run", "text").distinct()
    alike = one_of_each(texts.join(spans.whole, "run", "left_semi"), "run", "text").select(F.col("run").alias("group"), "text")
    parts = one_of_each(spans.partial.select("key", "run").distinct(), "key", "run").join(texts, "run").select(F.col("key").alias("group"), "text")
    links = pairs_within(staged(alike.union(parts).distinct(), "groups"), "group", "text", tile).select(F.col("text").alias("a"), F.col("other").alias("b")).distinct()
    members = spans.classes.where((F.col("n") <= expand) | (F.col("doc") == F.col("rep"))).select("doc", "text")
    left, right = members.select(F.col("text").alias("a"), F.col("doc").alias("x")), members.select(F.col("text").alias("b"), F.col("doc").alias("y"))
    across = links.join(left, "a").join(right, "b").select("x", "y")
    copies = spans.classes.where((F.col("n") > 1) & (F.col("size") >= spans.length))
    small = copies.where(F.col("n") <= expand).select("rep", F.col("doc").alias("x"))
    inside = small.join(small.withColumnRenamed("x", "y"), "rep").where("x < y").select("x", "y")
    star = copies.where((F.col("n") > expand) & (F.col("doc") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("doc").alias("y"))
    return across.union(inside).union(star).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def islands(df: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """``group, low, high``: ranges ``[low, high)`` of a group that touch or
    overlap made one."""
    line = Window.partitionBy(group).orderBy(low, high)
    before = F.max(high).over(line.rowsBetween(Window.unboundedPreceding, -1))
    broken = df.withColumn("_new", (before.isNull() | (F.col(low) > before)).cast("int"))
    return broken.withColumn("_island", F.sum("_new").over(line)).groupBy(group, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def maximal_spans(spans: SharedSpans) -> DataFrame:
    """``doc, start, size``: the stretches of each record's text, as long as
    they go, whose every window of the spans' length is shared or that are made
    of shared windows that overlap or touch.  A copy is shared as a whole."""
    parts = islands(spans.partial.select("run", F.col("at").alias("low"), (F.col("at") + 1).alias("high")), "run", "low", "high")
    parts = spans.runs.join(parts, "run").select("text", (F.col("lo") + F.col("low")).alias("low"), (F.col("lo") + F.col("high") - 1 + spans.length).alias("high"))
    alike = spans.runs.join(spans.whole, "run", "left_semi").select("text", F.col("lo").alias("low"), (F.col("lo") + F.col("n") - 1 + spans.length).alias("high"))
    per = islands(alike.union(parts), "text", "low", "high")
    copied = (F.col("n") > 1) & (F.col("size") >= spans.length)
    rows = spans.classes.where(~copied).select("doc", "text").join(per, "text").select("doc", "low", "high")
    rows = rows.union(spans.classes.where(copied).select("doc", F.lit(0), F.col("size")))
    return rows.select("doc", F.col("low").cast("long").alias("start"), (F.col("high") - F.col("low")).cast("long").alias("size"))


def shared_share(spans: SharedSpans) -> DataFrame:
    """``doc, size, shared_chars, share, stretches`` of every record: the
    characters of its text that lie in a span shared with another record, and
    the number of maximal shared stretches."""
    per = maximal_spans(spans).groupBy("doc").agg(F.sum("size").alias("shared"), F.count(F.lit(1)).alias("stretches"))
    rows = spans.classes.select("doc", "size").join(per, "doc", "left")
    shared = F.coalesce("shared", F.lit(0)).cast("long")
    return rows.select("doc", F.col("size").cast("long").alias("size"), shared.alias("shared_chars"), (shared / F.greatest("size", F.lit(1))).alias("share"), F.coalesce("stretches", F.lit(0)).cast("long").alias("stretches"))
