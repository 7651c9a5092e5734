"""Joins on criteria, on keys and on meaning."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semframe.functions.models.roles import Embedding, Validator, with_answers, with_embeddings
from semframe.functions.serialize import Serializer, braced, plain, quoted
from semframe.functions.vector import concatenated, dot, mean_pool, normalized, squared_l2
from semframe.operators.cells import near_blocks
from semframe.operators.criteria import All, Col, Criterion, FuzzyEqual, HardEqual, filtered
from semframe.relation import Relation
from semframe.runtime import staged

TEMPLATE = 'One record reads "{a}", another reads "{b}". Are both about one and the same thing? Yes or no.'


def disambiguated(left: Relation, right: Relation) -> tuple[DataFrame, DataFrame]:
    """Columns that both sides have become ``<relation>.<column>``."""
    common = set(left.columns) & set(right.columns)
    if common and left.name == right.name:
        raise ValueError(f"both sides are named {left.name}; give one an alias")
    sides = []
    for side in (left, right):
        sides.append(side.df.select(*[quoted(c).alias(f"{side.name}.{c}" if c in common else c) for c in side.columns]))
    return sides[0], sides[1]


def _joined(left: Relation, right: Relation, df: DataFrame, text: str) -> Relation:
    return left.derive(df, text, right, name=f"{left.name}+{right.name}")


def theta_join(left: Relation, right: Relation, criterion: Criterion) -> Relation:
    """Inner join on any criterion over the merged, renamed columns.

    Equalities of one column of each side are join keys, so Catalyst plans a
    hash or sort-merge join; other expressions are conditions of the join.
    Criteria that ask models filter the pairs the rest leaves."""
    a, b = disambiguated(left, right)
    parts = criterion.parts if isinstance(criterion, All) else [criterion]
    pair = a.join(b).limit(0)
    conditions, later = [], []
    for p in parts:
        if p.cost == 0:
            conditions.append(p.prepare(pair)[1])
        else:
            later.append(p)
    df = a.join(b, reduce(lambda x, y: x & y, conditions), "inner") if conditions else a.crossJoin(b)
    if later:
        df = filtered(df, All(later))
    return _joined(left, right, df, f"join [{criterion}]")


def hash_join(left: Relation, right: Relation, column_left: str, column_right: str) -> Relation:
    """Inner join on one key of each side, named as after renaming; a null key
    matches a null key.  Keys of kinds that don't compare match nothing."""
    a, b = disambiguated(left, right)
    for df, c in ((a, column_left), (b, column_right)):
        if c not in df.columns:
            raise KeyError(f"no column {c} among {df.columns}")
    merged = HardEqual(Col(column_left), Col(column_right)).prepare(a.join(b).limit(0))[1]
    return _joined(left, right, a.join(b, merged, "inner"), f"hash join [{column_left} = {column_right}]")


def fuzzy_join(left: Relation, right: Relation, column_left: str, column_right: str, most: int = 2) -> Relation:
    """Inner join on texts at most ``most`` edits apart.

    Pairs are not all compared: of two texts within ``most`` edits one of
    ``most + 1`` even slices of the shorter stands unchanged in the other,
    shifted by at most ``most``, so both sides are joined on slices."""
    a, b = disambiguated(left, right)
    x = staged(a.withColumn("__l", F.monotonically_increasing_id()), "fuzzy")
    y = staged(b.withColumn("__r", F.monotonically_increasing_id()), "fuzzy")

    def slices(df: DataFrame, column: str, row: str, shifts: int) -> DataFrame:
        """(row, length of the sliced text, slice number, slice)"""
        rows = df.select(row, quoted(column).cast("string").alias("t")).where("t is not null")
        lengths = F.explode(F.sequence(F.greatest(F.length("t") - shifts, F.lit(0)), F.length("t") + shifts)) if shifts else F.length("t")
        rows = rows.withColumn("n", lengths)
        part = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("part")
        rows = rows.select(row, "t", "n", part)
        begin = F.floor(F.col("n") * F.col("part") / (most + 1)).cast("int")
        end = F.floor(F.col("n") * (F.col("part") + 1) / (most + 1)).cast("int")
        shift = F.explode(F.sequence(F.lit(-shifts), F.lit(shifts))) if shifts else F.lit(0)
        rows = rows.select(row, "t", "n", "part", begin.alias("begin"), (end - begin).alias("len"), shift.alias("shift"))
        return rows.where(F.col("begin") + F.col("shift") >= 0).select(row, "n", "part", F.substring(F.col("t"), F.col("begin") + F.col("shift") + 1, F.col("len")).alias("slice")).distinct()

    hits = slices(x, column_left, "__l", 0).join(slices(y, column_right, "__r", most), ["n", "part", "slice"]).select("__l", "__r").distinct()
    near = F.levenshtein(quoted(column_left), quoted(column_right), most).between(0, most)
    df = x.join(hits, "__l").join(y, "__r").where(near).drop("__l", "__r")
    return _joined(left, right, df, f"fuzzy join [{FuzzyEqual(Col(column_left), Col(column_right), most)}]")


def _side(df: DataFrame, columns: list[str], row: str, comparison: str, form: str, serializer: Serializer, model: Embedding, normalize: bool) -> DataFrame:
    """``row, v`` of each record: one vector, such that the inner product of two
    is the similarity the join tests."""
    if comparison == "RECORD_WISE" and form == "FULL_SERIALIZED":
        out = with_embeddings(df.select(row, serializer(columns).alias("__t")), "__t", "v", model)
    else:
        out = df.select(row, *[quoted(c).cast("string").alias(f"__t{i}") for i, c in enumerate(columns)])
        for i in range(len(columns)):
            out = with_embeddings(out, f"__t{i}", f"__v{i}", model)
        cells = [F.col(f"__v{i}") for i in range(len(columns))]
        if comparison == "COLUMN_WISE":
            # the inner product of these is the mean of the columns' cosines
            zero = F.array_repeat(F.lit(0.0), model.size)
            root = float(len(columns)) ** 0.5
            v = concatenated([F.transform(F.coalesce(normalized(c), zero), lambda x: x / root) for c in cells])
        else:
            v = mean_pool(cells)
        out = out.withColumn("v", v)
    return out.select(row, (normalized(F.col("v")) if normalize else F.col("v")).alias("v")).where("v is not null")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, metric: str = "ip", physical: str = "cells") -> DataFrame:
    """``l, r, similarity`` of all pairs strictly beyond the threshold: inner
    product above it, or squared distance (``l2``) below it.

    ``left`` has ``l, v`` and ``right`` ``r, v``.  ``cells`` compares each
    vector with the cells of the other side that can hold a neighbour (see
    ``cells``); ``native`` is a join on the expression, which compares all."""
    if physical not in ("cells", "native"):
        raise ValueError(f"no physical form {physical}")
    if physical == "native":
        value = dot if metric == "ip" else squared_l2
        x, y = left.withColumnRenamed("v", "__x"), right.withColumnRenamed("v", "__y")
        near = value(F.col("__x"), F.col("__y"))
        return x.join(y, near > threshold if metric == "ip" else near < threshold).select("l", "r", near.alias("similarity"))

    def pairs(values, hit, qids, eids):
        i, j = np.nonzero(hit)
        return [qids[i], eids[j], values[i, j]]

    sides = [staged(df.select(F.col(c).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v is not null"), c) for df, c in ((left, "l"), (right, "r"))]
    return near_blocks(*sides, threshold, metric, pairs, "l long, r long, similarity double")


def soft_join(
    left: Relation,
    right: Relation,
    method: str = "both",
    comparison: str = "RECORD_WISE",
    form: str = "FULL_SERIALIZED",
    threshold: float | None = None,
    model: Embedding | None = None,
    validator: Validator | None = None,
    columns_left: list[str] | None = None,
    columns_right: list[str] | None = None,
    serializer: Serializer = braced,
    prompt_serializer: Serializer = plain,
    template: str = TEMPLATE,
    system_prompt: str | None = None,
    metric: str = "ip",
    normalize: bool = False,
    physical: str = "cells",
    with_score: bool = False,
) -> Relation:
    """Inner join of records that describe the same thing.

    ``threshold``: pairs whose similarity is *strictly* beyond the threshold.
    ``zero-shot-prompting``: all pairs, each decided by the validator.
    ``both``: pairs beyond the threshold that the validator confirms.

    RECORD_WISE compares one vector a record: FULL_SERIALIZED embeds the record
    as one text, FIELD_SERIALIZED averages the vectors of its fields (not
    normalised again unless ``normalize``).  COLUMN_WISE compares the mean of
    the cosines of corresponding columns, which must be named on both sides.

    Each distinct text is embedded once and each distinct prompt validated
    once.  Empty sides give an empty result; null fields are left out of texts
    and means and count as similarity 0 by column."""
    if method not in ("threshold", "zero-shot-prompting", "both"):
        raise ValueError(f"no method {method}")
    if comparison not in ("RECORD_WISE", "COLUMN_WISE") or form not in ("FULL_SERIALIZED", "FIELD_SERIALIZED"):
        raise ValueError(f"no comparison {comparison}, {form}")
    if method != "zero-shot-prompting" and (model is None or threshold is None):
        raise ValueError(f"method {method} needs a model and a threshold")
    if method != "threshold" and validator is None:
        raise ValueError(f"method {method} needs a validator")
    a, b = disambiguated(left, right)

    def chosen(side: Relation, df: DataFrame, names: list[str] | None) -> list[str]:
        out = []
        for n in df.columns if names is None else names:
            hit = n if n in df.columns else f"{side.name}.{n}" if f"{side.name}.{n}" in df.columns else None
            if hit is None:
                raise KeyError(f"no column {n} among {df.columns}")
            out.append(hit)
        return out

    if comparison == "COLUMN_WISE" and (columns_left is None or columns_right is None or len(columns_left) != len(columns_right)):
        raise ValueError("COLUMN_WISE needs as many columns of one side as of the other")
    cl, cr = chosen(left, a, columns_left), chosen(right, b, columns_right)
    a = staged(a.withColumn("__l", F.monotonically_increasing_id()), "left")
    b = staged(b.withColumn("__r", F.monotonically_increasing_id()), "right")
    if method == "zero-shot-prompting":
        pairs = a.select("__l").crossJoin(b.select("__r")).withColumn("similarity", F.lit(None).cast("double"))
    else:
        va = _side(a, cl, "__l", comparison, form, serializer, model, normalize).withColumnRenamed("__l", "l")
        vb = _side(b, cr, "__r", comparison, form, serializer, model, normalize).withColumnRenamed("__r", "r")
        pairs = similar_pairs(va, vb, threshold, metric, physical).withColumnsRenamed({"l": "__l", "r": "__r"})
    if method != "threshold":
        texts = [df.select(row, prompt_serializer(cols).alias(out)) for df, row, cols, out in ((a, "__l", cl, "__a"), (b, "__r", cr, "__b"))]
        asked = pairs.join(texts[0], "__l").join(texts[1], "__r")
        before, rest = template.split("{a}", 1)
        between, after = rest.split("{b}", 1)
        asked = asked.withColumn("__p", F.concat(F.lit(before), F.col("__a"), F.lit(between), F.col("__b"), F.lit(after)))
        pairs = with_answers(asked, "__p", "__yes", validator, system_prompt).where("__yes").select("__l", "__r", "similarity")
    df = pairs.join(a, "__l").join(b, "__r").select(*[quoted(c) for c in a.columns[:-1]], *[quoted(c) for c in b.columns[:-1]], *(["similarity"] if with_score else []))
    return _joined(left, right, df, f"soft join [{method}, {comparison}, {form}, {threshold}]")


def tfidf_join(left: Relation, right: Relation, column_left: str, column_right: str, threshold: float) -> Relation:
    """Inner join on the cosine of the TF-IDF vectors of two text columns,
    strictly above the threshold.

    Weights come from the words of both sides; pairs are found by an equi-join
    on shared words, so texts without a word in common are never compared.
    Prefix filter: words are ordered by rarity and the left side probes only
    with those before the point from which the rest can't reach the threshold
    (the right side's vectors have length 1)."""
    from pyspark.sql import Window

    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    a, b = disambiguated(left, right)
    x = staged(a.withColumn("__l", F.monotonically_increasing_id()), "left")
    y = staged(b.withColumn("__r", F.monotonically_increasing_id()), "right")

    def words(df: DataFrame, column: str, row: str) -> DataFrame:
        tokens = F.filter(F.split(F.lower(quoted(column).cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return df.select(row, F.explode(tokens).alias("word")).groupBy(row, "word").agg(F.count(F.lit(1)).alias("tf"))

    wx, wy = words(x, column_left, "__l"), words(y, column_right, "__r")
    every = x.count() + y.count()
    idf = wx.select("word").union(wy.select("word")).groupBy("word").agg((F.log(F.lit(1.0 + every) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))

    def weighed(w: DataFrame, row: str, out: str) -> DataFrame:
        w = w.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
        return w.withColumn(out, F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(row)))).select(row, "word", "idf", out)

    order = Window.partitionBy("__l").orderBy(F.desc("idf"), "word").rowsBetween(0, Window.unboundedFollowing)
    fx, fy = staged(weighed(wx, "__l", "p"), "words"), staged(weighed(wy, "__r", "q"), "words")
    probe = fx.withColumn("rest", F.sqrt(F.sum(F.col("p") * F.col("p")).over(order))).where(F.col("rest") > threshold)
    hits = probe.join(fy, "word").select("__l", "__r").distinct()
    scores = hits.join(fx, "__l").join(fy, ["__r", "word"]).groupBy("__l", "__r").agg(F.sum(F.col("p") * F.col("q")).alias("s")).where(F.col("s") > threshold)
    df = scores.select("__l", "__r").join(x, "__l").join(y, "__r").drop("__l", "__r")
    return _joined(left, right, df, f"tf-idf join [{column_left} ~ {column_right} > {threshold}]")
