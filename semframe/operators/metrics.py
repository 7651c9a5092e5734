"""Quality of matches, clusters and texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.models.roles import Embedding, Validator, with_answers
from semframe.functions.serialize import filled, quoted, value_text
from semframe.operators.joins import soft_join
from semframe.relation import Relation
from semframe.runtime import staged


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1")]


def match_metrics(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` of two sets of key tuples; a ratio
    over nothing is 0."""
    a = truth.select(*[quoted(k) for k in keys]).distinct().withColumn("__t", F.lit(1))
    b = predicted.select(*[quoted(k) for k in keys]).distinct().withColumn("__p", F.lit(1))
    both = a.alias("a").join(b.alias("b"), [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys], "full_outer")
    counts = both.agg(F.count_if(F.col("__t").isNotNull() & F.col("__p").isNotNull()).alias("tp"), F.count_if(F.col("__t").isNull()).alias("fp"), F.count_if(F.col("__p").isNull()).alias("fn"))
    return counts.select(*_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_sweep(scored: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Metrics of the pairs at or above each threshold; ``truth`` says whether a
    pair is right.  Pairs are scored and read once: they are counted by the
    number of thresholds they reach, and the counts summed up."""
    marks = sorted(set(thresholds))
    reached = sum((F.when(quoted(score) >= t, 1).otherwise(0) for t in marks[1:]), F.when(quoted(score) >= marks[0], 1).otherwise(0))
    counted = scored.select(reached.alias("n"), F.coalesce(quoted(truth).cast("boolean"), F.lit(False)).alias("right")).groupBy("n").agg(F.count_if("right").alias("good"), F.count_if(~F.col("right")).alias("bad"))
    levels = scored.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(marks)], "level int, threshold double")
    totals = levels.join(counted, F.lit(True), "left").groupBy("threshold", "level").agg(F.sum(F.when(F.col("n") >= F.col("level"), F.col("good")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("n") >= F.col("level"), F.col("bad")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("n") < F.col("level"), F.col("good")).otherwise(0)).alias("fn"))
    return totals.select("threshold", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def classify_one_vs_all(rows: Relation, classes: Relation, columns: list[str], class_column: str, model: Embedding, threshold: float) -> Relation:
    """Each row with each class it means, by one soft join in place of one
    filter a class."""
    return soft_join(rows, classes, method="threshold", threshold=threshold, model=model, columns_left=columns, columns_right=[class_column], serializer=lambda cs: F.concat_ws(", ", *[quoted(c).cast("string") for c in cs]))


def prompt_study(rows: DataFrame, prompts: dict[str, str], truth: str, validator: Validator) -> DataFrame:
    """``prompt, tp, fp, fn, precision, recall, f1`` of each template, filled
    with the columns of a row and asked once a distinct prompt; ``truth`` says
    what the answer should be."""
    one = None
    for name, template in prompts.items():
        asked = with_answers(rows.select(quoted(truth).cast("boolean").alias("truth"), filled(template, rows.columns).alias("p")), "p", "yes", validator)
        told = asked.agg(F.count_if(F.col("truth") & F.col("yes")).alias("tp"), F.count_if(~F.col("truth") & F.col("yes")).alias("fp"), F.count_if(F.col("truth") & ~F.col("yes")).alias("fn"))
        told = told.select(F.lit(name).alias("prompt"), *_scores(F.col("tp"), F.col("fp"), F.col("fn")))
        one = told if one is None else one.union(told)
    return one


def expected_mi(sizes: DataFrame, n: int) -> float:
    """Expected mutual information of clusterings with given sizes by chance.

    ``sizes`` has ``a, ca, b, cb``: sizes of clusters of both sides and how many
    have them, one row a pair of *different* sizes.  Each pair is summed on an
    executor, in slices of its overlaps."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_factorial = lambda i: math.lgamma(i + 1)
        for batch in batches:
            out = []
            for a, ca, b, cb in zip(*(c.to_pylist() for c in batch.columns)):
                low, high, total = max(1, a + b - n), min(a, b), 0.0
                p = log_factorial(a) + log_factorial(b) + log_factorial(n - a) + log_factorial(n - b) - log_factorial(n) - log_factorial(low) - log_factorial(a - low) - log_factorial(b - low) - log_factorial(n - a - b + low)
                for at in range(low, high + 1, 1 << 20):
                    k = np.arange(at, min(high + 1, at + (1 << 20)), dtype=np.float64)
                    # from one overlap to the next the chance changes by this ratio
                    with np.errstate(divide="ignore"):  # none is left behind the largest overlap
                        steps = np.log(a - k) + np.log(b - k) - np.log(k + 1) - np.log(n - a - b + k + 1)
                    chance = p + np.concatenate([[0.0], np.cumsum(steps[:-1])])
                    total += float((k / n * np.log(n * k / (a * b)) * np.exp(chance)).sum())
                    p = chance[-1] + steps[-1]
                out.append(ca * cb * total)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["emi"])

    return sizes.select("a", "ca", "b", "cb").mapInArrow(summed, "emi double").agg(F.sum("emi")).first()[0] or 0.0


def cluster_scores(df: DataFrame, true: str, predicted: str) -> dict[str, float]:
    """Rand index, ARI, FMI, MI, AMI, NMI, homogeneity, completeness and
    V-measure.  Sums over clusters are made by Spark; the driver gets the sums."""
    cells = df.groupBy(quoted(true).alias("a"), quoted(predicted).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = staged(cells, "cells")
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias("n")) for c in "ab")

    def sums(t: DataFrame) -> tuple[float, float, float]:
        r = t.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum(F.col("n") * F.log("n")).alias("nlog")).first()
        return r.n or 0.0, r.pairs or 0.0, r.nlog or 0.0

    (n, both, nlog), (_, pa_, alog), (_, pb, blog) = sums(cells), sums(rows), sums(columns)
    if not n:
        return dict.fromkeys(("rand", "ari", "fmi", "mi", "ami", "nmi", "homogeneity", "completeness", "v_measure"), 0.0)
    all_pairs = n * (n - 1) / 2
    expected = pa_ * pb / all_pairs if all_pairs else 0.0
    most = (pa_ + pb) / 2
    mi = max(0.0, (nlog - alog - blog) / n + math.log(n))
    ha, hb = math.log(n) - alog / n, math.log(n) - blog / n
    # different sizes are at most the root of twice the rows, a side
    sizes = [t.groupBy(F.col("n").cast("long").alias(c)).agg(F.count(F.lit(1)).alias(f"c{c}")) for t, c in ((rows, "a"), (columns, "b"))]
    emi = expected_mi(sizes[0].join(sizes[1]), int(n))
    mean = (ha + hb) / 2
    hom, com = (mi / ha if ha > 1e-12 else 1.0), (mi / hb if hb > 1e-12 else 1.0)
    return {
        "rand": (all_pairs + 2 * both - pa_ - pb) / all_pairs if all_pairs else 1.0,
        "ari": (both - expected) / (most - expected) if most != expected else 1.0,
        "fmi": both / math.sqrt(pa_ * pb) if pa_ and pb else 0.0,
        "mi": mi,
        "ami": (mi - emi) / (mean - emi) if abs(mean - emi) > 1e-12 else 1.0,
        "nmi": mi / mean if mean > 1e-12 else 1.0,
        "homogeneity": hom,
        "completeness": com,
        "v_measure": 2 * hom * com / (hom + com) if hom + com else 0.0,
    }


def text_tokens(text: str | None) -> list[str]:
    """Words and single punctuation marks of the lower-cased text."""
    return re.findall(r"\w+|[^\w\s]", (text or "").lower())


def bleu(reference: list[str], candidate: list[str], n: int = 4, smooth: float = 0.1) -> float:
    """BLEU of one sentence with uniform weights up to ``n``-grams; n-grams
    without a match count ``smooth``."""
    if not candidate or not reference:
        return 0.0
    logs = 0.0
    for k in range(1, n + 1):
        got = Counter(tuple(candidate[i : i + k]) for i in range(len(candidate) - k + 1))
        there = Counter(tuple(reference[i : i + k]) for i in range(len(reference) - k + 1))
        hit, total = sum((got & there).values()), max(1, sum(got.values()))
        if k == 1 and not hit:
            return 0.0
        logs += math.log((hit or smooth) / total)
    return min(1.0, math.exp(1 - len(reference) / len(candidate))) * math.exp(logs / n)


def bleu_representativeness(inputs: DataFrame, text: str, outputs: DataFrame, out_text: str, group: str, n: int = 4) -> DataFrame:
    """``group, bleu``: mean over the inputs of a group of their best BLEU, each
    output of the group being the reference of the input; 0 for inputs that
    share no word with an output."""
    rows = staged(inputs.select(quoted(group).alias("g"), F.monotonically_increasing_id().alias("row"), quoted(text).alias("x")), "inputs")
    best = _best_bleu(rows, outputs.select(quoted(group).alias("g"), quoted(out_text).alias("y")), [n])
    told = rows.select("g", "row").join(best, "row", "left")
    return told.groupBy(F.col("g").alias(group)).agg(F.avg(F.coalesce(f"bleu{n}", F.lit(0.0))).alias("bleu"))


def calc_bleu(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """``bleu1`` to ``bleu4`` of two sets of key tuples, as texts: the mean over
    the true ones of their best BLEU with a predicted one as reference.  All are
    1 if every true tuple was predicted, and -1 if nothing was."""
    told = F.concat_ws(", ", *[value_text(quoted(k)) for k in keys])
    names = [f"bleu{i}" for i in range(1, 5)]
    rows = truth.select(F.lit(0).alias("g"), told.alias("x")).distinct()
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "truth")
    found = staged(predicted.select(F.lit(0).alias("g"), told.alias("y")).distinct(), "predicted")
    some = found.agg((F.count(F.lit(1)) > 0).alias("some"))
    missing = rows.join(found.withColumnRenamed("y", "x"), "x", "left_anti").agg((F.count(F.lit(1)) > 0).alias("missing"))
    means = rows.select("row").join(_best_bleu(rows, found, [1, 2, 3, 4]), "row", "left").agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in names])
    one = means.join(some).join(missing)  # one row each
    return one.select(*[F.when(~F.col("missing"), 1.0).when(~F.col("some"), -1.0).otherwise(F.col(c)).alias(c) for c in names])


def _best_bleu(rows: DataFrame, outputs: DataFrame, orders: list[int]) -> DataFrame:
    """``row, bleu<n>..``: best BLEU of each input against the outputs of its
    group that share a word with it; without one it is 0."""

    def words(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("w", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"(\w+|[^\w\s])")))))

    outputs = staged(outputs.where("y is not null").distinct().withColumn("out", F.monotonically_increasing_id()), "outputs")
    met = words(rows, "x").select("g", "w", "row").join(words(outputs, "y").select("g", "w", "out"), ["g", "w"]).select("row", "out").distinct()
    both = met.join(rows.select("row", "x"), "row").join(outputs.select("out", "y"), "out")
    for k in orders:
        both = both.withColumn(f"bleu{k}", _pair_udf(lambda x, y, k=k: [bleu(text_tokens(b), text_tokens(a), k) for a, b in zip(x, y)])("x", "y"))
    return both.groupBy("row").agg(*[F.max(f"bleu{k}").alias(f"bleu{k}") for k in orders])


def _pair_udf(score):
    import pandas as pd

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(score(x, y), dtype=float)

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")
