"""The three roles of models and how their columns are computed.

A native model is a Column expression.  Any other runs in an Arrow-batched UDF
that loads it once a worker and is applied to the *distinct* inputs only, which
are joined back, so that a text a third of all rows carry is embedded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.serialize import quoted


class Embedding:
    """Texts to vectors of one size."""

    size: int
    native = False

    def embed(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def __call__(self, text: str | list[str], batch_size: int = 32) -> np.ndarray:
        """One text gives a vector, a list a matrix (also an empty one)."""
        if isinstance(text, str):
            return self.embed([text])[0]
        parts = [self.embed(text[i : i + batch_size]) for i in range(0, len(text), batch_size)]
        return np.concatenate(parts) if parts else np.zeros((0, self.size))

    def to_column(self, text: Column) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(np.asarray(self(texts.tolist()), np.float64)), index=texts.index, dtype=object)

        return _iterator_udf(run, "array<double>")(text)


class Validator:
    """Prompts to yes or no."""

    native = False

    def __call__(self, prompt: str, system_prompt: str | None = None) -> bool:
        raise NotImplementedError

    def to_column(self, prompt: Column, system_prompt: str | None = None) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for prompts in batches:
                yield prompts.map(lambda p: bool(self(p, system_prompt)) if p is not None else False).astype(bool)

        return _iterator_udf(run, "boolean")(prompt)


class Generator:
    """Prompts to texts.  At a temperature above 0 the answers aren't
    deterministic and the column is marked so."""

    native = False

    def __call__(self, prompt: str, system_prompt: str | None = None, max_new_tokens: int = 100, temperature: float = 0.7) -> str:
        raise NotImplementedError

    def to_column(self, prompt: Column, system_prompt: str | None = None, max_new_tokens: int = 100, temperature: float = 0.7) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for prompts in batches:
                yield prompts.map(lambda p: None if p is None else self(p, system_prompt, max_new_tokens, temperature)).astype(object)

        udf = _iterator_udf(run, "string")
        return (udf.asNondeterministic() if temperature > 0 else udf)(prompt)


def _iterator_udf(run, kind: str):
    from typing import get_type_hints  # the hints choose the iterator form

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    assert get_type_hints(run)
    return F.pandas_udf(run, kind)


def _over_distinct(df: DataFrame, source: str, out: str, column) -> DataFrame:
    answers = df.select(quoted(source).alias("__in")).where("__in is not null").distinct().select("__in", column(F.col("__in")).alias(out))
    return df.join(answers, quoted(source) == F.col("__in"), "left").drop("__in")


def with_embeddings(df: DataFrame, text: str, out: str, model: Embedding) -> DataFrame:
    """``df`` with the vector of a text column; a null text has none."""
    if model.native:
        return df.withColumn(out, F.when(quoted(text).isNotNull(), model.to_column(quoted(text))))
    return _over_distinct(df, text, out, model.to_column)


def with_answers(df: DataFrame, prompt: str, out: str, model: Validator, system_prompt: str | None = None) -> DataFrame:
    """``df`` with the answer to a prompt column; never null."""
    if model.native:
        return df.withColumn(out, F.coalesce(model.to_column(quoted(prompt), system_prompt), F.lit(False)))
    return _over_distinct(df, prompt, out, lambda p: model.to_column(p, system_prompt)).withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def with_texts(df: DataFrame, prompt: str, out: str, model: Generator, **options) -> DataFrame:
    """``df`` with the text generated for a prompt column, one call a row."""
    return df.withColumn(out, model.to_column(quoted(prompt), **options))
