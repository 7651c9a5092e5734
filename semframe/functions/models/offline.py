"""Deterministic models that need neither network nor weights."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from semframe.functions.models.roles import Embedding, Generator, Validator
from semframe.functions.vector import normalized

LETTERS = "abcdefghijklmnopqrstuvwxyz"


class LetterEmbedding(Embedding):
    """Counts of the letters a to z of the lower-cased text, as an expression;
    with ``unit`` at length 1, so that the inner product is the cosine."""

    size, native = 26, True

    def __init__(self, unit: bool = False):
        self.unit = unit

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.array([[t.lower().count(c) for c in LETTERS] for t in texts], np.float64).reshape(len(texts), 26)
        if self.unit:
            n = np.sqrt((out * out).sum(1, keepdims=True))
            out = np.divide(out, n, out=out, where=n > 0)
        return out

    def to_column(self, text: Column) -> Column:
        low = F.lower(text)
        counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
        return normalized(counts) if self.unit else counts


class HashedNgramEmbedding(Embedding):
    """Hashed counts of character n-grams at length 1."""

    def __init__(self, size: int = 256, n: int = 3):
        self.size, self.n = size, n

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in enumerate(texts):
            padded = f" {' '.join(re.findall(r'[^\W_]+', text.lower()))} "
            for i in range(len(padded) - self.n + 1):
                h = zlib.crc32(padded[i : i + self.n].encode())
                out[row, h % self.size] += 1 if h >> 31 else -1
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


class DictionaryEmbedding(Embedding):
    """Vectors given for each text; others get a vector of zeros."""

    def __init__(self, vectors: dict[str, list[float]]):
        self.vectors = {k: np.asarray(v, np.float64) for k, v in vectors.items()}
        self.size = len(next(iter(self.vectors.values())))

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vectors.get(t, np.zeros(self.size)) for t in texts]).reshape(len(texts), self.size)


class CallableEmbedding(Embedding):
    """Any function of a list of texts that returns a matrix."""

    def __init__(self, function: Callable[[list[str]], np.ndarray], size: int):
        self.function, self.size = function, size

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.function(texts)).reshape(len(texts), self.size)


class CallableValidator(Validator):
    """Any function of a prompt; a dictionary answers no for other prompts."""

    def __init__(self, function: Callable[[str], bool] | dict[str, bool]):
        self.function = (lambda p: function.get(p, False)) if isinstance(function, dict) else function

    def __call__(self, prompt: str, system_prompt: str | None = None) -> bool:
        return bool(self.function(prompt))


class OverlapValidator(Validator):
    """Yes if the two quoted parts of a prompt share at least ``least`` words,
    as an expression."""

    native = True

    def __init__(self, least: int = 1):
        self.least = least

    def __call__(self, prompt: str, system_prompt: str | None = None) -> bool:
        parts = prompt.split('"')
        return len(parts) > 3 and len(set(parts[1].lower().split(" ")) & set(parts[3].lower().split(" ")) - {""}) >= self.least

    def to_column(self, prompt: Column, system_prompt: str | None = None) -> Column:
        parts = F.split(prompt, '"')
        words = [F.split(F.lower(F.get(parts, F.lit(i))), " ") for i in (1, 3)]
        return F.coalesce(F.size(F.array_remove(F.array_intersect(*words), "")) >= self.least, F.lit(False))


class EchoGenerator(Generator):
    """Answers with the prompt in lower case, as an expression."""

    native = True

    def __call__(self, prompt: str, system_prompt: str | None = None, max_new_tokens: int = 100, temperature: float = 0.7) -> str:
        return prompt.lower()

    def to_column(self, prompt: Column, system_prompt: str | None = None, max_new_tokens: int = 100, temperature: float = 0.7) -> Column:
        return F.lower(prompt)


class CallableGenerator(Generator):
    """Any function of a prompt that returns a text."""

    def __init__(self, function: Callable[[str], str]):
        self.function = function

    def __call__(self, prompt: str, system_prompt: str | None = None, max_new_tokens: int = 100, temperature: float = 0.7) -> str:
        return self.function(prompt)
