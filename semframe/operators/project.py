"""Projection and its mappings."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semframe.functions.models.roles import Embedding, Generator
from semframe.functions.serialize import positional, quoted, value_text
from semframe.operators.binding import bind_columns
from semframe.operators.criteria import Col, Const, Operand
from semframe.relation import Relation

OPERATIONS: dict[str, Callable] = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}


class Mapping:
    """One output column from some input columns.  ``column`` gets the schema
    and a function from a declared name to its bound expression."""

    output: str

    def inputs(self) -> list[str]:
        return []

    def column(self, schema: T.StructType, bound: Callable[[str], str]) -> Column:
        raise NotImplementedError


@dataclass
class Identity(Mapping):
    """A column under its declared or a new name."""

    name: str
    output: str = ""

    def __post_init__(self):
        self.output = self.output or self.name

    def inputs(self):
        return [self.name]

    def column(self, schema, bound):
        return quoted(bound(self.name))

    def __str__(self):
        return self.name if self.name == self.output else f"{self.name} as {self.output}"


@dataclass
class Math(Mapping):
    """``+ - * /`` of columns and constants.  Division is true division and
    fails on zero; null operands give null; texts are refused."""

    left: Operand
    operation: str
    right: Operand
    output: str = ""

    def __post_init__(self):
        if self.operation not in OPERATIONS:
            raise ValueError(f"no operation {self.operation}")
        sides = [s.name if isinstance(s, Col) else s.value for s in (self.left, self.right)]
        self.folded = None
        if isinstance(self.left, Const) and isinstance(self.right, Const):
            self.folded = OPERATIONS[self.operation](self.left.value, self.right.value)
        self.output = self.output or (str(self.folded) if self.folded is not None else f"{sides[0]}{self.operation}{sides[1]}")

    def inputs(self):
        return [s.name for s in (self.left, self.right) if isinstance(s, Col)]

    def column(self, schema, bound):
        if self.folded is not None:
            return F.lit(self.folded)
        cells = []
        for side in (self.left, self.right):
            if isinstance(side, Const):
                if isinstance(side.value, str):
                    raise TypeError("arithmetic on a text")
                cells.append(F.lit(side.value))
            else:
                if not isinstance(schema[bound(side.name)].dataType, T.NumericType):
                    raise TypeError(f"arithmetic on {side.name}, which is no number")
                cells.append(quoted(bound(side.name)))
        if self.operation == "/":
            return cells[0].cast("double") / cells[1].cast("double")
        return OPERATIONS[self.operation](*cells)

    def __str__(self):
        return self.output


@dataclass
class Concat(Mapping):
    """Texts and columns (``Col``) joined by a delimiter; a null reads None."""

    parts: list[str | Col]
    output: str = "str_concat"
    delimiter: str = ""

    def inputs(self):
        return [p.name for p in self.parts if isinstance(p, Col)]

    def column(self, schema, bound):
        return F.concat_ws(self.delimiter, *[value_text(quoted(bound(p.name))) if isinstance(p, Col) else F.lit(p) for p in self.parts])

    def __str__(self):
        return f"concat as {self.output}"


@dataclass
class Generate(Mapping):
    """Text a model writes for a ``{}`` template filled in order."""

    columns: list[str]
    output: str
    model: Generator
    template: str
    max_new_tokens: int = 100
    temperature: float = 0.7

    def inputs(self):
        return list(self.columns)

    def column(self, schema, bound):
        prompt = positional(self.template, [quoted(bound(c)) for c in self.columns])
        return self.model.to_column(prompt, None, self.max_new_tokens, self.temperature)

    def __str__(self):
        return f"generate as {self.output}"


@dataclass
class Custom(Mapping):
    """A function of one's own: of expressions (``kind="native"``), of pandas
    Series (``"pandas"``) or of single values (``"python"``)."""

    columns: list[str]
    output: str
    output_type: str
    function: Callable = field(compare=False)
    kind: str = "pandas"

    def inputs(self):
        return list(self.columns)

    def column(self, schema, bound):
        cells = [quoted(bound(c)) for c in self.columns]
        if self.kind == "native":
            return self.function(*cells)
        if self.kind == "python":
            return F.udf(self.function, self.output_type)(*cells)
        import pandas as pd

        def run(*series: pd.Series) -> pd.Series:
            return self.function(*series)

        run.__annotations__ = {"series": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, self.output_type)(*cells)

    def __str__(self):
        return f"{getattr(self.function, '__name__', 'function')}({', '.join(self.columns)}) as {self.output}"


def _mapping(given: str | tuple[str, str] | Mapping) -> Mapping:
    if isinstance(given, str):
        return Identity(given)
    if isinstance(given, tuple) and len(given) == 2 and all(isinstance(g, str) for g in given):
        return Identity(*given)
    if isinstance(given, Mapping):
        return given
    raise TypeError(f"{given!r} is no mapping")


def projected(df: DataFrame, columns: list[str | tuple[str, str] | Mapping], model: Embedding | None = None, threshold: float = 0.1, metric: str = "ip") -> DataFrame:
    mappings = [_mapping(c) for c in columns]
    bound = bind_columns(list(dict.fromkeys(n for m in mappings for n in m.inputs())), df.columns, model, threshold, metric)
    return df.select(*[m.column(df.schema, bound.__getitem__).alias(m.output) for m in mappings])


def project(relation: Relation, columns: list[str | tuple[str, str] | Mapping], model: Embedding | None = None, threshold: float = 0.1, metric: str = "ip") -> Relation:
    """One output column a mapping, and nothing else.

    Referenced columns that don't exist are bound to the nearest name by
    ``model``; the output keeps the declared name."""
    df = projected(relation.df, columns, model, threshold, metric)
    return relation.derive(df, f"project [{', '.join(str(_mapping(c)) for c in columns)}]")
