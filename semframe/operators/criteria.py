"""Predicates and the filter.

Every predicate is two-valued: it yields true or false, never null.  A filter
applies the parts of a conjunction in the order of their cost: expressions,
then embeddings, then validators, each on what the cheaper ones left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semframe.functions.models.roles import Embedding, Validator, with_answers, with_embeddings
from semframe.functions.serialize import Serializer, filled, plain, quoted, value_text
from semframe.functions.vector import COSINE, Measure, literal
from semframe.relation import Relation

_number = count()
NATIVE, EMBEDDED, VALIDATED = 0, 1, 2


def _temp() -> str:
    return f"__c{next(_number)}"


@dataclass(frozen=True)
class Col:
    """A column of the relation."""

    name: str


@dataclass(frozen=True)
class Const:
    """A constant."""

    value: object


Operand = Col | Const


def _column(df: DataFrame, side: Operand) -> Column:
    if isinstance(side, Const):
        return F.lit(side.value)
    if side.name not in df.columns:
        raise KeyError(f"no column {side.name} among {df.columns}")
    return quoted(side.name)


def _family(df: DataFrame, side: Operand) -> str:
    """Kinds of values that compare with each other."""
    if isinstance(side, Const):
        v = side.value
        return "any" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else "text" if isinstance(v, str) else "other"
    kind = df.schema[side.name].dataType
    return "any" if isinstance(kind, T.NullType) else "boolean" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "text" if isinstance(kind, T.StringType) else "other"


def comparable(df: DataFrame, left: Operand, right: Operand) -> bool:
    a, b = _family(df, left), _family(df, right)
    # a boolean equals the numbers 0 and 1
    return a == b or "any" in (a, b) or {a, b} == {"boolean", "number"} or ("other" in (a, b) and "number" not in (a, b) and "boolean" not in (a, b))


class Criterion:
    """A predicate.  ``prepare`` returns the table with the columns it needs and
    the condition; ``cost`` orders the parts of a conjunction."""

    cost = NATIVE

    def prepare(self, df: DataFrame) -> tuple[DataFrame, Column]:
        raise NotImplementedError

    def __and__(self, other: Criterion) -> All:
        return All([self, other])

    def __or__(self, other: Criterion) -> AnyOf:
        return AnyOf([self, other])

    def __invert__(self) -> Not:
        return Not(self)


def _strict(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@dataclass
class HardEqual(Criterion):
    """Equality; null equals null.  A number never equals a text."""

    left: Operand
    right: Operand

    def prepare(self, df):
        a, b = _column(df, self.left), _column(df, self.right)
        if not comparable(df, self.left, self.right):
            return df, a.isNull() & b.isNull()
        if {_family(df, self.left), _family(df, self.right)} == {"boolean", "number"}:
            a, b = a.cast("double"), b.cast("double")
        return df, a.eqNullSafe(b)

    def __str__(self):
        return f"{_told(self.left)} = {_told(self.right)}"


@dataclass
class GreaterThan(Criterion):
    """Greater; false where either side is null."""

    left: Operand
    right: Operand

    def prepare(self, df):
        return df, _strict(_column(df, self.left) > _column(df, self.right))

    def __str__(self):
        return f"{_told(self.left)} > {_told(self.right)}"


@dataclass
class SmallerThan(Criterion):
    """Smaller; false where either side is null."""

    left: Operand
    right: Operand

    def prepare(self, df):
        return df, _strict(_column(df, self.left) < _column(df, self.right))

    def __str__(self):
        return f"{_told(self.left)} < {_told(self.right)}"


@dataclass
class IsNull(Criterion):
    left: Operand

    def prepare(self, df):
        return df, _column(df, self.left).isNull()

    def __str__(self):
        return f"{_told(self.left)} is null"


@dataclass
class IsNotNull(Criterion):
    left: Operand

    def prepare(self, df):
        return df, _column(df, self.left).isNotNull()

    def __str__(self):
        return f"{_told(self.left)} is not null"


@dataclass
class FuzzyEqual(Criterion):
    """At most ``most`` single-character edits apart; a null equals a null."""

    left: Operand
    right: Operand
    most: int = 2

    def prepare(self, df):
        a, b = _column(df, self.left).cast("string"), _column(df, self.right).cast("string")
        return df, _strict(F.levenshtein(a, b, self.most).between(0, self.most)) | (a.isNull() & b.isNull())

    def __str__(self):
        return f"{_told(self.left)} ~{self.most} {_told(self.right)}"


@dataclass
class Predicate(Criterion):
    """A predicate of one's own: a function from the columns' expressions to a
    condition, or, with ``python``, of their values."""

    columns: list[str]
    function: Callable
    python: bool = False

    def prepare(self, df):
        cells = [_column(df, Col(c)) for c in self.columns]
        return df, _strict(F.udf(self.function, "boolean")(*cells) if self.python else self.function(*cells))

    def __str__(self):
        return f"{getattr(self.function, '__name__', 'predicate')}({', '.join(self.columns)})"


@dataclass
class Not(Criterion):
    """Two-valued negation: keeps rows for which the inner one isn't true."""

    inner: Criterion

    @property
    def cost(self):
        return self.inner.cost

    def prepare(self, df):
        df, condition = self.inner.prepare(df)
        return df, ~condition

    def __str__(self):
        return f"not ({self.inner})"


class _Many(Criterion):
    def __init__(self, parts: list[Criterion]):
        self.parts = list(parts)

    @property
    def cost(self):
        return max((p.cost for p in self.parts), default=NATIVE)

    def _all(self, df):
        conditions = []
        for p in self.parts:
            df, c = p.prepare(df)
            conditions.append(c)
        return df, conditions


class All(_Many):
    """Conjunction; of no parts it is true."""

    def prepare(self, df):
        df, conditions = self._all(df)
        return df, reduce(lambda a, b: a & b, conditions, F.lit(True))

    def __str__(self):
        return " and ".join(f"({p})" for p in self.parts) or "true"


class AnyOf(_Many):
    """Disjunction; of no parts it is false."""

    def prepare(self, df):
        df, conditions = self._all(df)
        return df, reduce(lambda a, b: a | b, conditions, F.lit(False))

    def __str__(self):
        return " or ".join(f"({p})" for p in self.parts) or "false"


Side = Col | Const | list[str] | None


@dataclass
class SoftEqual(Criterion):
    """Two sides that mean the same: a column, a constant, a list of columns or
    (None) the whole record, as text.

    ``threshold``: the measure of their embeddings reaches the threshold
    (inclusive).  ``zero-few-shot``: a validator says that both describe one
    thing.  ``both``: the validator is asked about what passes the threshold."""

    left: Side
    right: Side
    model: Embedding | None = None
    validator: Validator | None = None
    method: str = "both"
    serialize: Serializer = plain
    measure: Measure = COSINE
    threshold: float = 0.9
    template: str = 'Compare "{left}" with "{right}". Is it one and the same thing that both tell of? Yes or no.'
    system_prompt: str | None = None

    def __post_init__(self):
        if self.method not in ("threshold", "zero-few-shot", "both"):
            raise ValueError(f"no method {self.method}")
        if self.method != "zero-few-shot" and self.model is None:
            raise ValueError(f"method {self.method} needs an embedding model")
        if self.method != "threshold" and self.validator is None:
            raise ValueError(f"method {self.method} needs a validator")

    @property
    def cost(self):
        return EMBEDDED if self.method == "threshold" else VALIDATED

    def _text(self, df: DataFrame, side: Side) -> Column:
        if isinstance(side, Const):
            return F.lit(str(side.value))
        if isinstance(side, Col):
            return value_text(_column(df, side))
        own = [c for c in df.columns if not c.startswith("__c")]
        wanted = own if side is None else [c for c in own if c in side]
        if side is not None and len(wanted) < len(set(side)):
            raise KeyError(f"no columns {set(side) - set(wanted)}")
        return self.serialize(wanted)

    def within(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """The threshold test; a constant is embedded once, in the driver."""
        vectors = []
        for side in (self.left, self.right):
            if isinstance(side, Const):
                vectors.append(literal(self.model(str(side.value))))
                continue
            text, out = _temp(), _temp()
            df = with_embeddings(df.withColumn(text, self._text(df, side)), text, out, self.model)
            vectors.append(F.col(out))
        return df, self.measure(*vectors, self.threshold)[1]

    def asked(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """The validator's answer."""
        prompt, out = _temp(), _temp()
        before, rest = self.template.split("{left}", 1)
        between, after = rest.split("{right}", 1)
        text = F.concat(F.lit(before), self._text(df, self.left), F.lit(between), self._text(df, self.right), F.lit(after))
        df = with_answers(df.withColumn(prompt, text), prompt, out, self.validator, self.system_prompt)
        return df, F.col(out)

    def prepare(self, df):
        if self.method == "threshold":
            return self.within(df)
        if self.method == "zero-few-shot":
            return self.asked(df)
        df, near = self.within(df)
        df, yes = self.asked(df)
        return df, near & yes

    def stages(self) -> list[Callable[[DataFrame], tuple[DataFrame, Column]]]:
        return [self.within, self.asked] if self.method == "both" else [self.prepare]

    def __str__(self):
        return f"{_told(self.left)} ~ {_told(self.right)}"


@dataclass
class SoftValidate(Criterion):
    """The validator's answer to a template filled with ``{column}`` values;
    qualified columns may stand in it."""

    template: str
    validator: Validator
    system_prompt: str | None = None
    cost = VALIDATED

    def prepare(self, df):
        prompt, out = _temp(), _temp()
        df = with_answers(df.withColumn(prompt, filled(self.template, df.columns)), prompt, out, self.validator, self.system_prompt)
        return df, F.col(out)

    def __str__(self):
        return f"validate {self.template!r}"


def _told(side: Side) -> str:
    return side.name if isinstance(side, Col) else repr(side.value) if isinstance(side, Const) else "record" if side is None else f"[{', '.join(side)}]"


def _conjuncts(criterion: Criterion) -> list[Criterion]:
    return [p for part in criterion.parts for p in _conjuncts(part)] if isinstance(criterion, All) else [criterion]


def filtered(df: DataFrame, criterion: Criterion) -> DataFrame:
    """Rows for which the criterion is true; the columns stay as they are."""
    own = [quoted(c) for c in df.columns]
    for part in sorted(_conjuncts(criterion), key=lambda p: p.cost):
        for stage in part.stages() if isinstance(part, SoftEqual) else [part.prepare]:
            df, condition = stage(df)
            df = df.filter(condition)
    return df.select(*own)


def select(relation: Relation, criterion: Criterion) -> Relation:
    return relation.derive(filtered(relation.df, criterion), f"select [{criterion}]")
