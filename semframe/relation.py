"""A DataFrame with the two things it lacks: a relation name and its algebra."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Relation:
    """A lazy table.  ``name`` qualifies clashing columns of joins, ``tree`` is
    the plan as ``(text, children)``.

    Column names are unique; a second column of one name is refused when the
    relation is built."""

    df: DataFrame
    name: str
    tree: tuple = field(default=("", ()), compare=False)

    def __post_init__(self):
        seen: set[str] = set()
        for c in self.df.columns:
            if c in seen:
                raise ValueError(f"relation {self.name} has column {c} twice")
            seen.add(c)
        if not self.tree[0]:
            object.__setattr__(self, "tree", (self.name, ()))

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def derive(self, df: DataFrame, text: str, *others: Relation, name: str | None = None) -> Relation:
        return Relation(df, name or self.name, (text, (self.tree, *(o.tree for o in others))))

    def alias(self, name: str) -> Relation:
        """The same rows under another name, as a self join needs."""
        return Relation(self.df, name, (f"rename {self.name} to {name}", (self.tree,)))

    def transform(self, step: Callable[[DataFrame], DataFrame], text: str = "custom") -> Relation:
        """Any operator of one's own on the rows."""
        return self.derive(step(self.df), text)

    def fetch_all(self) -> list[dict]:
        """All rows, in the driver: for results that are known to be small."""
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def fetch_one(self) -> dict:
        """The first row; ``StopIteration`` where there is none."""
        row = self.df.head()
        if row is None:
            raise StopIteration
        return row.asDict(recursive=True)

    def batches(self, rows: int = 10) -> Iterator[list[dict]]:
        """All rows in lists of ``rows``, a partition in the driver at a time."""
        cursor = (r.asDict(recursive=True) for r in self.df.toLocalIterator(prefetchPartitions=True))
        while batch := list(islice(cursor, rows)):
            yield batch

    def structure(self) -> tuple:
        return self.tree

    def describe(self) -> str:
        """The plan in relational algebra, indented."""

        def lines(node: tuple, depth: int) -> Iterator[str]:
            yield "  " * depth + node[0]
            for child in node[1]:
                yield from lines(child, depth + 1)

        return "\n".join(lines(self.tree, 0))
