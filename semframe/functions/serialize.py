"""Records as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Serializer = Callable[[list[str]], Column]


def quoted(name: str) -> Column:
    """A column by its full name; names of joins contain dots."""
    return F.col("`{}`".format(name.replace("`", "``")))


def bare(name: str) -> str:
    return name.rpartition(".")[2]


def plain(columns: list[str]) -> Column:
    """The values joined by commas, without nulls."""
    return F.concat_ws(", ", *[quoted(c).cast("string") for c in columns])


def braced(columns: list[str]) -> Column:
    """``{name: 'value', ...}`` without qualifiers of names and without nulls."""
    cells = [F.when(quoted(c).isNotNull(), F.concat(F.lit(f"{bare(c)}: '"), quoted(c).cast("string"), F.lit("'"))) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))


def sorted_braced(columns: list[str]) -> Column:
    """As ``braced``, names in alphabetical order."""
    return braced(sorted(columns, key=bare))


def value_text(column: Column) -> Column:
    """One value as text, a null as None."""
    return F.coalesce(column.cast("string"), F.lit("None"))


def filled(template: str, columns: list[str]) -> Column:
    """A template with ``{name}`` or ``{left.name}`` placeholders; longer names
    win, doubled braces stand for themselves."""
    import re

    names = sorted(columns, key=len, reverse=True)
    parts: list[Column] = []
    at = 0
    for found in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}", template):
        parts.append(F.lit(template[at : found.start()]))
        if found[0] in ("{{", "}}"):
            parts.append(F.lit(found[0][0]))
        else:
            hit = next((c for c in names if c == found[1]), None) or next((c for c in names if bare(c) == found[1]), None)
            if hit is None:
                raise KeyError(found[1])
            parts.append(value_text(quoted(hit)))
        at = found.end()
    return F.concat(*parts, F.lit(template[at:]))


def positional(template: str, cells: list[Column]) -> Column:
    """A template with ``{}`` placeholders, filled in order."""
    pieces = template.split("{}")
    if len(pieces) - 1 != len(cells):
        raise ValueError(f"the template has {len(pieces) - 1} places for {len(cells)} columns")
    out = [F.lit(pieces[0])]
    for cell, piece in zip(cells, pieces[1:]):
        out += [value_text(cell), F.lit(piece)]
    return F.concat(*out)
