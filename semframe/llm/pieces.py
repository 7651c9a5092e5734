"""Oversized texts cut at natural boundaries (problem 5)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADING = re.compile(r"\s*(?:(#{1,6})\s+\S|(={1,6})[^=].*[^=]?\2\s*$|<h([1-6])[\s>])", re.I)
ITEM = re.compile(r"\s*(?:[-*+•]\s+|\d{1,3}[.)]\s+|\||<(?:li|tr|td|p|div|br)\b)", re.I)
SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』”’)]*\s*)")
TAG = re.compile(r"<(/?)(ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|div|p|section|article|blockquote|pre|h[1-6])\b[^<>]*>", re.I)
GAP = re.compile(r"\s+")


@dataclass
class Node:
    start: int
    end: int
    kind: str
    children: list[Node] = field(default_factory=list)

    @property
    def size(self) -> int:
        return self.end - self.start


def tree(text: str) -> Node:
    """Headings hold the blocks and deeper headings below them, blocks (split
    by blank lines) hold lines and list items, items hold their further lines
    and the items that are indented below them."""
    root = Node(0, len(text), "text")
    path = [(0, root)]
    block: Node | None = None
    items: list[tuple[int, Node]] = []  # open list items and their indents

    def close(at: int) -> None:
        for _, n in path:
            n.end = at

    at = 0
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        if found := HEADING.match(line):
            depth = len(found[1] or found[2] or "") or int(found[3])
            while path[-1][0] >= depth:
                path.pop()[1].end = at
            section = Node(at, end, "section", [])
            path[-1][1].children.append(section)
            path.append((depth, section))
            section.children.append(Node(at, end, "heading"))
            block, items = None, []
        elif not line.strip():
            # blank lines belong to what stands before them
            last = block or (path[-1][1].children[-1] if path[-1][1].children else None)
            if last is None:
                path[-1][1].children.append(Node(at, end, "block"))
            else:
                if last.children:
                    last.children[-1].end = end
                last.end = end
            block = None
        else:
            if block is None:
                block, items = Node(at, end, "block", []), []
                path[-1][1].children.append(block)
            indent = len(line) - len(line.lstrip())
            is_item = ITEM.match(line) is not None
            while items and (indent < items[-1][0] or indent == items[-1][0]):
                items.pop()
            for node in (block, *(n for _, n in items)):
                node.end = end
            own = Node(at, end, "line")
            if is_item:
                own = Node(at, end, "item", [own])
            (items[-1][1] if items else block).children.append(own)
            if is_item:
                items.append((indent, own))
        at = end
    close(len(text))
    return root


def elements(text: str, start: int, end: int) -> list[Node]:
    """The outermost elements of markup and what stands between them; of a
    stretch that is one element its tags and what they hold.  Elements that
    aren't closed end where one of their kind begins, or with the stretch."""
    tags = [(m.start(), m.end(), m[1] == "/", m[2].lower()) for m in TAG.finditer(text, start, end)]
    if len(tags) > 1 and tags[0][0] == start and not tags[0][2]:
        depth = 0
        for n, (_, stop, closes, name) in enumerate(tags):
            depth += (-1 if closes else 1) * (name == tags[0][3])
            if not depth:
                if n and not text[stop:end].strip():  # one element from end to end
                    inner = elements(text, tags[0][1], tags[n][0])
                    inner = inner or [Node(tags[0][1], tags[n][0], "line")]
                    return [Node(start, tags[0][1], "tag"), *(x for x in inner if x.size), Node(tags[n][0], end, "tag")]
                break
    cuts, open_ = [], []
    for at, stop, closes, name in tags:
        if closes:
            if name in open_:
                while open_.pop() != name:
                    pass
                if not open_:
                    cuts.append(stop)
        else:
            if open_ and open_[-1] == name and name in ("li", "p", "td", "th", "tr", "dt", "dd"):
                open_.pop()
            if not open_:
                cuts.append(at)
            open_.append(name)
    cuts = sorted({c for c in cuts if start < c < end})
    return [Node(a, b, "element") for a, b in zip([start, *cuts], [*cuts, end])] if cuts else []


def finer(text: str, node: Node) -> list[Node]:
    """Children of an oversized node: of the tree, else elements of markup, else
    sentences, else words."""
    inner = list(node.children)
    if inner and inner[-1].end < node.end:
        inner.append(Node(inner[-1].end, node.end, "line"))
    if len(inner) > 1:
        return inner
    if inner:  # one child that is the whole
        return finer(text, inner[0])
    if node.kind not in ("sentence", "word") and (inner := elements(text, node.start, node.end)):
        return inner
    if node.kind in ("sentence", "word"):
        pattern, kind = GAP, "word"
    else:
        pattern, kind = SENTENCE, "sentence"
    cuts = [m.end() for m in pattern.finditer(text, node.start, node.end) if m.end() < node.end]
    if not cuts:
        return [] if kind == "word" else finer(text, Node(node.start, node.end, "sentence"))
    return [Node(a, b, kind) for a, b in zip([node.start, *cuts], [*cuts, node.end])]


def hard_cuts(text: str, start: int, end: int, limit: int) -> Iterator[tuple[int, int, str]]:
    """Pieces of a stretch without any boundary; a cut does not part a
    character from marks that belong to it, where that leaves it in the limit."""
    while end - start > limit:
        cut = start + limit
        for back in range(16):
            c = text[cut - back]
            if limit <= 16 or not (unicodedata.combining(c) or c in "‍️⃣\n" or text[cut - back - 1] == "‍"):
                cut -= back
                break
        yield start, cut, "hard"
        start = cut
    if end > start:
        yield start, end, "hard"


def packed(text: str, node: Node, limit: int) -> list[tuple[int, int, str]]:
    """Bottom-up: the parts of a node's children, neighbours merged while they
    stay in the limit.  Only nodes over the limit are entered."""
    if node.size <= limit:
        return [(node.start, node.end, node.kind)]
    inner = finer(text, node)
    if not inner:
        return list(hard_cuts(text, node.start, node.end, limit))
    out: list[tuple[int, int, str]] = []
    for child in inner:
        for start, end, kind in packed(text, child, limit):
            if out and end - out[-1][0] <= limit:
                out[-1] = (out[-1][0], end, kind)
            else:
                out.append((start, end, kind))
    return out


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, end, boundary)`` of each piece: at most ``limit`` characters,
    each but the first beginning ``overlap`` characters before the end of the
    last.  A text within the limit is one piece."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and larger than overlap")
    if len(text) <= limit:
        return [(0, len(text), "text")]
    parts = packed(text, tree(text), limit - overlap)
    return [(max(0, start - overlap) if i else start, end, kind) for i, (start, end, kind) in enumerate(parts)]


def cut_pieces(df: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """``<keys>.., size, longest_run, piece, start, end, boundary, content`` of
    every piece of the texts over ``limit`` characters.

    A tree of headings, blocks, lines, nested list items and elements of markup
    is parsed from each text;
    sibling subtrees are merged bottom-up to the limit and only oversized nodes
    are entered, down to sentences, words and, within stretches that have no
    boundary at all, characters.  ``longest_run`` is the longest stretch
    without a space, tab or line break.  Pieces without their overlap make up
    the text exactly.

    Texts are filtered by length before they reach Python, so nothing else of
    the table is moved.  Defined results: null, empty and blank texts and texts
    within the limit give no piece; rows repeated under one key count once (the
    longest text, then the smallest); rows with null keys are kept under those;
    other columns are ignored.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks)], F.col(f"`{text}`").alias("text")).where(F.char_length("text") > limit)
    rows = rows.groupBy(*ks).agg(F.min(F.struct((-F.char_length("text")).alias("n"), F.col("text").alias("text"))).alias("best")).select(*ks, F.col("best.text").alias("text"))
    schema = T.StructType([*[rows.schema[k] for k in ks], T.StructField("size", T.LongType()), T.StructField("longest_run", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("boundary", T.StringType()), T.StructField("content", T.StringType())])
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, whole in enumerate(batch.column(len(ks)).to_pylist()):
                longest = max(map(len, re.split(r"[ \t\r\n]", whole)))
                pieces = cut(whole, limit, overlap)
                own = [pa.array([batch.column(i)[row].as_py()] * len(pieces), batch.column(i).type) for i in range(len(ks))]
                cells = zip(*[(len(whole), longest, n, s, e, kind, whole[s:e]) for n, (s, e, kind) in enumerate(pieces)])
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(cells, types)]], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(ks, keys)))
