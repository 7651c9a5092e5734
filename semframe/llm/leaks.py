"""Evaluation passages inside training texts (problem 8)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Windows are three template tokens at these distances, so a window survives a
# changed word beside or between its tokens.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4))
TAG = re.compile(r"<[^<>]{0,300}>")
# letters and digits in runs; a character of a script without spaces by itself
WORD = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]|(?:(?![฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿])[^\\W_])+")
NUMBER = re.compile(r"\d")
# fixed values: units of measure as they are written behind numbers
UNITS = frozenset("mm cm m km in inch inches ft feet mile miles mg g kg grams gram lb lbs pounds oz ml l liter liters litre litres w kw watt watts kwh v volt volts hz khz mhz ghz kb mb gb tb percent degrees degree seconds second minutes minute hours hour days day weeks week months month years year dollars euros usd eur".split())
NAME, NUM, UNIT = "\x01name", "\x01num", "\x01unit"


def plain(text: str) -> str:
    """Without markup, entities, accents, invisible characters; case is kept."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def tokens(text: str) -> list[str]:
    return WORD.findall(plain(text))


def templates(words: list[str]) -> tuple[list[str], list[str], list[str]]:
    """``(words, numbers and units replaced, names replaced too)``; a name is a
    capitalised word behind a word that isn't."""
    lower = [w.casefold() for w in words]
    typed = [NUM if NUMBER.search(w) else w for w in lower]
    typed = [UNIT if w in UNITS and i and typed[i - 1] == NUM else w for i, w in enumerate(typed)]
    named = [NAME if w[:1].isupper() and not w.isupper() and i and words[i - 1][:1].islower() else t for i, (w, t) in enumerate(zip(words, typed))]
    return lower, typed, named


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bits of one number a row."""
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        if w in where:
            u = row & where[w]
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def common_path(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places ``(in a, in b)`` of a longest common subsequence."""
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for w in b:
        row = rows[-1]
        u = row & where.get(w, 0)
        rows.append(((row + u) | (row - u)) & full)

    def length(i: int, j: int) -> int:
        return i - (rows[j] & ((1 << i) - 1)).bit_count()

    out, i, j = [], len(a), len(b)
    while i and j and length(i, j):
        if length(i, j - 1) == length(i, j):
            j -= 1
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def slots_agree(item: list[str], item_slots: list[str], doc: list[str], doc_slots: list[str]) -> tuple[int, int, bool | None]:
    """``(words in common, values changed, agree)`` of two templates, word by
    word along their longest common subsequence, so that words put in or left
    out do not matter.  Slots agree if each value of the item stands for one
    value of the text and the other way round; null without slots."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    agree: bool | None = None
    path = common_path(item_slots, doc_slots)
    changed = 0
    for i, j in path:
        if item_slots[i] in (NAME, NUM, UNIT):
            one = there.setdefault(item[i], doc[j]) == doc[j] and back.setdefault(doc[j], item[i]) == item[i]
            agree = one if agree is None else agree and one
            changed += item[i] != doc[j]
    return len(path), changed, agree


class Passages:
    """Template windows of the passages of one slice of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(key, *templates(tokens(text))) for key, text in items]
        self.words = sorted({w for _, _, typed, named in self.items for w in (*typed, *named)})
        self.number = {w: i for i, w in enumerate(self.words)}
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, lower, typed, named) in enumerate(self.items):
            for form in [typed] if typed == named else [typed, named]:
                ids = np.array([self.number[w] for w in form], np.int64)
                for s, codes in enumerate(self.windows(ids)):
                    for p, code in enumerate(codes.tolist()):
                        at[code * len(SHAPES) + s].append((n, p))
        self.at = dict(at)
        self.codes = np.array(sorted(self.at), np.int64)

    def windows(self, ids: np.ndarray) -> list[np.ndarray]:
        v = len(self.words) + 1
        # three numbers of words in one code; beyond 2 million words they wrap, and wrapped codes only add candidates
        return [(ids[: max(0, len(ids) - c)] * v + ids[b : len(ids) - c + b]) * v + ids[c:] if len(ids) > c else np.zeros(0, np.int64) for _, b, c in SHAPES]

    def hits(self, form: list[str]) -> Iterator[tuple[int, int]]:
        """``(item, start of the passage in the text)`` of each window hit."""
        ids = np.array([self.number.get(w, -1) for w in form], np.int64)
        for s, ((_, b, c), codes) in enumerate(zip(SHAPES, self.windows(ids))):
            if not len(codes):
                continue
            known = np.flatnonzero((ids[: len(ids) - c] >= 0) & (ids[b : len(ids) - c + b] >= 0) & (ids[c:] >= 0))
            codes = codes[known] * len(SHAPES) + s
            to = np.searchsorted(self.codes, codes)
            for k in np.flatnonzero(self.codes[np.minimum(to, len(self.codes) - 1)] == codes) if len(self.codes) else ():
                for n, p in self.at[int(codes[k])]:
                    yield n, int(known[k]) - p

    def leaks(self, text: str, share: float, least_hits: int) -> Iterator[tuple[int, int, float, int, float, int, bool | None]]:
        """``(key, words found, share, first word, share of the template, values
        changed, slots agree)`` of a leaked item."""
        lower, typed, named = templates(tokens(text))
        starts: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        hits: dict[int, int] = defaultdict(int)
        for form in [typed] if typed == named else [typed, named]:
            for n, start in self.hits(form):
                starts[n][start] += 1
                hits[n] += 1
        for n, found in starts.items():
            key, item, item_typed, item_named = self.items[n]
            enough = min(least_hits, max(1, len(item) - 2))
            if hits[n] < enough:
                continue
            room, best, alike = max(4, len(item) // 4), (0, 0), (0, 0)
            done = -(10**9)
            for start in sorted(found):
                if start - done < room // 2:  # its stretch was looked at with the last one
                    continue
                done = start
                if sum(c for s, c in found.items() if abs(s - start) <= room) < enough:
                    continue
                near = slice(max(0, start - room), max(0, start + len(item) + room))
                best = max(best, (common_subsequence(item, lower[near]), -start))
                alike = max(alike, (common_subsequence(item_named, named[near]), -start))
            copied = best[0] >= share * len(item) and best[0]
            if not copied and not alike[0] >= max(1, share * len(item)):
                continue
            start = -(best if copied else alike)[1]
            near = slice(max(0, start - room), max(0, start + len(item) + room))
            same, changed, agree = slots_agree(item, item_named, lower[near], named[near])
            # the same question with other values: most of it stands there, each value for one other
            if copied or agree and changed and same >= 0.8 * len(item):
                yield key, best[0], best[0] / len(item), max(0, start), same / len(item), changed, agree


def leaked_passages(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, share: float = 0.5, least_hits: int = 4, items_a_pass: int = 20_000) -> DataFrame:
    """``doc_id, item_id, words, share, start, template_share, changed,
    slots_agree, reparameterised`` of each document that holds at least ``share`` of the words of
    a passage, in their order and close together (``share`` tells how many), or
    the passage with other values in it (``reparameterised``).

    Words are canonical: without case, accents, punctuation, markup and
    invisible characters.  Numbers, units and names become typed placeholders,
    and windows of template tokens of the text are joined by hash with those of
    the passages, whose table is small enough to be sent to all tasks; texts
    with ``least_hits`` window hits of an item are compared word by word around
    them.  The values in the placeholders are checked along the longest common
    subsequence of both templates: ``changed`` counts those that differ, and
    ``slots_agree`` says whether each value stands for one other throughout.
    That check decides about texts with fewer than ``share`` of the words: where
    at least 0.8 of the template stands and all slots agree, the passage was
    copied with other values.

    The documents are read once and never shuffled.  The items' table is
    broadcast in slices of ``items_a_pass`` rows: more items mean more passes,
    not a larger broadcast.  Defined results: null or empty texts and passages
    and null keys give no row; repeated rows count once, the larger share; other
    columns are ignored.
    """
    spark = docs.sparkSession
    chosen = items.select(F.col(f"`{item_key}`").cast("long").alias("i"), F.col(f"`{passage}`").alias("p")).where("i is not null and p is not null").distinct()
    source = docs.select(F.col(f"`{doc_key}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t")).where("d is not null and length(t) > 0")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("template_share", T.DoubleType()), T.StructField("changed", T.IntegerType()), T.StructField("slots_agree", T.BooleanType())])
    total = chosen.count()
    passes = max(1, -(-total // items_a_pass))
    out = None
    for turn in range(passes):
        part = chosen if passes == 1 else chosen.where(F.pmod(F.xxhash64("i", "p"), F.lit(passes)) == turn)
        index = spark.sparkContext.broadcast([(r.i, r.p) for r in part.collect()])

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            passages = Passages(index.value)
            for batch in batches:
                rows = [(d, *leak) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for leak in passages.leaks(t, share, least_hits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.bool_()))], names=schema.names)

        found = source.mapInArrow(scan, schema)
        out = found if out is None else out.union(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "words", (-F.col("start")).alias("back"), "template_share", "changed", "slots_agree")).alias("m"))
    return best.select("doc_id", "item_id", "m.words", "m.share", (-F.col("m.back")).alias("start"), "m.template_share", "m.changed", "m.slots_agree", (F.col("m.share") < share).alias("reparameterised"))
