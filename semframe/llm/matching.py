"""Matching rows of two tables without a common key (problem 6)."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semframe.llm.listings import HOUSEHOLD, Catalogue, features, other_sizes, refuted, same_price
from semframe.llm.names import Words, folded, learned_words, parse, same_organisation, same_person, sounded
from semframe.memo import memo
from semframe.runtime import staged

BITS, PARTS, RADIUS = 256, 16, 15
# fixed values: remarks that make another recording, with their usual forms
VERSIONS = {"live": "live", "acoustic": "acoustic", "remix": "remix", "mix": "remix", "karaoke": "karaoke", "instrumental": "instrumental", "demo": "demo", "cover": "cover", "unplugged": "acoustic"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


@memo
def grams(text: str) -> frozenset[str]:
    padded = f"_{text}_"
    return frozenset(padded[i : i + 2] for i in range(len(padded) - 1)) if text else frozenset()


def dice(a: str, b: str) -> float:
    x, y = grams(a), grams(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


@memo
def gram_bits(tag: str, gram: str, hashes: int) -> int:
    h = zlib.crc32(f"{tag}:{gram}".encode())
    step = zlib.crc32(f"{gram}:{tag}".encode()) | 1
    bits = 0
    for i in range(hashes):
        bits |= 1 << ((h + i * step) % (1 << 32) * BITS >> 32)
    return bits


def bit_vector(fields: dict[str, str]) -> int:
    """Bits of the q-grams of all fields, about half of them set: the number of
    hashes follows the number of q-grams, in steps that leave near texts equal."""
    every = [(tag, g) for tag, text in fields.items() for g in grams(text)]
    hashes = next((k for most, k in ((8, 20), (14, 12), (24, 7), (40, 5), (70, 3)) if len(every) <= most), 2)
    out = 0
    for tag, g in every:
        out |= gram_bits(tag, g, hashes)
    return out


def as_longs(bits: int) -> list[int]:
    return [int.from_bytes(part, "little", signed=True) for part in (bits.to_bytes(BITS // 8, "little")[i : i + 8] for i in range(0, BITS // 8, 8))]


def hamming_pairs(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``l, r``: ids of all vectors within ``radius`` bits, exactly.

    Multi-index hashing: vectors of 256 bits are cut into ``radius + 1`` parts;
    two within the radius have at least one part in common, on which they are
    joined, and the rest is decided by counting bits.  ``left`` and ``right``
    have ``id`` and ``bits`` (four longs), one row a distinct vector."""
    if radius != PARTS - 1:
        raise ValueError("the vectors are cut into 16 parts")
    parts = [F.shiftrightunsigned(F.col("bits")[i // 4], 16 * (i % 4)).bitwiseAND(0xFFFF).alias(str(i)) for i in range(PARTS)]
    part = F.posexplode(F.array(*parts)).alias("part", "value")
    a = left.select(F.col("id").alias("l"), F.col("bits").alias("x"), part)
    b = right.select(F.col("id").alias("r"), F.col("bits").alias("y"), part)
    apart = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(1, 4)), F.bit_count(F.col("x")[0].bitwiseXOR(F.col("y")[0])))
    return a.join(b, ["part", "value"]).where(apart <= radius).select("l", "r").distinct()


def seconds(text: str | None) -> int | None:
    """Length of a track written as seconds, m:ss, h:mm:ss or 3m 5s."""
    t = (text or "").strip().lower()
    if found := re.fullmatch(r"(?:(\d+):)?(\d+):(\d\d)", t):
        return int(found[1] or 0) * 3600 + int(found[2]) * 60 + int(found[3])
    if found := re.fullmatch(r"(?:(\d+)\s*h)?\s*(?:(\d+)\s*m(?:in)?)?\s*(?:(\d+)\s*s(?:ec)?)?", t):
        if any(found.groups()):
            return int(found[1] or 0) * 3600 + int(found[2] or 0) * 60 + int(found[3] or 0)
    return int(t) if t.isdigit() else None


def released(text: str | None) -> tuple[int, int, int] | None:
    """Year, month and day, 0 where they aren't told."""
    t = (text or "").strip().lower()
    if found := re.fullmatch(r"(\d{4})(?:-(\d\d?)-(\d\d?))?", t):
        return int(found[1]), int(found[2] or 0), int(found[3] or 0)
    if found := re.fullmatch(r"(\d\d?)/(\d\d?)/(\d{4})", t):
        return int(found[3]), int(found[1]), int(found[2])
    if found := re.fullmatch(r"(\d\d?)[- ]([a-z]{3})[a-z]*[- ](\d{2}|\d{4})", t):
        year = int(found[3])
        return year + (0 if year > 99 else 1900 if year > 26 else 2000), MONTHS.index(found[2]) + 1 if found[2] in MONTHS else 0, int(found[1])
    if found := re.fullmatch(r"([a-z]{3})[a-z]*\.? (\d\d?),? (\d{4})", t):
        return int(found[3]), MONTHS.index(found[1]) + 1 if found[1] in MONTHS else 0, int(found[2])
    return None


def title_of(text: str | None) -> tuple[str, str]:
    """``(title, version)`` without remarks of labels."""
    plain = folded(text or "")
    remarks = re.findall(r"\(([^)]*)\)|\[([^\]]*)\]", plain)
    bare = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", plain)
    bare, _, after = bare.partition(" - ")
    version = set()
    for remark in [a or b for a, b in remarks] + [after]:
        for w in re.findall(r"[a-z]{3,}", remark):
            near = VERSIONS.get(w) or next((v for k, v in VERSIONS.items() if len(k) >= 4 and abs(len(k) - len(w)) <= 2 and w[0] == k[0] and dice(w, k) >= 0.55), None)
            if near:
                version.add(near)
    return " ".join(re.findall(r"\w+", bare)), " ".join(sorted(version))


def song(row: dict, known: Words) -> dict:
    title, version = title_of(row["song_name"])
    album = title_of(re.sub(r" - (?:ep|single)\s*$", "", folded(row["album_name"] or "")))[0]
    kind, core, rest = parse(row["artist_name"], "?", known) if (row["artist_name"] or "").strip() else ("", "", "")
    long = [t for t in rest.split() if len(t) > 2] if kind == "p" else [core] if core else []
    surname = sounded(max(long, key=lambda t: (t in long[-1:], len(t)))) if long else ""
    day = released(row["released"])
    return {"title": title, "version": version, "kind": kind, "core": core, "rest": rest, "surname": surname, "album": album, "year": day[0] if day else None, "month": day[1] if day else 0, "day": day[2] if day else 0, "secs": seconds(row["track_time"])}


def shared_grams(text: str, least: float = 0.6) -> list[str]:
    """Q-grams of a text of which two texts with a Dice score of at least
    ``least`` share one: those have at least ``least / (2 - least)`` of either's
    q-grams in common, so in any fixed order as many of the last ones may be
    left out, but one."""
    every = sorted(grams(text), key=lambda g: (zlib.crc32(g.encode()), g))
    return every[: len(every) - math.ceil(least / (2 - least) * len(every)) + 1]


def song_codes(f: dict, left: bool) -> list[tuple[dict[str, str], list[str]]]:
    """Attributes that are encoded together, any two of title, artist and album,
    with values of which a pair that ``song_pair`` doesn't refute shares one:
    times within 6 seconds or, if one side has none, a year or alike albums."""
    known = [(tag, f[name]) for tag, name in (("t", "title"), ("a", "surname"), ("b", "album")) if f[name]]
    other = [f"b{g}" for g in shared_grams(f["album"])] + ([f"y{f['year']}"] if f["year"] else [])
    own, them = ("L", "R") if left else ("R", "L")
    if f["secs"] is None:
        met = [own + o for o in other] + [them + o for o in other]
    else:
        met = [f"s{n}" for n in ([f["secs"] // 6] if left else [f["secs"] // 6 + d for d in (-1, 0, 1)])] + [them + o for o in other]
    return [(dict(two), met) for i, one in enumerate(known) for two in ((one, more) for more in known[i + 1 :])]


def song_pair(a: dict, b: dict, known: Words) -> tuple[float, bool]:
    """``(weighted Dice score, refuted)``."""
    near = [(0.35, dice(a["title"], b["title"]))]
    artists = None
    if a["kind"] and b["kind"]:
        same = a["kind"] == b["kind"] and (same_person(a["rest"], b["rest"], 0.78, known) if a["kind"] == "p" else same_organisation(a["core"], a["rest"], b["core"], b["rest"], 0.78))
        artists = 1.0 if same else dice(a["core"] + a["rest"], b["core"] + b["rest"])
        near.append((0.3, artists))
    albums = dice(a["album"], b["album"]) if a["album"] and b["album"] else None
    if albums is not None:
        near.append((0.1, albums))
    times = abs(a["secs"] - b["secs"]) if a["secs"] is not None and b["secs"] is not None else None
    if times is not None:
        near.append((0.2, max(0.0, 1 - times / 8)))
    years = a["year"] == b["year"] if a["year"] and b["year"] else None
    if years is not None:
        near.append((0.05, float(years)))
    score = sum(w * d for w, d in near) / sum(w for w, _ in near)
    against = a["version"] != b["version"] or near[0][1] < 0.6 or (times is not None and times > 4) or (artists is not None and artists < 0.75) or years is False
    if times is None:
        against = against or not (albums is not None and albums >= 0.6 or years)
    if artists is None:
        against = against or times is None or not (albums is not None and albums >= 0.6)
    if albums is not None and albums < 0.3 and not (times is not None and years):
        against = True
    return score, against


def product(row: dict, known: Catalogue = HOUSEHOLD) -> dict:
    f = features(row["name"], row["description"], row["price"], known)
    # a model tells the product, so rows that differ in price and words only are one
    return f | {"price": None, "~price": f["price"], "words": []} if f["models"] else f


def product_codes(f: dict, left: bool) -> list[tuple[dict[str, str], list[str]]]:
    """Models, their digits with the brand, and what else is stated; the latter
    only meets where a side states no model."""
    codes: list[tuple[dict[str, str], list[str]]] = []
    for m in f["models"]:
        codes.append(({"m": m}, ["m"]))
        if f["brand"]:
            codes.append(({"d": re.sub(r"\D", "", m), "b": sounded(f["brand"])}, ["d"]))
    stated = f["colour"] + f["kind"] + f["accessory"]
    if f["brand"]:
        one = [f"{'lr'[left]}1"] if f["models"] else [f"{'rl'[left]}1", "0"]
        for k, v in f["sizes"] or [("", 0.0)]:
            codes.append(({"b": sounded(f["brand"]), "x": f"{stated}{k}{v:.2g}"}, one))
        if f["words"] and not f["kind"]:
            codes.append(({"b": sounded(f["brand"]), "w": " ".join(f["words"])}, one))
    return codes


def product_pair(a: dict, b: dict) -> tuple[float, bool]:
    a, b = (f | {"price": f["price"] or f.get("~price")} for f in (a, b))
    near = [(0.25, dice(sounded(a["brand"]), sounded(b["brand"])))]
    if a["models"] and b["models"]:
        near.append((0.4, max(dice(m, n) for m in a["models"] for n in b["models"])))
    for k, w in (("colour", 0.1), ("kind", 0.1)):
        if a[k] and b[k]:
            near.append((w, dice(a[k], b[k])))
    if {k for k, _ in a["sizes"]} & {k for k, _ in b["sizes"]}:
        near.append((0.1, float(not other_sizes(a["sizes"], b["sizes"]))))
    words = dice(" ".join(a["words"]), " ".join(b["words"])) if a["words"] and b["words"] else None
    if words is not None:
        near.append((0.2, words))
    if a["price"] and b["price"]:
        near.append((0.05, max(0.0, 1 - abs(math.log(a["price"] / b["price"])) * 2)))
    against = refuted(a, b)
    if not (a["models"] and b["models"]):
        price = same_price(a["price"], b["price"])
        if a["kind"] or b["kind"]:
            against = against or not (a["brand"] and b["brand"] and a["kind"] == b["kind"] and a["colour"] and b["colour"] and a["sizes"] and b["sizes"] and price)
        else:
            against = against or price is False or words is None or words < 0.7 or len(set(a["words"] + [a["brand"]]) & set(b["words"] + [b["brand"]])) < 3
    return sum(w * d for w, d in near) / sum(w for w, _ in near), against


def calibration(scored: DataFrame, bins: int = 50) -> list[float]:
    """Confidence of each range of scores.

    Pairs that stated values refute are known not to match; their scores tell
    how scores of chance pairs are distributed.  The share of such pairs among
    the rest is bounded by the ranges with the fewest rest for them, so what a
    range holds beyond its part of chance pairs are matches.  Confidences never
    fall with the score.  ``bins`` rows reach the driver."""
    rest, chance = np.zeros(bins), np.zeros(bins)
    for r in scored.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "refuted").agg(F.count(F.lit(1)).alias("n")).collect():
        (chance if r.refuted else rest)[r.bin] += r.n
    smooth = (rest + 1) / (chance + 1)
    scale = min(1.0, smooth.min())
    found = 1 - np.minimum(1, scale * chance / np.maximum(rest, 1e-9))
    found[rest == 0] = 0
    # a range's confidence also can't exceed what its score itself says
    found = np.minimum(np.maximum.accumulate(found), (np.arange(bins) + 1) / bins)
    return found.tolist()


def match_records(left: DataFrame, left_key: str, right: DataFrame, right_key: str, columns: list[str], describe: Callable[[dict], dict], codes: Callable[[dict, bool], list[tuple[dict[str, str], list[str]]]], compare: Callable[[dict, dict], tuple[float, bool]], min_confidence: float = 0.5, expand: int | None = 64, tile: int = 512) -> DataFrame:
    """``left_key, right_key, score, confidence`` of rows that mean the same.

    ``describe`` turns a row (the given columns) into attributes (numbers whose
    name begins with ``~`` don't make rows different, the largest counts), ``codes``
    names those that are encoded together as 256 bits of their q-grams, and all
    pairs of vectors within 15 bits are found exactly by multi-index hashing
    over the distinct vectors.  With each it gives values of which any pair that
    ``compare`` would keep shares at least one, so that even a vector which a
    third of all rows have does not pair them all.  ``compare`` gives the field-weighted Dice score of
    a pair and whether stated values refute it; scores become confidences by
    ``calibration``.

    Rows that say the same are compared once and all of them are matched, in
    salted tiles of ``tile`` keys; of more than ``expand`` rows with one and the
    same text the smallest key stands for the others, of any number none does if
    ``expand`` is None.  Defined results: null keys and
    rows whose encoded attributes are all missing match nothing; repeated rows
    of a key count once (the largest values); empty in, empty out; other
    columns are ignored.
    """
    import json

    def side(df: DataFrame, key: str, is_left: bool) -> tuple[DataFrame, DataFrame]:
        rows = df.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("string").alias(c) for c in columns]).where("key is not null")
        rows = rows.groupBy("key").agg(F.max(F.struct(*columns)).alias("r")).select("key", "r.*")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said, loose, bits = [], [], []
                for row in batch.select(columns).to_pylist():
                    f = describe(row)
                    said.append(json.dumps({k: v for k, v in f.items() if k[0] != "~"}, sort_keys=True))
                    loose.append([(k, float(v)) for k, v in f.items() if k[0] == "~" and v is not None])
                    bits.append([{"bits": as_longs(bit_vector(c)), "met": met} for c, met in codes(f, is_left)])
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text"), pa.array(said, pa.string()), pa.array(loose, pa.map_(pa.string(), pa.float64())), pa.array(bits, coded)], names=["key", "text", "said", "loose", "codes"])

        coded = pa.list_(pa.struct([("bits", pa.list_(pa.int64())), ("met", pa.list_(pa.string()))]))
        rows = rows.withColumn("text", F.md5(F.to_json(F.struct(*columns))))
        encoded = staged(rows.mapInArrow(encode, "key long, text string, said string, loose map<string,double>, codes array<struct<bits:array<long>,met:array<string>>>"), "encoded")
        groups = staged(encoded.groupBy("said").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("n"), F.max(F.struct(F.try_element_at(F.map_values("loose"), F.lit(1)).alias("most"), F.to_json("loose").alias("loose"))).alias("l"), F.first("codes").alias("codes")), "encoded")
        groups = groups.withColumn("loose", F.col("l.loose")).drop("l")
        members = encoded.select("key", "text", "said")
        if expand is not None:
            texts = members.groupBy("said", "text").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
            members = members.join(texts, ["said", "text"]).where((F.col("copies") <= expand) | (F.col("key") == F.col("first")))
        tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
        members = members.join(groups.select("said", "id", "n"), "said").select("id", "key", F.pmod(F.xxhash64("key"), tiles).cast("int").alias("tile"))
        groups = groups.withColumn("tiles", tiles)
        return groups, members

    (a, a_members), (b, b_members) = side(left, left_key, True), side(right, right_key, False)

    def vectors(groups: DataFrame) -> DataFrame:
        return groups.select("id", F.explode("codes").alias("c")).select("id", "c.bits", "c.met").withColumn("v", F.xxhash64("bits"))

    va, vb = vectors(a), vectors(b)
    close = staged(hamming_pairs(va.select(F.col("v").alias("id"), "bits").dropDuplicates(["id"]), vb.select(F.col("v").alias("id"), "bits").dropDuplicates(["id"])), "close")
    x = va.select(F.col("v").alias("l"), F.col("id").alias("a"), F.explode(F.array_distinct("met")).alias("bucket"))
    y = vb.select(F.col("v").alias("r"), F.col("id").alias("b"), F.explode(F.array_distinct("met")).alias("bucket"))
    pairs = close.join(x, "l").join(y, ["r", "bucket"]).select("a", "b").distinct()
    both = pairs.join(a.select(F.col("id").alias("a"), F.col("said").alias("fa"), F.col("loose").alias("la")), "a").join(b.select(F.col("id").alias("b"), F.col("said").alias("fb"), F.col("loose").alias("lb")), "b").select("a", "b", "fa", "fb", "la", "lb")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = memo(json.loads)  # one row is in many pairs
        for batch in batches:
            told = [compare(read(p) | read(x or "{}"), read(q) | read(y or "{}")) for p, q, x, y in zip(*(batch.column(c).to_pylist() for c in ("fa", "fb", "la", "lb")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([t[0] for t in told], pa.float64()), pa.array([t[1] for t in told], pa.bool_())], names=["a", "b", "score", "refuted"])

    scored = staged(both.mapInArrow(score, "a long, b long, score double, refuted boolean"), "scored")
    known = calibration(scored)
    bin_ = F.least(F.floor(F.col("score") * len(known)), F.lit(len(known) - 1)).cast("int")
    kept = scored.where("not refuted").withColumn("confidence", F.array(*[F.lit(c) for c in known])[bin_]).where(F.col("confidence") >= min_confidence)
    # every tile of a class meets every tile of the other
    for name, groups in (("a", a), ("b", b)):
        kept = kept.join(groups.select(F.col("id").alias(name), "tiles"), name).withColumn(f"{name}_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    rows = kept.join(a_members.select(F.col("id").alias("a"), F.col("tile").alias("a_tile"), F.col("key").alias("left_key")), ["a", "a_tile"])
    rows = rows.join(b_members.select(F.col("id").alias("b"), F.col("tile").alias("b_tile"), F.col("key").alias("right_key")), ["b", "b_tile"])
    return rows.select("left_key", "right_key", "score", "confidence")


def match_songs(left: DataFrame, right: DataFrame, expand: int | None = 64, words: Words | None = None) -> DataFrame:
    """``match_records`` of songs; what words mean in names of bands is learned
    from all artists of both tables unless ``words`` tells it."""
    if words is None:
        artists = left.select("artist_name").union(right.select("artist_name")).distinct().select(F.lit("artist").alias("g"), "artist_name", F.lit("?").alias("k"))
        words = learned_words(artists, "g", "artist_name", "k").get("artist", Words())
    return match_records(left, "sno_left", right, "sno_right", ["album_name", "artist_name", "released", "song_name", "track_time"], partial(song, known=words), song_codes, partial(song_pair, known=words), expand=expand)


def match_products(left: DataFrame, right: DataFrame, expand: int | None = 64) -> DataFrame:
    return match_records(left, "id_abt", right, "id_buy", ["name", "description", "price"], product, product_codes, product_pair, expand=expand)
