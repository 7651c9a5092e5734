"""Product listings describing the same item (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semframe.llm.names import alike, folded, spelled_alike
from semframe.memo import memo
from semframe.operators.tiles import pairs_within
from semframe.runtime import staged

# fixed values: colours, their short forms and their usual shades
COLOURS = {"black": "black blk jet black", "white": "white wht pure white", "silver": "silver slv metallic silver", "red": "red rd cherry red", "blue": "blue blu ocean blue", "green": "green grn", "grey": "grey gray gry", "gold": "gold gld", "pink": "pink pnk", "brown": "brown brn", "yellow": "yellow ylw", "purple": "purple prp", "orange": "orange org", "beige": "beige"}
# fixed values: names of kinds of goods that mean the same
KINDS = {
    "television": ("lcd tv", "hdtv", "flat panel television", "lcd television", "television", "tv"),
    "speaker": ("bookshelf speaker", "2-way speaker", "loudspeaker", "speaker system", "speaker"),
    "hdmi cable": ("hdmi cable", "hdmi cord", "hdmi interconnect"),
    "microwave": ("microwave oven", "countertop microwave", "microwave"),
    "drive": ("external hard drive", "usb disk", "portable drive", "ext. hdd", "ext hdd", "hard drive", "hdd"),
    "camera": ("digital camera", "digicam", "compact camera", "camera"),
    "kettle": ("electric kettle", "water kettle", "cordless kettle", "kettle"),
    "luggage": ("trolley case", "travel suitcase", "luggage spinner", "suitcase"),
}
ACCESSORIES = ("wall mount", "replacement remote", "spare lid", "carrying case", "remote", "lid", "case", "mount", "charger", "adapter", "battery", "cover", "stand", "filter")
# fixed values: words of offers that say nothing about the product
MARKETING = ("2-year warranty", "special edition deal", "limited offer", "factory sealed", "free shipping", "best price", "hot deal", "top rated", "in stock", "brand new", "new", "sale")
# fixed values: units with the dimension and the factor to its base unit
UNITS = {"w": ("power", 1), "watt": ("power", 1), "watts": ("power", 1), "kw": ("power", 1000), "g": ("weight", 1), "gram": ("weight", 1), "grams": ("weight", 1), "kg": ("weight", 1000), "lb": ("weight", 453.6), "lbs": ("weight", 453.6), "gb": ("store", 1), "tb": ("store", 1000), "mm": ("length", 0.1), "cm": ("length", 1), "m": ("length", 100), "ft": ("length", 30.48), "feet": ("length", 30.48), "inch": ("length", 2.54), "inches": ("length", 2.54), "in": ("length", 2.54), '"': ("length", 2.54), "l": ("volume", 1), "liter": ("volume", 1), "litre": ("volume", 1), "liters": ("volume", 1), "ml": ("volume", 0.001), "mp": ("pixels", 1), "mpix": ("pixels", 1), "megapixel": ("pixels", 1), "megapixels": ("pixels", 1)}
SIZE = re.compile(r"(\d+(?:[.,]\d+)?)[ -]?(" + "|".join(sorted((re.escape(u) for u in UNITS), key=len, reverse=True)) + r")(?![a-z0-9])(?:[ -]class)?")
MODEL = re.compile(r"(?<![a-z0-9])([a-z]{2,4})[ -]{0,2}(\d{2})-?(\d{2})([a-z]?)(?![a-z0-9])")
LOOSE = re.compile(r"(?<![a-z0-9])(?=[a-z0-9-]*[a-z])(?=[a-z0-9-]*\d)([a-z][a-z0-9]*(?:-[a-z0-9]+)*)(?![a-z0-9])")
MARKED = re.compile(r"(?:mfr\.? part|model|item no\.?)\s+([a-z0-9][a-z0-9 -]*)")
NUMBER = re.compile(r"(?<!\d)\d(?:[ -]?\d){7,12}(?!\d)")  # articles known by a long number
PRICE = re.compile(r"\d+(?:[.,]\d{3})*(?:[.,]\d{1,2})?")


def _any_of(phrases: Iterable[str], before: str = "(?<![a-z])", after: str = "(?![a-z])") -> re.Pattern:
    """One of the phrases as a whole, the longest first."""
    return re.compile(f"{before}({'|'.join(map(re.escape, sorted(phrases, key=len, reverse=True))) or '(?!)'}){after}")


class Catalogue:
    """Words that mean the same in a catalogue: colours and kinds of goods with
    their other names, accessories, and offers that say nothing of the product.
    Any of them may be empty: names are then told apart by their own words."""

    def __init__(self, colours: dict[str, str] | None = None, kinds: dict[str, Iterable[str]] | None = None, accessories: Iterable[str] | None = None, offers: Iterable[str] | None = None):
        colours, kinds = COLOURS if colours is None else colours, KINDS if kinds is None else kinds
        self.accessories, offers = tuple(ACCESSORIES if accessories is None else accessories), tuple(MARKETING if offers is None else offers)
        self.colours = {s: name for name, shorts in colours.items() for s in shorts.split()}
        self.kinds = {s: k for k, shorts in kinds.items() for s in shorts}
        self.kind, self.accessory, self.main = _any_of(self.kinds), _any_of(self.accessories), _any_of(self.accessories[:4])
        self.offer, self.colour = _any_of(offers, after="!?(?![a-z])"), re.compile("[a-z]+")
        self.vocabulary = frozenset(w for phrase in [*self.kinds, *self.accessories, *offers, *self.colours] for w in re.findall(r"[a-z]{3,}", phrase))
        self.vocabulary_like = memo(self._vocabulary_like)

    def _vocabulary_like(self, word: str) -> bool:
        """A word of kinds, offers or colours, rightly spelled or with a slip."""
        return any(abs(len(v) - len(word)) <= 2 and alike(word, v) >= 0.8 for v in self.vocabulary)

    def kind_of(self, text: str) -> tuple[str, str]:
        """``(kind, accessory)``; an accessory is for a kind of goods and isn't one."""
        kind = max(self.kind.findall(text), key=len, default="")
        named = (self.accessory if re.search(r"\bfor\b", text) else self.main).findall(text)
        return self.kinds.get(kind, ""), next((a for a in self.accessories if a in named), "")


HOUSEHOLD = Catalogue()


def price_of(text: str | None) -> float | None:
    found = PRICE.search(text or "")
    if not found:
        return None
    digits = found[0]
    if re.search(r"[.,]\d{1,2}$", digits):
        whole, cents = re.split(r"[.,](?=\d{1,2}$)", digits)
        return float(re.sub(r"\D", "", whole) + "." + cents)
    return float(re.sub(r"\D", "", digits))


def sizes_of(text: str) -> list[tuple[str, float]]:
    return [(UNITS[unit][0], float(number.replace(",", ".")) * UNITS[unit][1]) for number, unit in SIZE.findall(text)]


def features(name: str | None, description: str | None, price: str | None, known: Catalogue = HOUSEHOLD) -> dict:
    """What a listing says: brand, models, sizes, colour, kind, accessory, price
    and the other words of its name."""
    title = known.offer.sub(" ", folded(name or ""))
    body = known.offer.sub(" ", re.sub(r"<[^>]*>", " ; ", folded(description or "")))
    title, body = re.sub(r"\s+", " ", title), re.sub(r"ships in \d+ days?", " ", re.sub(r"\s+", " ", body))
    kind, accessory = known.kind_of(title)
    if not kind or not accessory:
        told = known.kind_of(body)
        kind, accessory = kind or told[0], accessory or told[1]
    sizes = sizes_of(title) + sizes_of(body)
    bare = SIZE.sub(" ", title)
    models = {"".join(m) for m in MODEL.findall(bare)}
    marked = " ".join(MARKED.findall(body))
    models |= {"".join(m) for m in MODEL.findall(marked)}
    bare = known.kind.sub(" ", bare)
    if not models:
        models = {m.replace("-", "") for m in LOOSE.findall(bare) if sum(c.isdigit() for c in m) >= 3} | {re.sub(r"\D", "", n) for n in NUMBER.findall(bare)}
    plain = LOOSE.sub(" ", MODEL.sub(" ", bare))
    colour = next((c for text in (plain, LOOSE.sub(" ", MODEL.sub(" ", body))) for w in known.colour.findall(text) if (c := known.colours.get(w))), "")
    brand = next(iter(re.findall(r"(?:made by|(?<= )by) ([a-z]+)", body) or re.findall(r"\bby ([a-z]+)", title)), "")
    in_title = [w for w in re.findall(r"[a-z]{4,}", MODEL.sub(" ", bare)) if not known.vocabulary_like(w)]
    if in_title and (not brand or brand not in in_title):
        near = [w for w in in_title if brand and spelled_alike(brand, w) >= 0.75]
        brand = near[0] if near else brand or in_title[0]
    words = {w for w in re.findall(r"[^\W_]+", plain) if w not in known.vocabulary and w != brand and w not in models}
    return {"brand": brand, "models": sorted(models), "sizes": sorted(set(sizes)), "colour": colour, "kind": kind, "accessory": accessory, "price": price_of(price), "words": sorted(words)}


def same_brand(a: str, b: str) -> bool:
    return not a or not b or spelled_alike(a, b) >= 0.75


def slipped(a: str, b: str) -> bool:
    """Whether two different models may be one with a slip of the keys: a
    character left out or put in before the end, or a letter for a digit.
    Another digit or another ending is another model."""
    if abs(len(a) - len(b)) == 1:
        a, b = sorted((a, b), key=len)
        at = next((i for i, c in enumerate(a) if c != b[i]), len(a))
        return at < len(a) and a[at:] == b[at + 1 :]
    apart = [(x, y) for x, y in zip(a, b) if x != y]
    return len(a) == len(b) and len(apart) == 1 and apart[0][0].isdigit() != apart[0][1].isdigit()


def other_sizes(a: list[tuple[str, float]], b: list[tuple[str, float]]) -> bool:
    """Whether two listings state a dimension both, and no value of it alike."""
    apart = {}
    for k, v in a:
        for j, w in b:
            if j == k and v and w:
                apart[k] = apart.get(k, True) and not 0.96 < v / w < 1.04
    return any(apart.values())


def same_price(a: float | None, b: float | None) -> bool | None:
    return 0.88 < a / b < 1.14 if a and b else None


def refuted(a: dict, b: dict) -> bool:
    """Stated values that two listings of one product can't differ in."""
    if a["accessory"] != b["accessory"] or (a["kind"] and b["kind"] and a["kind"] != b["kind"]) or (a["colour"] and b["colour"] and a["colour"] != b["colour"]):
        return True
    if other_sizes(a["sizes"], b["sizes"]) or not same_brand(a["brand"], b["brand"]):
        return True
    if a["models"] and b["models"] and not set(a["models"]) & set(b["models"]):
        # a slip, where everything else agrees
        stated = a["brand"] == b["brand"] and a["brand"] and a["kind"] and b["kind"] and a["colour"] and b["colour"]
        return not stated or same_price(a["price"], b["price"]) is False or not any(slipped(m, n) for m in a["models"] for n in b["models"])
    return False


def tokens(f: dict) -> list[str]:
    """Normalised tokens: what is stated (``m b c k a s``), any three attributes
    together (``x``) and other words (``w``)."""
    out = [f"m:{m}" for m in f["models"]]
    out += [f"{k[0]}:{f[k]}" for k in ("brand", "colour", "kind", "accessory") if f[k]]
    out += [f"s:{k}:{v:.2g}" for k, v in f["sizes"]] + [f"w:{w}" for w in f["words"]]
    stated = [f"{k[0]}:{f[k]}" for k in ("brand", "colour", "kind") if f[k]]
    for values in [stated] + [[*stated[:i], *stated[i + 1 :], f"s:{k}:{v:.2g}"] for i in range(3) for k, v in f["sizes"]]:
        if len(values) == 3:
            out.append("x:" + "|".join([*values, f["accessory"]]))
    return sorted(set(out))


FEATURES = "struct<brand:string,models:array<string>,sizes:array<struct<kind:string,value:double>>,colour:string,kind:string,accessory:string,price:double,words:array<string>>"


def parsed_listings(df: DataFrame, key: str, known: Catalogue = HOUSEHOLD) -> DataFrame:
    """``id, text, f, tokens`` of each listing; a repeated key counts once."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col("name").cast("string"), F.col("description").cast("string"), F.col("price").cast("string")).where("id is not null")
    rows = rows.groupBy("id").agg(F.max(F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"), "price")).alias("r")).select("id", "r.*", F.md5(F.to_json("r")).alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("brand", pa.string()), ("models", pa.list_(pa.string())), ("sizes", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.float64())]))), ("colour", pa.string()), ("kind", pa.string()), ("accessory", pa.string()), ("price", pa.float64()), ("words", pa.list_(pa.string()))])
        for batch in batches:
            found = [features(*r, known) for r in zip(*(batch.column(c).to_pylist() for c in ("name", "description", "price")))]
            told = [f | {"sizes": [{"kind": k, "value": v} for k, v in f["sizes"]]} for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(told, kind), pa.array([tokens(f) for f in found], pa.list_(pa.string()))], names=["id", "text", "f", "tokens"])

    return rows.mapInArrow(parse, f"id long, text string, f {FEATURES}, tokens array<string>")


def _plain(f: dict) -> dict:
    return f | {"sizes": [(s["kind"], s["value"]) for s in f["sizes"]]}


def star_clusters(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, star``: nodes of many links become centres of their unassigned
    neighbours; no node is in two stars.  ``links`` is ``a, b``, both ways."""
    left, out = staged(links.select("a", "b").distinct(), "stars"), None
    for _ in range(max_rounds):
        degree = left.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        rank = F.struct(F.col("n"), -F.col("a"))
        ranked = degree.select("a", rank.alias("rank"))
        beside = left.join(ranked.select(F.col("a").alias("b"), F.col("rank").alias("theirs")), "b").groupBy("a").agg(F.max(F.struct("theirs", "b")).alias("best"))
        both = ranked.join(beside, "a")
        centres = both.where("rank > best.theirs").select(F.col("a").alias("centre"))
        taken = left.join(centres, left.b == centres.centre).join(ranked.select(F.col("a").alias("centre"), "rank"), "centre").groupBy("a").agg(F.max(F.struct("rank", "centre")).alias("c")).select(F.col("a").alias("node"), F.col("c.centre").alias("star"))
        round_ = staged(taken.union(centres.select(F.col("centre").alias("node"), F.col("centre").alias("star"))), "stars")
        out = round_ if out is None else out.union(round_)
        done = round_.select("node")
        left = staged(left.join(done, left.a == done.node, "left_anti").join(done, left.b == done.node, "left_anti"), "stars")
        if not left.limit(1).count():
            return out
    raise RuntimeError("stars did not settle")


def same_listings(listings: list[tuple[DataFrame, str]], containment: float = 0.5, words_alike: float = 0.8, expand: int = 64, tile: int = 512, known: Catalogue = HOUSEHOLD) -> DataFrame:
    """``id_a, id_b``: listings of one product, within and across tables.

    ``listings`` are tables with ``name, description, price`` and the name of
    their id; ids don't overlap.  Names and descriptions become normalised
    tokens (model, brand, sizes in base units, colour, kind, accessory, other
    words), without words of offers; ``known`` says which words mean the same.
    Tokens are weighted and ordered by rarity over all listings.  Prefix filter:
    a pair whose shared weight is at least ``containment`` of the lighter listing
    shares a token of that listing's prefix, the tokens before the rest weighs
    less than that; a positional filter bounds the weight both have left from
    that token on, a length filter the lighter listing's weight.  Of two listings
    that state models the shared model heads both prefixes; where one states
    none its prefix holds its rarest words and triples of attributes; models
    with a slip of the keys meet on brand, kind and colour.  Candidates are
    verified by their exact weighted containment and by stated values that
    refute (another model, no size within 4 per cent, another colour, kind or
    accessory).  Without a model on both sides brand, kind, colour and size must
    agree, or, of goods whose kind isn't known, ``words_alike`` of the weight of
    the lighter listing's words, three of them or more; prices must then be
    within 12 per cent.  Star clustering then groups listings.

    Listings that say the same are one class and compared once; all of a star are
    paired, in salted tiles of ``tile`` listings.  Only copies of one text (name,
    description and price) are, beyond ``expand`` of them, paired with the first
    of them, which stands for them elsewhere.  Defined results:
    null or empty names and descriptions give few or no tokens and no pair;
    prices that are no numbers are missing; repeated rows of an id count once;
    empty in, empty out; other columns are ignored.
    """
    parsed = None
    for df, key in listings:
        part = parsed_listings(df, key, known)
        parsed = part if parsed is None else parsed.union(part)
    parsed = staged(parsed, "listings")
    # a model tells the product, so its listings differ by price and words only within a class
    bare = F.size("f.models") == 0
    said = F.to_json(F.col("f").withField("price", F.when(bare, F.col("f.price"))).withField("words", F.when(bare, F.col("f.words"))))
    told = parsed.where(F.size("tokens") > 0).withColumn("said", said)
    reps = staged(told.groupBy("said").agg(F.min("id").alias("rep"), F.max("f.price").alias("price")), "listings")
    copies = told.groupBy("said", "text").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    members = told.select("id", "said", "text").join(copies, ["said", "text"]).join(reps, "said").select("id", "rep", "first", "n")
    heads = parsed.join(reps.select(F.col("rep").alias("id"), F.col("price").alias("most")), "id")
    heads = staged(heads.select("id", F.col("f").withField("price", F.col("most")).alias("f"), F.array_sort(F.col("f.models")).alias("models"), "tokens"), "listings")
    exploded = heads.select("id", (F.size("models") == 0).alias("bare"), F.explode("tokens").alias("token"))
    total = heads.count()
    counted = exploded.groupBy("token").agg(F.log(1 + F.lit(float(total)) / F.count(F.lit(1))).alias("w"))
    kind = F.substring("token", 1, 1)
    # rest is the weight from a token on, in the order of rarity; models first
    order = Window.partitionBy("id", "part").orderBy(F.desc(kind == "m"), F.desc("w"), "token").rowsBetween(0, Window.unboundedFollowing)

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rest", F.sum("w").over(order)).withColumn("whole", F.sum("w").over(Window.partitionBy("id", "part")))

    rare = exploded.join(counted, "token")
    # what is stated, for pairs with models, and words and triples, for the others
    weighed = staged(ordered(rare.withColumn("part", F.when(kind.isin("x", "w"), "w").otherwise("m"))), "tokens")
    probe = weighed.where(F.col("rest") >= F.col("whole") * F.lit(containment)).where((kind == "m") | F.col("bare") & kind.isin("x", "w"))
    index = weighed.select("token", F.col("id").alias("other"), F.col("rest").alias("rest_b"), F.col("whole").alias("whole_b"), F.col("bare").alias("bare_b"))
    met = probe.join(index, "token").where("id <> other")
    met = met.where((kind != "m") | (F.col("whole") <= F.col("whole_b") * 1.000001) & (F.least("rest", "rest_b") >= F.lit(containment) * F.col("whole") * 0.999999))
    pairs = met.select("id", "other")
    # slips: one edit between models of one brand, kind and colour
    alike_ = heads.where("size(models) > 0 and f.brand <> '' and f.kind <> '' and f.colour <> ''").select(F.xxhash64("f.brand", "f.kind", "f.colour", "f.accessory").alias("block"), "id", "models")
    near = pairs_within(staged(alike_, "blocks"), "block", "id", tile, ("models",)).where("not arrays_overlap(models, other_models) and exists(models, m -> exists(other_models, n -> levenshtein(m, n) = 1))")
    pairs = pairs.union(near.select("id", "other"))
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    heavy = weighed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("w"))  # a few tokens a listing
    told = heads.select("id", "f").join(heavy, "id")
    both = pairs.join(told.select(F.col("id").alias("a"), F.col("f").alias("fa"), F.col("w").alias("wa")), "a").join(told.select(F.col("id").alias("b"), F.col("f").alias("fb"), F.col("w").alias("wb")), "b")

    def contained(wa: dict, wb: dict, kinds: str) -> float:
        a, b = ({t: w for t, w in x.items() if t[0] in kinds} for x in (wa, wb))
        return sum(w for t, w in a.items() if t in b) / max(1e-9, min(sum(a.values()), sum(b.values())))

    def verified(a: dict, b: dict, wa: dict, wb: dict) -> bool:
        if refuted(a, b):
            return False
        if a["models"] and b["models"]:
            return not set(a["models"]) & set(b["models"]) or contained(wa, wb, "mbckas") >= containment
        price = same_price(a["price"], b["price"])
        if a["kind"] or b["kind"]:
            return bool(price and a["brand"] and b["brand"] and a["kind"] == b["kind"] and a["colour"] and a["colour"] == b["colour"] and a["sizes"] and b["sizes"])
        return price is not False and len(set(a["words"] + [a["brand"]]) & set(b["words"] + [b["brand"]])) >= 3 and contained(wa, wb, "wb") >= words_alike

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([verified(_plain(fa), _plain(fb), dict(wa), dict(wb)) for fa, fb, wa, wb in zip(*(batch.column(c).to_pylist() for c in ("fa", "fb", "wa", "wb")))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    links = staged(both.select("a", "b", "fa", "fb", "wa", "wb").mapInArrow(verify, "a long, b long"), "links")
    stars = star_clusters(links.union(links.select("b", "a")))
    placed = staged(members.join(stars, members.rep == stars.node, "left").select("id", "first", "n", F.coalesce("star", "rep").alias("star")), "groups")
    shown = placed.where((F.col("n") <= expand) | (F.col("id") == F.col("first"))).select("id", "star")
    inside = pairs_within(staged(shown, "groups"), "star", "id", tile).select(F.col("id").alias("id_a"), F.col("other").alias("id_b"))
    rest = placed.where((F.col("n") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    return inside.union(rest).distinct()
