"""Variant spellings of names typed by people (problem 2)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.memo import memo
from semframe.operators.components import connected_components
from semframe.operators.tiles import pairs_within
from semframe.runtime import staged

# fixed values: forms of address and what follows a name
TITLES = frozenset("mr mrs ms miss dr prof sir dame eng gen col maj capt rev hon lord lady jr sr ii iii iv alias phd md esq".split())
# fixed values: legal forms, joined without dots and blanks
LEGAL = frozenset("co company corp corporation inc incorporated ltd limited llc limitedliabilitycompany plc gmbh gesmbh ag kg sa sociedadanonima societeanonyme srl spa bv nv ooo oao zao llp lp ab oy as pty pte".split())
LEGAL_WORDS = (("limited", "liability", "company"), ("sociedad", "anonima"), ("societe", "anonyme"), ("ges", "m", "b", "h"), ("g", "m", "b", "h"), ("l", "l", "c"), ("o", "o", "o"), ("s", "a"), ("s", "r", "l"))
# fixed values: short forms of given names
NICKNAMES = {
    short: name
    for name, shorts in {
        "abigail": "abby abbie gail", "alexander": "alex sasha sandro lex", "andrew": "drew andy", "anthony": "tony", "benjamin": "ben benny", "charles": "charlie chuck chas", "christopher": "chris kit topher", "daniel": "dan danny",
        "deborah": "deb debbie debby", "dolores": "lola lolita", "dmitri": "dima mitya", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty lizzie eliza bess libby", "francisco": "paco pancho frank", "frederick": "fred freddie rick",
        "friedrich": "fritz", "giuseppe": "beppe peppe", "gregory": "greg", "heinrich": "heinz", "ignacio": "nacho", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans", "katherine": "kate kathy katie kat kitty",
        "lawrence": "larry lars", "margaret": "peggy meg maggie marge", "matthew": "matt", "michael": "mike mick mickey", "mikhail": "misha", "nicholas": "nick nico nicky", "patricia": "pat patty tricia trish", "pamela": "pam", "philip": "phil",
        "rebecca": "becky becca", "richard": "dick rich richie rick", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "stephen": "steve stevie", "susan": "sue susie suzy", "theodora": "dora thea", "thomas": "tom tommy", "timothy": "tim timmy",
        "victoria": "vicky tori vic", "vladimir": "vova volodya vlad", "walter": "walt wally", "william": "bill will billy liam", "yekaterina": "katya", "zachary": "zach zack", "natalia": "natasha tasha", "aleksandra": "sasha", "olga": "olya",
        "joseph": "joe joey", "john": "jack johnny", "barbara": "barb", "jonathan": "jon", "leonard": "leo len", "raymond": "ray", "ronald": "ron", "sandra": "sandy",
    }.items()
    for short in shorts.split()
}


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("ł", "l")) if not unicodedata.combining(c)).casefold()


@memo
def sounded(token: str) -> str:
    """Spellings of one sound made one, doubled letters single."""
    for a, b in (("phph", "f"), ("ph", "f"), ("ck", "k"), ("c", "k"), ("z", "s"), ("w", "v"), ("y", "i"), ("q", "k")):
        token = token.replace(a, b)
    return re.sub(r"(.)\1", r"\1", token)


@memo
def alike(a: str, b: str) -> float:
    """Longest common subsequence against the mean length."""
    if a == b:
        return 1.0
    if not a or not b or 2 * min(len(a), len(b)) < 0.7 * (len(a) + len(b)):
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def spelled_alike(a: str, b: str) -> float:
    near = alike(a, b)
    return near if near >= 0.98 else max(near, 0.98 * alike(sounded(a), sounded(b)))


class Words:
    """What a collection of names tells of its words: ``common`` words that many
    organisations, bands or ships have in their names, and ``given`` names."""

    def __init__(self, common: Iterable[str] = (), given: Iterable[str] = ()):
        self.common = tuple(sorted(common))
        self.given = frozenset(NICKNAMES.values()) | frozenset(given)
        self.common_word, self.given_like = memo(self._common_word), memo(self._given_like)

    def _common_word(self, token: str) -> str | None:
        """The common word a token is, shortens or misspells."""
        if token in self.common:
            return token
        if len(token) >= 3:
            starts = [w for w in self.common if w.startswith(token)]
            if starts:
                return min(starts, key=len)
            if len(token) <= 6:
                for w in self.common:
                    if w[0] == token[0] and len(token) < len(w):
                        rest = iter(w)
                        if all(c in rest for c in token) and token[-1] in w[-2:]:
                            return w
        if len(token) >= 4:
            near = [(alike(token, w), w) for w in self.common if w[0] == token[0] or w[-3:] == token[-3:]]
            if near and max(near)[0] >= 0.82:
                return max(near)[1]
        return None

    def _given_like(self, token: str) -> bool:
        """A given name, rightly spelled or with a slip."""
        return token in self.given or len(token) >= 5 and any(abs(len(g) - len(token)) <= 1 and alike(token, g) >= 0.85 for g in self.given)


def learned_words(names: DataFrame, group: str, name: str, kind: str, common_share: float = 0.01, given_share: float = 0.001, least: int = 20) -> dict[str, Words]:
    """The words of each group, from all its names: common are words in at least
    ``common_share`` of the names that aren't known as persons' which seldom open
    a name, given are words that open most of the persons' names they stand in
    and stand in at least ``given_share`` of them; given names of one group are
    given names in all.  They stand in at least ``least`` names, given ones in
    half of that, so at most a few words a share reach the driver."""
    words = F.filter(F.split(F.lower(F.regexp_replace(name, r"\([^)]*\)", " ")), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*LEGAL, *TITLES, "the", "thee", "and"))
    rows = names.select(F.col(group).alias("g"), F.coalesce(kind, F.lit("?")).alias("k"), words.alias("words")).where("size(words) > 0")
    sizes = rows.groupBy("g").agg(F.sum((F.col("k") != "p").cast("long")).alias("others"), F.sum((F.col("k") != "o").cast("long")).alias("people"))
    seen = rows.select("g", "k", F.element_at("words", 1).alias("first"), F.explode(F.array_distinct("words")).alias("w"))
    first = (F.col("w") == F.col("first")).cast("long")
    counts = [F.sum(x).alias(n) for n, x in (("n", (F.col("k") != "p").cast("long")), ("opens", F.when(F.col("k") != "p", first).otherwise(0)), ("people_n", (F.col("k") != "o").cast("long")), ("people_opens", F.when(F.col("k") != "o", first).otherwise(0)))]
    seen = seen.groupBy("g", "w").agg(*counts).join(sizes, "g")
    seen = seen.select("g", "w", F.expr(f"n >= {least} and n >= {common_share} * others and 2 * opens < n").alias("common"), F.expr(f"2 * people_n >= {least} and people_n >= {given_share} * people and 2 * people_opens >= people_n").alias("given")).where("common or given")
    told: dict[str, tuple[set[str], set[str]]] = {}
    for r in seen.collect():
        common, given = told.setdefault(r.g, (set(), set()))
        (common if r.common else given).add(folded(r.w))
    given = frozenset().union(*(g for _, g in told.values()))
    return {g: Words(common, given - common) for g, (common, _) in told.items()}


def parse(name: str, kind: str, known: Words) -> tuple[str, str, str]:
    """``(kind, core, rest)``.  Of an organisation (kind ``o``) core is the own
    word and rest the common words in order; of a person (``p``) core is empty
    and rest the tokens, surname first where a comma tells it, initials marked
    by a dot."""
    plain = re.sub(r"\([^)]*\)", lambda m: " " + m[0][1:-1] + " ", folded(name))
    words = [w for w in re.split(r"[^\w]+|_", plain.replace("&", " ").replace("'", "")) if w]
    spelled = list(words)
    for legal in LEGAL_WORDS:
        n = len(legal)
        for i in range(len(words) - n, 0, -1):
            if tuple(words[i : i + n]) == legal:
                del words[i : i + n]
    kept = [w for w in words if w not in LEGAL and w not in ("the", "thee", "and", "of")]
    commons = [known.common_word(w) for w in kept]
    if kind == "p" or kind == "?" and not any(commons) and len(kept) == len([w for w in spelled if w not in ("the", "thee", "and", "of")]):
        return "p", "", " ".join(person_tokens(name))
    own = [w for w, c in zip(kept, commons) if c is None]
    return "o", "".join(own), " ".join(dict.fromkeys(c for c in commons if c))


def person_tokens(name: str) -> list[str]:
    """Given names in order, then the surname where a comma tells it; initials
    keep a dot."""
    text = re.sub(r"\([^)]*\)", " ", name)
    parts = text.split(",", 1)
    sides = []
    for part in parts:
        tokens: list[str] = []
        for word in re.split(r"[\s\-]+", part.strip()):
            clean = "".join(c for c in folded(word) if c.isalnum())
            if not clean or clean in TITLES:
                continue
            letters = [c for c in folded(word) if c.isalpha()]
            if "." in word.rstrip(".") or len(clean) == 1 or (word.endswith(".") and len(clean) <= 2) or (len(clean) == 2 and word.isupper() and any(len(w) > 2 for w in text.split())):
                tokens.extend(c + "." for c in letters)
            else:
                tokens.append(NICKNAMES.get(clean, clean))
        sides.append(tokens)
    return sides[1] + sides[0] if len(sides) > 1 and sides[1] else sides[0]


def surnames(tokens: list[str], known: Words) -> list[int]:
    """Where the surname may stand: any full token that isn't a given name,
    else the last full token."""
    full = [i for i, t in enumerate(tokens) if len(t) > 2]
    return [i for i in full if not known.given_like(tokens[i])] or full[-1:]


def same_given(a: str, b: str) -> bool:
    if a.endswith(".") or b.endswith("."):
        return a[0] == b[0]
    return a == b or (min(len(a), len(b)) >= 4 and max(alike(a, b), 0.98 * alike(sounded(a), sounded(b))) >= 0.78)


def same_person(a: str, b: str, least: float, known: Words) -> bool:
    """One surname in two spellings and first given names that go together."""
    x, y = a.split(), b.split()
    long = [(spelled_alike(x[i], y[j]), len(x[i]), i, j) for i in surnames(x, known) for j in surnames(y, known)]
    best = max(((s, n, i, j) for s, n, i, j in long if s >= least), default=None, key=lambda m: (m[1], m[0]))
    if best is None:
        return False
    given_x = [t for i, t in enumerate(x) if i != best[2]]
    given_y = [t for j, t in enumerate(y) if j != best[3]]
    if not given_x or not given_y:
        return not given_x and not given_y
    return same_given(given_x[0], given_y[0])


def same_organisation(core_a: str, rest_a: str, core_b: str, rest_b: str, least: float) -> bool:
    x, y = rest_a.split(), rest_b.split()
    if not core_a or not core_b or x and y and (x[0] != y[0] or len(x) > 1 and len(y) > 1 and x[1] != y[1]):
        return False
    near = spelled_alike(core_a, core_b)
    return near >= least and (bool(x) == bool(y) or near >= 0.9)


def compared(a: dict, b: dict, least: float, words: Words) -> bool:
    """Whether two parsed names mean the same; other fields may refute it."""
    if a["kind"] != b["kind"]:
        return False
    known = a["mark"] and b["mark"]
    if known and a["mark"] != b["mark"]:
        return False
    if known:
        least -= 0.06
    if a["kind"] == "p":
        return same_person(a["rest"], b["rest"], least, words)
    if not same_organisation(a["core"], a["rest"], b["core"], b["rest"], least):
        return False
    if known:
        return True
    years = a["year"] is not None and b["year"] is not None
    places = a["place"] and b["place"]
    against = (years and abs(a["year"] - b["year"]) > 3) + bool(places and a["place"] != b["place"])
    return against == 0 if a["core"] != b["core"] else against < 2


def block_keys(row: dict, least: int) -> list[tuple[str, str, str]]:
    """``(side, token, context)``: tokens whose suffixes are indexed, read
    forwards and, for errors near the end, in the mirror; the context is the
    initial of the token beside it or the first common word."""
    if row["kind"] == "o":
        tokens = [(sounded(row["core"]), row["rest"].split()[0] if row["rest"] else "")]
    else:
        all_tokens = row["rest"].split()
        # the first given name, else (of the first) the initials of the others
        tokens = [(sounded(t), o[0]) for i, t in enumerate(all_tokens) if len(t) > 2 for o in (all_tokens[:1] if i else all_tokens[1:] or [" "])]
    return list({(side, t if side == "s" else t[::-1], row["kind"] + c) for t, c in tokens if len(t) >= least for side in "sm"})


def outlines(row: dict, known: Words) -> list[tuple[str, str, str, str]]:
    """``(surname, its sound, first given name, its sound)`` for each token that
    may be the surname; of an organisation its own word and no given name."""
    if row["kind"] == "o":
        return [(row["core"], sounded(row["core"]), "", "")]
    tokens = row["rest"].split()
    out = []
    for i in surnames(tokens, known):
        given = next((t for j, t in enumerate(tokens) if j != i), "")
        out.append((tokens[i], sounded(tokens[i]), given, sounded(given)))
    return out


def near_outlines(least: float) -> str:
    """SQL: whether two names can be alike at all.  The edit distance of two
    words is at most their letters outside a common subsequence, so a ratio of
    at least r leaves no more than 1 - r of their letters."""

    def near(r: float, *columns: str) -> str:
        return " or ".join(f"levenshtein(x.{c}, y.{c}) <= {1 - bound:.6f} * (length(x.{c}) + length(y.{c})) + 1e-6" for c, bound in zip(columns, (r, r / 0.98)))

    given = f"(x.given = y.given or x.given <> '' and y.given <> '' and case when right(x.given, 1) = '.' or right(y.given, 1) = '.' then left(x.given, 1) = left(y.given, 1) else {near(0.78, 'given', 'given_sound')} end)"
    return f"exists(outlines, x -> exists(other_outlines, y -> {given} and (x.name = y.name or {near(least, 'name', 'sound')})))"


def link_names(df: DataFrame, group: str, key: str, name: str, kind: str, mark: str, place: str, year: str, least: float = 0.84, min_suffix: int = 4, tile: int = 480, expand: int = 64, words: Words | None = None) -> DataFrame:
    """``group, key_a, key_b``: keys of one group whose names mean the same.

    ``kind`` is ``p`` (person), ``o`` (organisation, band, ship) or ``?``;
    ``mark`` an identifying value (a birth date, a register number, a domain)
    that refutes a link where both have one and they differ, and allows a
    little less likeness where they agree; ``place`` and
    ``year`` refute together.

    Suffix blocking: the last ``min_suffix`` letters of every token are indexed,
    forwards and of the mirrored token, refined by a context (the initial beside
    the token, the line of business).  All rows of a block are compared, however
    many they are: a block is cut into tiles of ``tile`` rows, and all pairs of
    tiles meet.  A bound on the letters that can be common drops most pairs as
    they are met; the others are compared by the ratio of the longest common
    subsequence, token by token.  Which words are lines of business or given
    names is learned from all names of a group, unless ``words`` tells it.

    All names a key was delivered with are its spellings, its other values are
    the largest of each.  Links are closed transitively: all keys of an entity
    are paired, however many they are.  Only of keys that agree letter by letter
    in name and values, and are more than ``expand``, the first stands for the
    others and is paired with each of them.  Defined results: null and blank
    names and null keys give no pair; repeated rows count once; empty in, empty
    out; other columns are ignored.
    """
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(name).alias("name"), F.col(kind).alias("k"), F.col(mark).alias("mark"), F.col(place).alias("place"), F.col(year).cast("int").alias("year")).where("key is not null")
    values = rows.groupBy("g", "key").agg(*[F.max(c).alias(c) for c in ("k", "mark", "place", "year")])
    rows = staged(rows.where("length(trim(name)) > 0").select("g", "key", "name").distinct().join(values, ["g", "key"]), "names")
    known = learned_words(rows, "g", "name", "k") if words is None else {}
    other = words or Words()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [parse(n, k or "?", known.get(g, other)) for g, n, k in zip(*(batch.column(c).to_pylist() for c in ("g", "name", "k")))]
            kinds, cores, rests = (pa.array(c, pa.string()) for c in zip(*told)) if told else (pa.array([], pa.string()),) * 3
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("key"), batch.column("text"), kinds, cores, rests, batch.column("mark"), batch.column("place"), batch.column("year")], names=["g", "key", "text", "kind", "core", "rest", "mark", "place", "year"])

    parsed = staged(rows.withColumn("text", F.xxhash64("name", "k")).mapInArrow(read, "g string, key string, text long, kind string, core string, rest string, mark string, place string, year int"), "names")
    same = ["g", "kind", "core", "rest", "mark", "place", "year"]
    nodes = staged(parsed.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()), "names")
    members = staged(parsed.join(nodes.select(*[F.col(c).alias(f"_{c}") for c in same], "node"), [parsed[c].eqNullSafe(F.col(f"_{c}")) for c in same]).select("g", "key", "node", "text"), "members")

    outline = pa.list_(pa.struct([(c, pa.string()) for c in ("name", "sound", "given", "given_sound")]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                told = [dict(zip(("name", "sound", "given", "given_sound"), o)) for o in outlines(r, known.get(r["g"], other))]
                out += [(r["g"], side, token[-min_suffix:], context, r["mark"] or None, told, r["node"]) for side, token, context in block_keys(r, min_suffix)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string()] * 5 + [outline, pa.int64()])], names=["g", "side", "suffix", "context", "mark", "outlines", "node"])

    indexed = nodes.select("g", "kind", "core", "rest", "mark", "node").mapInArrow(keys, "g string, side string, suffix string, context string, mark string, outlines array<struct<name:string,sound:string,given:string,given_sound:string>>, node long")
    blocks = staged(indexed.select(F.xxhash64("g", "side", "context", "suffix").alias("block"), "node", "mark", "outlines").dropDuplicates(["block", "node"]), "blocks")
    met = pairs_within(blocks, "block", "node", tile, ("mark", "outlines"))
    # marks that differ refute a pair whatever the names are
    candidates = met.where("mark is null or other_mark is null or mark = other_mark").where(near_outlines(least - 0.06)).select("node", "other").distinct()

    features = ("kind", "core", "rest", "mark", "place", "year")
    side_a = nodes.select("g", "node", F.struct(*features).alias("a"))
    side_b = nodes.select(F.col("node").alias("other"), F.struct(*features).alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([compared(a, b, least, known.get(g, other)) for g, a, b in zip(*(batch.column(c).to_pylist() for c in ("g", "a", "b")))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("node", "other")], names=["node", "other"])

    links = candidates.join(side_a, "node").join(side_b, "other").select("g", "node", "other", "a", "b").mapInArrow(compare, "node long, other long")
    own = members.groupBy("g", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("g", "key", "low")
    own = members.join(own, ["g", "key"]).where("node <> low").select("node", F.col("low").alias("other"))
    links = staged(links.union(own), "links")
    whole = connected_components(links, "node", "other").withColumnRenamed("label", "entity")
    copies = members.groupBy("node", "text").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    placed = members.join(copies, ["node", "text"]).join(whole, "node", "left").select("g", "key", "n", "first", F.coalesce("entity", "node").alias("entity"))
    placed = staged(placed, "linked")
    heads = staged(placed.where((F.col("n") <= expand) | (F.col("key") == F.col("first"))).select("g", "entity", "key").distinct(), "heads")
    both = pairs_within(heads, "entity", "key", tile, ("g",)).select("g", F.col("key").alias("x"), F.col("other").alias("y"))
    star = placed.where((F.col("n") > expand) & (F.col("key") != F.col("first"))).select("g", F.col("first").alias("x"), F.col("key").alias("y"))
    return both.union(star).select(F.col("g").alias("group"), F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def typed_names(entity: DataFrame, companies: DataFrame, songs: list[DataFrame]) -> DataFrame:
    """The names of the three kinds with the fields that tell them apart."""
    from semframe.operators.nested import readable

    def first(prop: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(F.to_json(F.try_variant_get("v", f"$.{prop}", "variant")), pattern, 0), F.lit(""))

    people = entity.select("id", "caption", "schema_name", readable(F.col("properties")).alias("v"))
    kind = F.when(F.col("schema_name") == "Person", "p").when(F.col("schema_name").isNull(), "?").otherwise("o")
    mark = F.coalesce(first("birthDate", r"\d{4}-\d\d-\d\d"), first("registrationNumber", r"R\d+"), first("imoNumber", r"V\d+"))
    parts = [people.select(F.lit("entity").alias("kind"), F.col("id").alias("key"), F.col("caption").alias("name"), kind.alias("k"), mark.alias("mark"), F.lit(None).cast("string").alias("place"), first("incorporationDate", r"\d{4}").cast("int").alias("year"))]
    town = F.nullif(F.trim(F.lower(F.substring_index("locality", ",", 1))), F.lit(""))
    parts.append(companies.select(F.lit("company").alias("kind"), F.lpad(F.col("id").cast("string"), 10, "0").alias("key"), "name", F.lit("o").alias("k"), F.lower("domain").alias("mark"), town.alias("place"), F.col("year_founded").alias("year")))
    for song in songs:
        parts.append(song.select(F.lit("artist").alias("kind"), F.col("artist_name").alias("key"), F.col("artist_name").alias("name"), F.lit("?").alias("k"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("int").alias("year")))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out
