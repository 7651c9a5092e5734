"""Names, listings and matches."""

import itertools
import random
from functools import partial

import numpy as np
import pytest

from semframe.llm import queries as Q
from semframe.llm.listings import features, parsed_listings, price_of, refuted, same_listings, slipped, star_clusters, tokens
from semframe.llm.matching import as_longs, bit_vector, calibration, dice, hamming_pairs, match_products, match_records, match_songs, released, seconds, shared_grams, song, song_codes, song_pair, title_of
from semframe.llm.names import Words, alike, block_keys, learned_words, link_names, parse, person_tokens, same_person
from semframe.operators.tiles import pairs_within

# ------------------------------------------------------------------- problem 2

WORDS = Words("development foods logistics trio quartet shipping management services".split(), "olga natalia omar jovan leila".split())
NAMES = [
    ("p1", "Frederick Hisazefosk", "p"), ("p2", "Fred Hisazefosk", "p"), ("p3", "F. Hisazefosk", "p"), ("p4", "HISAZEFOSK, F.A.", "p"), ("p5", "Dr. Frederick-John Hisasephosk Jr.", "p"), ("p6", "Hisazfeosk, Frederick", "p"),
    ("q1", "Rebecca Hisazefosk", "p"), ("q2", "Becky Hisazefosk", "p"), ("r1", "Natalia K. Wihoviril", "p"), ("s1", "Natalia Kogokiwak", "p"), ("s2", "KOGOKIWAK NATALIA", "p"),
    ("o1", "Kefodamoth Development Co", "o"), ("o2", "kefo damoth dev. & Co.", "o"), ("o3", "KEFODAMOTH DEV CO.", "o"), ("o4", "Development Kefódamoth, Company", "o"), ("o5", "Kefodamoth Logistics GmbH", "o"),
    ("b1", "The Sirizikont Trio", "?"), ("b2", "Sirizikont Trio, The", "?"), ("b3", "Thee Sirizikont Trio.", "?"), ("b4", "The Sirizikont Quartet", "?"), ("z1", None, "p"), ("z2", "  ", "p"), ("z3", "...", "o"), (None, "Fred Hisazefosk", "p"),
]


def names_frame(spark, rows):
    return spark.createDataFrame([("g", k, n, t, None, None, None, 0) for k, n, t in rows], "grp string, key string, name string, t string, m string, p string, y int, node int")


def linked(df, **options):
    return {(r.key_a, r.key_b) for r in link_names(df, "grp", "key", "name", "t", "m", "p", "y", **({"words": WORDS} | options)).collect()}


def pairs(groups):
    return {tuple(sorted(p)) for g in groups for p in itertools.combinations(g.split(), 2)}


def test_names(spark):
    df = names_frame(spark, NAMES + NAMES[:4])
    want = pairs(["p1 p2 p3 p4 p5 p6", "q1 q2", "s1 s2", "o1 o2 o3 o4", "b1 b2 b3"])
    assert linked(df) == want
    assert linked(df, tile=2) == want  # every block in several tiles
    assert linked(df.limit(0)) == set()


def test_fields_refute_links(spark):
    rows = [("g", "a", "Olga Bifefadiff", "p", "1970-01-01", None, None), ("g", "b", "Olga Bifefadiff", "p", "1980-01-01", None, None), ("g", "c", "Oylga Bifefadiff", "p", "1970-01-01", None, None), ("g", "d", "Melo Foods", "o", None, "paris", 1950), ("g", "e", "Mello Foods", "o", None, "rome", 1950), ("h", "f", "Olga Bifefadiff", "p", None, None, None)]
    df = spark.createDataFrame(rows, "grp string, key string, name string, t string, m string, p string, y int")
    assert linked(df) == {("a", "c")}


def test_a_name_that_many_share(spark):
    df = names_frame(spark, [(f"k{i:04}", "Hiro Womepireld", "p") for i in range(300)] + [("x", "Hiro Womepirald", "p")])
    got = linked(df, expand=20)
    assert ("k0000", "x") in got and len(got) == 300  # a star and one link


def test_common_blocks_are_compared_completely(spark):
    """Two spellings that share the last four letters only, in a block of many."""
    r = random.Random(3)
    crowd = ["".join(r.choice("bcdfgklmnpstvz") + r.choice("aeiou") for _ in range(3)) + r.choice("bdfgklmn") + "erikh" for _ in range(400)]
    df = names_frame(spark, [(f"c{i:03}", f"Olga {c.title()}", "p") for i, c in enumerate(dict.fromkeys(crowd))] + [("x", "Olga Hisazefoserikh", "p"), ("y", "O. Hsiazefoferikh", "p")])
    assert ("x", "y") in linked(df) and ("x", "y") in linked(df, tile=10)


def test_pairs_within_blocks(spark):
    rows = [(b, i, str(i)) for b, n in ((1, 1), (2, 40), (3, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "block int, item int, word string")
    got = [tuple(x) for x in pairs_within(df, "block", "item", 7, ("word",)).select("block", "item", "other", "word", "other_word").collect()]
    assert sorted(got) == [(b, i, j, str(i), str(j)) for b, n in ((2, 40), (3, 2)) for i in range(n) for j in range(i + 1, n)]


def test_every_spelling_of_a_key_counts(spark):
    df = names_frame(spark, [("a", "Olga Bifefadiff", "p"), ("a", "Natalia Kogokiwak", "p"), ("b", "Olga Bifefadif", "p"), ("c", "N. Kogokiwak", "p")])
    assert linked(df) == pairs(["a b c"])


def test_differing_texts_of_one_name_are_all_paired(spark):
    df = names_frame(spark, [(f"k{i:03}", "Hiro" + " " * (i + 1) + "Womepireld", "p") for i in range(90)])
    assert len(linked(df, expand=20)) == 90 * 89 // 2


def test_learned_words(spark):
    own = ["".join(random.Random(i).choice("bdfgklmn") + random.Random(i * 7 + j).choice("aeiou") for j in range(4)) for i in range(400)]
    rows = [("g", f"{o.title()} {('Foods', 'Logistics')[i % 2]} {('Ltd', 'Inc.')[i % 3 > 0]}", "o") for i, o in enumerate(own)] + [("g", f"{('Olga', 'Hiro')[i % 2]} {o}", "p") for i, o in enumerate(own)] + [("h", None, "o"), ("h", "x", None)]
    told = learned_words(spark.createDataFrame(rows, "g string, n string, k string"), "g", "n", "k")
    assert set(told) == {"g"} and set(told["g"].common) == {"foods", "logistics"} and {"olga", "hiro"} <= told["g"].given


def test_large_entities_are_paired_completely(spark):
    df = names_frame(spark, [(f"{c}{i}", f"Frederick {c.upper()}. Hisazefosk", "p") for c in "abcde" for i in (1, 2)])
    assert linked(df, expand=2) == linked(df) == pairs([" ".join(f"{c}{i}" for c in "abcde" for i in (1, 2))])


def test_name_parts():
    assert person_tokens("Mr Anna-Maria O. Smith Jr.") == ["anna", "maria", "o.", "smith"] and person_tokens("SMITH, J.K.") == ["j.", "k.", "smith"]
    assert person_tokens("Banattaroler GT") == ["banattaroler", "g.", "t."] and person_tokens("Lageneleth, Nacho") == ["ignacio", "lageneleth"]
    assert parse("The Big Foods & Co. S.A.", "o", WORDS) == ("o", "big", "foods") and parse("", "p", WORDS)[0] == "p"
    assert WORDS.common_word("shpg") == "shipping" and WORDS.common_word("mgmt") == "management" and WORDS.common_word("siervices") == "services" and WORDS.common_word("kefodamoth") is None
    assert alike("abcd", "abd") == pytest.approx(6 / 7) and alike("", "a") == 0 and alike("x", "x") == 1
    assert same_person("olga bifefadiff", "o. bifefadiff", 0.8, WORDS) and not same_person("olga bifefadiff", "omar bifefadiff", 0.8, WORDS) and not same_person("natalia k. wihoviril", "natalia kogokiwak", 0.8, WORDS)
    assert all(len(t) >= 4 for _, t, _ in block_keys({"kind": "p", "core": "", "rest": "j. smithson"}, 4))


# ------------------------------------------------------------------- problem 4

OFFERS = [
    (1, "Siritonoth LCD TV SRT-4010S (32\", Pure White)", "made by Siritonoth; Hot Deal; ships in 3 days", "USD 300"),
    (2, "2-Year Warranty Siritonoth 81.3 cm HDTV - WHT - SRT 40-10S - NEW", None, "290,00 $"),
    (3, "siritonoht srt4010s flat panel television white", "32-inch class<br/>Top Rated", "call"),
    (4, "Siritonoth LCD TV SRT-4010 (46\", White)", None, "$500"),
    (5, "Siritonoth Wall Mount SRT-4010S (for LCD TV, White)", None, "$20"),
    (6, "Siritonoth LCD TV SRT-4010S (32\", Black)", None, "$300"),
    (7, "Bagasesisk Kettle 1.7 L Blue", None, "$30.00"), (8, "bagasesisk water kettle, blu, 1700 ml", "Best Price!", "USD 31"), (9, "Bagasesisk Kettle 1.7 L Blue", None, "$90"),
    (10, None, None, None), (11, "", "", ""), (12, "Hot Deal", None, None),
]


def offers(spark, rows, key="id_x"):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], f"{key} long, name string, description string, price string, seller string, id long")


def test_listings(spark):
    df = offers(spark, OFFERS + OFFERS[:3] + [(None, "Siritonoth LCD TV SRT-4010S", None, None)])
    got = {(r.id_a, r.id_b) for r in same_listings([(df, "id_x")]).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (7, 8)}
    a, b = offers(spark, OFFERS[:1]), offers(spark, OFFERS[1:3], "id_y")
    assert {(r.id_a, r.id_b) for r in same_listings([(a, "id_x"), (b, "id_y")]).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert same_listings([(df.limit(0), "id_x")]).count() == 0
    many = offers(spark, [(i, OFFERS[0][1], None, "USD 3") for i in range(100)])
    assert same_listings([(many, "id_x")], expand=10).count() == 99


def test_listings_of_a_popular_product_are_all_paired(spark):
    rows = [(i, OFFERS[0][1], f"made by Siritonoth; ships in {i} days", f"USD {300 + i}") for i in range(1, 31)] + [(i, *OFFERS[0][1:]) for i in range(31, 51)]
    # 30 texts and the first of 20 copies in full, the other copies with that first
    want = set(itertools.combinations(range(1, 32), 2)) | {(31, i) for i in range(32, 51)}
    for options in ({}, {"tile": 8}):
        assert {(r.id_a, r.id_b) for r in same_listings([(offers(spark, rows), "id_x")], expand=10, **options).collect()} == want


OTHER_GOODS = [
    (1, "Dune by Frank Herbert, Paperback", "A desert planet", "$9.99"), (2, "Frank Herbert: DUNE (paperback)", None, "USD 10.20"), (3, "Dune Messiah by Frank Herbert, Paperback", None, "$9.50"), (4, "Emma by Jane Austen, Hardcover", None, "$12"),
    (5, "Corsar Trailrunner Gale Shoe Men 42 EU", None, "80"), (6, "corsar gale trailrunner men shoe 42 eu", "in stock", "82.50"), (7, "Corsar Trailrunner Gale Shoe Men 43 EU", None, "80"), (8, "Corsar Trailrunner Gale Shoe Men 42 EU", None, "140"),
    (9, "Atlas of Rivers 978-3-16-148410-0", None, None), (10, "River atlas (ISBN 9783161484100)", None, "$20"),
]


def test_goods_of_no_known_kind(spark):
    """Books and shoes: no word of them is in any list."""
    filler = [(100 + i, f"{prose_word(i)} {prose_word(i + 50)} {prose_word(i + 90)} Hardcover", None, "$5") for i in range(40)]
    got = {(r.id_a, r.id_b) for r in same_listings([(offers(spark, OTHER_GOODS + filler), "id_x")]).collect()}
    assert got >= {(1, 2), (5, 6)} and not {(3, 4), (5, 8), (1, 4), (6, 8)} & got, got


def prose_word(i):
    return "".join("bdfgklmnprstvz"[(i * 7 + j * 5 + i // 14) % 14] + "aeiou"[(i + j * 3) % 5] for j in range(4)).title()


def test_slips_of_models():
    assert slipped("pum3778", "pu3778") and slipped("cds760", "cds7160") and slipped("buq090e", "buq0904")
    assert not slipped("tyf7490", "tyf7480") and not slipped("jer1288", "jer1288s") and not slipped("abc1", "abc1")


def test_containment_has_no_bound_on_the_heavier_listing(spark):
    terse, wordy = (1, "Siritonoth SRT-4010S", None, None), (2, "Siritonoth LCD TV SRT-4010S 32 inch white 4 kg 120 W 16 MP", "Model srt4010s also fits srt4011s and srt4020s, srt4030s, srt4040s", "$300")
    assert {(r.id_a, r.id_b) for r in same_listings([(offers(spark, [terse, wordy]), "id_x")]).collect()} == {(1, 2)}


def test_listing_join_is_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(120):
        model = f"{r.choice('AB')}QZ-{r.choice('12')}0{r.choice('12')}{r.choice('12')}"
        rows.append((i, f"Vabasabiff {r.choice(['LCD TV', 'HDTV', 'Kettle'])} {model} {r.choice(['Black', 'BLK', 'White'])}", None, None))
    df = offers(spark, rows)
    told = {x.id: x for x in parsed_listings(df, "id_x").collect()}
    f = {i: features(*row[1:]) for i, row in enumerate(rows)}
    assert all(sorted(told[i].tokens) == tokens(f[i]) for i in f)
    same = {(i, j) for i in f for j in f if i < j and not refuted(f[i], f[j])}
    got = {(x.id_a, x.id_b) for x in same_listings([(df, "id_x")]).collect()}
    assert got == same  # equal models, kinds and colours are cliques


def test_listing_parts(spark):
    assert [price_of(p) for p in ("222,82 $", "USD 1,633.50", "$18", "call", None, "1.234")] == [222.82, 1633.5, 18, None, None, 1234]
    f = features("Hot Deal Kamasomes 3.3 ft HDMI Cord - Ocean Blue - XYZ-1234S - NEW", None, None)
    assert (f["brand"], f["models"], f["colour"], f["kind"], f["accessory"]) == ("kamasomes", ["xyz1234s"], "blue", "hdmi cable", "") and f["sizes"][0][1] == pytest.approx(100.6, abs=0.1)
    edges = [(1, 2), (1, 3), (1, 4), (4, 5), (5, 6), (7, 8)]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a long, b long")
    stars = {x.node: x.star for x in star_clusters(both).collect()}
    assert set(stars) == set(range(1, 9)) and stars[2] == stars[3] == stars[4] == 1 and stars[7] == stars[8] == 7 and stars[6] == stars[5]


# ------------------------------------------------------------------- problem 6

SONGS_L = [(1, "Often Cover", "The Sirizikont Trio", "2/8/1980", "Almost North Few", "06:16"), (2, "Area 51 - EP", "F. Hisazefosk", "1999", "Around (Live)", "200"), (3, None, "Olga Bifefadiff", None, "Noise", "1:00"), (4, "Album", None, "2001", "Silent Valley Coast", "3:00"), (5, None, None, None, None, None), (6, "Other", "Jovan Sifinizaff", "1990", "Solo", None)]
SONGS_R = [(11, "Often Cover [Remastered]", "Sirizikont Trio, The", "February 8, 1980", "almost  North few (Album Version)", "6m 14s"), (12, "Area 51", "Frederick Hisazefosk", "1999-04-01", "Around [Live] (feat. Various)", "0:03:21"), (13, "Area 51", "Frederick Hisazefosk", "1999-04-01", "Around", "0:03:21"), (14, "Covers", "Leila Zekiwabont", "1980", "Almost North Few", "06:16"), (15, "Album", "The Kirotawant Quartet", "01-May-01", "Silent Vally Coast", "181"), (16, "Other", "Jovan Sifinizaff", "1990", "Solo", "2:00"), (17, "x", None, "1990", None, "2:00")]


def songs(spark, rows, key):
    return spark.createDataFrame([(*r, 9, "clash") for r in rows], f"{key} long, album_name string, artist_name string, released string, song_name string, track_time string, a int, l string")


def test_songs(spark):
    left, right = songs(spark, SONGS_L + SONGS_L[:2], "sno_left"), songs(spark, SONGS_R, "sno_right")
    got = {(r.left_key, r.right_key): r.confidence for r in match_songs(left, right, words=WORDS).collect()}
    assert set(got) == {(1, 11), (2, 12), (4, 15), (6, 16)} and all(0.5 <= c <= 1 for c in got.values())
    assert match_songs(left.limit(0), right).count() == 0 and match_songs(left, right.limit(0)).count() == 0


def test_songs_that_many_rows_tell(spark):
    left = songs(spark, [(i, *SONGS_L[0][1:]) for i in range(90)], "sno_left")
    got = match_songs(left, songs(spark, SONGS_R, "sno_right"), words=WORDS)
    assert got.count() == 1  # the first of the equal rows stands for them
    few = songs(spark, [(i, *SONGS_L[0][1:]) for i in range(20)], "sno_left")
    assert match_songs(few, songs(spark, SONGS_R, "sno_right"), words=WORDS).count() == 20


def test_every_row_of_a_common_song_is_matched(spark):
    left = songs(spark, [(i, *SONGS_L[0][1:3], SONGS_L[0][3], "Almost" + " " * (i + 1) + "North Few", SONGS_L[0][5]) for i in range(90)], "sno_left")
    right = songs(spark, [SONGS_R[0]] + [(200 + i, *SONGS_R[0][1:4], "almost North" + " " * (i + 1) + "few", SONGS_R[0][5]) for i in range(70)], "sno_right")
    got = {(r.left_key, r.right_key) for r in match_songs(left, right, words=WORDS).collect()}
    assert got == {(i, j) for i in range(90) for j in [11, *range(200, 270)]}


def test_every_copy_is_matched_where_asked(spark):
    left = songs(spark, [(i, *SONGS_L[0][1:]) for i in range(90)], "sno_left")
    right = songs(spark, [(200 + i, *SONGS_R[0][1:]) for i in range(70)], "sno_right")
    assert match_songs(left, right, expand=None, words=WORDS).distinct().count() == 90 * 70
    columns = ["album_name", "artist_name", "released", "song_name", "track_time"]
    tiled = match_records(left, "sno_left", right, "sno_right", columns, partial(song, known=WORDS), song_codes, partial(song_pair, known=WORDS), expand=None, tile=8)
    assert tiled.count() == tiled.distinct().count() == 90 * 70


def test_products(spark):
    a, b = offers(spark, OFFERS, "id_abt"), offers(spark, [(r[0] + 100, *r[1:]) for r in OFFERS], "id_buy")
    got = {(r.left_key, r.right_key) for r in match_products(a, b).collect()}
    alone = {(i, i + 100) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)}
    assert got == alone | {(x, y + 100) for x, y in [(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2), (7, 8), (8, 7)]}


def test_hamming_pairs_are_exact(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2, (20, 256)).astype(bool)
    other = base[rng.integers(0, 20, 60)] ^ (rng.random((60, 256)) < 0.06)
    rows = [[(i, np.packbits(v).view(np.int64).tolist()) for i, v in enumerate(m)] for m in (base, other)]
    a, b = (spark.createDataFrame(r, "id long, bits array<long>") for r in rows)
    got = {(r.l, r.r) for r in hamming_pairs(a, b).collect()}
    assert got == {(i, j) for i in range(20) for j in range(60) if (base[i] != other[j]).sum() <= 15} and got
    with pytest.raises(ValueError):
        hamming_pairs(a, b, 3)


def test_song_parts():
    assert [seconds(t) for t in ("5m 11s", "03:36", "0:04:58", "122", "", None, "soon")] == [311, 216, 298, 122, None, None, None]
    assert [released(t) for t in ("1975-12-08", "07-Jul-81", "11/27/2017", "June 12, 1986", "2003", "x", None)] == [(1975, 12, 8), (1981, 7, 7), (2017, 11, 27), (1986, 6, 12), (2003, 0, 0), None, None]
    assert title_of("Area (feat. Various) [Acousic]") == ("area", "acoustic") and title_of("Live Wire - Single Version") == ("live wire", "") and title_of(None) == ("", "")
    assert dice("night", "night") == 1 and dice("", "") == 0 and 0.4 < dice("night", "nacht") < 0.6
    assert (bit_vector({"t": "some title"}) ^ bit_vector({"t": "some titel"})).bit_count() < 60 and not bit_vector({})
    assert as_longs(1 | 1 << 127 | 1 << 255) == [1, -(2**63), 0, -(2**63)]
    assert set(shared_grams("some title")) & set(shared_grams("som titel")) and shared_grams("") == []
    keys = ("album_name", "artist_name", "released", "song_name", "track_time")
    a, b = (song(dict(zip(keys, r[1:])), WORDS) for r in (SONGS_L[0], SONGS_R[3]))
    assert song_pair(a, b, WORDS)[1]  # a cover


def test_confidences_rise_with_scores(spark):
    r = random.Random(1)
    rows = [(min(1.0, r.gauss(0.9, 0.05)), False) for _ in range(500)] + [(r.gauss(0.4, 0.1), False) for _ in range(300)] + [(r.gauss(0.4, 0.1), True) for _ in range(600)]
    told = calibration(spark.createDataFrame(rows, "score double, refuted boolean"))
    assert told == sorted(told) and told[20] < 0.5 and told[45] > 0.85
    assert len(calibration(spark.createDataFrame([], "score double, refuted boolean"))) == 50


def test_queries_name_their_columns(spark, data):
    for name, columns in {"p2_found": ["kind", "key_a", "key_b"], "p4_found": ["id_a", "id_b"], "p6_found": ["kind", "left_key", "right_key"]}.items():
        df = Q.QUERIES[name](spark, data)
        assert df.columns == columns and df.count() == df.distinct().count()
