"""Spans, leaks, pieces and mixes."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semframe.llm import queries as Q
from semframe.llm.leaks import common_path, common_subsequence, leaked_passages, plain, slots_agree, templates, tokens
from semframe.llm.mixing import mix_sources, pfair, token_counts
from semframe.llm.pieces import cut, cut_pieces, tree
from semframe.llm.rolling import Powers, slices, window_hashes
from semframe.llm.shared_spans import maximal_spans, shared_share, shared_spans, sharing_pairs

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(n))


# ------------------------------------------------------------------- problem 10


def texts():
    shared, notice = prose(99, 12), "N" * 3 + prose(98, 5)
    out = {i: prose(i, 40) for i in range(12)}
    out[1] = out[1][:50] + shared + out[1][60:]
    out[2] = out[2][:131] + shared + out[2][140:]
    out[3] = out[3][:33] + shared[:70] + out[3][40:]
    for i in (4, 5, 6, 7, 8):
        out[i] += notice  # shared by many, too short alone
    out |= {20: out[9], 21: out[9], 22: "", 23: "x" * 59, 24: "🙂é" * 40, 25: "ab" + "🙂é" * 40}
    return out


@pytest.mark.parametrize("length", [60, 61, 7])
def test_spans_are_brute_force(spark, length):
    docs = texts()
    rows = [(k, v, 1) for k, v in docs.items()] + [(1, docs[1], 2), (30, None, 1), (None, docs[1], 1)]
    spans = shared_spans(spark.createDataFrame(rows, "doc_id long, text string, doc long"), "doc_id", "text", length)
    got = {tuple(r) for r in sharing_pairs(spans).collect()}
    windows = {k: {v[i : i + length] for i in range(len(v) - length + 1)} for k, v in docs.items()}
    assert got == {(a, b) for a in docs for b in docs if a < b and windows[a] & windows[b]} and got
    shares = {r.doc: r for r in shared_share(spans).collect()}
    stretches = maximal_spans(spans).collect()
    for k, v in docs.items():
        marks = np.zeros(len(v), bool)
        for i in range(len(v) - length + 1):
            if any(v[i : i + length] in windows[o] for o in docs if o != k):
                marks[i : i + length] = True
        step = np.diff(np.concatenate([[0], marks.astype(int), [0]]))
        assert sorted((r.start, r.start + r.size) for r in stretches if r.doc == k) == list(zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)))
        assert shares[k].shared_chars == marks.sum() and shares[k].stretches == (np.diff(np.concatenate([[0], marks.astype(int)])) == 1).sum(), k


def test_large_classes_of_copies_form_stars(spark):
    df = spark.createDataFrame([(i, prose(5, 30)) for i in range(9)] + [(100, prose(5, 30) + "!")], "doc_id long, text string")
    spans = shared_spans(df, "doc_id", "text", 60)
    assert {tuple(r) for r in sharing_pairs(spans, expand=4).collect()} == {(0, i) for i in range(1, 9)} | {(0, 100)}
    assert sharing_pairs(shared_spans(df.limit(0), "doc_id", "text", 60)).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abc🙂", max_size=30), max_size=6), st.integers(1, 6))
def test_rolling_hashes_tell_windows_apart(parts, length):
    seen = {}
    for codes, number, offset, last in slices(parts, length - 1, most=16):
        h = window_hashes(codes, length, Powers())
        for i, x in enumerate(h.tolist()):
            if last[i] >= length - 1:
                text = parts[number[i]][offset[i] : offset[i] + length]
                assert seen.setdefault(x, text) == text
    assert set(seen.values()) == {p[i : i + length] for p in parts for i in range(len(p) - length + 1)}


# -------------------------------------------------------------------- problem 8

PASSAGE = "In March 1987 the Harbour Company of Velden sold 40 tons of salted fish to nine merchants who paid 12 silver coins per barrel"


def leak(spark, texts, passage=PASSAGE, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(7, passage), (7, passage), (8, None), (9, ""), (None, passage)], "item_id long, passage string")
    return {r.doc_id: r for r in leaked_passages(docs, "doc_id", "text", items, "item_id", "passage", **options).collect()}


def test_leaks(spark):
    words = PASSAGE.split()
    r = random.Random(1)
    shuffled = " ".join(r.sample(words, len(words)))
    changed = " ".join("other" if i % 4 == 3 else w for i, w in enumerate(words))
    texts = [prose(1, 50) + " " + PASSAGE + " " + prose(2, 50), PASSAGE.upper().replace(" ", "  <b>") + "!", "x " + changed + " y", " ".join(words[:14]) + prose(3, 30), " ".join(words[:6]), shuffled, "", None, PASSAGE.replace("e", "é").replace("a", "a​"), prose(4, 400), " ".join(w + " " + prose(i, 9) for i, w in enumerate(words))]
    got = leak(spark, texts)
    assert set(got) == {0, 1, 2, 3, 8} and got[0].share == 1.0 and got[0].slots_agree and got[2].share < 1
    assert set(leak(spark, texts, items_a_pass=1)) == set(got)
    assert leak(spark, [], PASSAGE) == {}


def test_template_parts():
    assert tokens("Ünï &amp; <p>two</p>­ words, 3.5kg 漢字") == ["Uni", "two", "words", "3", "5kg", "漢", "字"]
    assert plain("é") == "e"
    lower, typed, named = templates("The weight is 40 kg in Velden".split())
    assert typed == ["the", "weight", "is", "\x01num", "\x01unit", "in", "velden"] and named[-1] == "\x01name"
    assert common_subsequence("a b c d".split(), "b x d a".split()) == 2 and common_subsequence([], ["a"]) == 0
    slot = ["\x01num"] * 3
    assert slots_agree(["1", "2", "1"], slot, ["7", "8", "7"], slot) == (3, 3, True) and slots_agree(["1", "2", "1"], slot, ["7", "8", "9"], slot)[2] is False and slots_agree(["a"], ["a"], ["a"], ["a"]) == (1, 0, None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=14))
def test_the_path_is_a_longest_common_subsequence(a, b):
    path = common_path(a, b)
    assert len(path) == common_subsequence(a, b) and all(a[i] == b[j] for i, j in path)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(path, path[1:]))


def test_other_values_and_words_between(spark):
    other = PASSAGE.replace("1987", "2004").replace("Harbour", "Orchard").replace("Company", "Society").replace("Velden", "Marlow").replace("40", "55").replace("12", "31").replace("March", "June")
    between = PASSAGE.replace("sold", "sold then at once").replace("who paid", "who gladly paid")
    got = leak(spark, [other, between, PASSAGE.replace("12 silver", "13 silver")])
    assert got[0].changed >= 5 and got[0].slots_agree and got[1].slots_agree and got[1].changed == 0 and got[2].changed == 1
    many = "The price of 12 apples in Velden is 30 and of 14 apples in Marlow 35"
    turned = leak(spark, [many.replace("12", "71").replace("30", "72").replace("14", "73").replace("35", "74").replace("Velden", "Aldon").replace("Marlow", "Berin").replace("price", "cost").replace("apples", "pears"), many.replace("Velden", "Aldon").replace("Marlow", "Aldon")], many)
    assert turned[1].slots_agree is False


def test_leaks_are_brute_force(spark):
    r = random.Random(8)
    words = PASSAGE.split()
    texts = []
    for i in range(40):
        kept = [w if r.random() > i / 50 else "other" for w in words]
        texts.append(prose(i, 20) + " " + " ".join(kept) + " " + prose(i + 60, 20))
    item = templates(tokens(PASSAGE))[0]
    want = {}
    for i, t in enumerate(texts):
        lower = templates(tokens(t))[0]
        best = max(common_subsequence(item, lower[s : s + len(item) + 12]) for s in range(len(lower)))
        if best >= 0.5 * len(item):
            want[i] = best
    got = {d: x.words for d, x in leak(spark, texts).items() if not x.reparameterised}
    assert got == want and 5 < len(want) < 40


# -------------------------------------------------------------------- problem 5


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab \n\t.#-=|🙂é́‍漢。"), max_size=300), st.integers(2, 40), st.data())
def test_pieces_make_up_the_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = cut(text, limit, overlap)
    assert all(e - s <= limit for s, e, _ in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (_, e, _), (s, f, _) in zip(pieces, pieces[1:]):
        assert s == max(0, e - overlap) and f > e


def test_pieces_follow_the_structure(spark):
    text = "# One\n\n" + "a b c. " * 20 + "\n\n# Two\n\n- x y\n- z\n\n" + "d e f. " * 20 + "\n\n" + "u" * 300
    kinds = [k for _, _, k in cut(text, 200, 20)]
    assert kinds == ["section", "section", "hard", "hard"] or kinds[0] == "section" and "hard" in kinds
    assert cut("abc", 3, 1) == [(0, 3, "text")]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            cut("x" * 9, *bad)
    df = spark.createDataFrame([(1, 1, text, 0), (1, 1, text, 0), (2, 1, None, 0), (3, 1, "", 0), (4, 1, " " * 201, 0), (5, 1, "v" * 1_000_00, 0)], "id long, chunk_id long, content string, piece int")
    got = {(r.id, r.piece): r for r in cut_pieces(df, ["id", "chunk_id"], "content", 200, 20).collect()}
    assert {k[0] for k in got} == {1, 4, 5} and got[(1, 0)].longest_run == 300 and got[(4, 0)].longest_run == 0 and got[(5, 0)].size == 100_000
    for i, whole in ((1, text), (5, "v" * 100_000)):
        parts = [got[(i, n)].content for n in range(sum(k[0] == i for k in got))]
        assert parts[0] + "".join(p[20:] for p in parts[1:]) == whole


def whole(node, text):
    """Children stand one after the other and within their parent."""
    for a, b in zip(node.children, node.children[1:]):
        assert a.end == b.start
    assert not node.children or node.children[0].start == node.start and node.children[-1].end <= node.end
    for child in node.children:
        whole(child, text)


def test_lists_within_lists():
    text = "# Head\n\n- one\n  more of one\n  - one a\n    - one a i\n  - one b\n- two\nplain\n\n1. first\n   1. inner\n"
    root = tree(text)
    whole(root, text)
    block = root.children[0].children[1]
    told = [text[c.start : c.end].split("\n")[0].strip() for c in block.children]
    assert told == ["- one", "- two", "plain"] and [text[c.start : c.end].split("\n")[0].strip() for c in block.children[0].children] == ["- one", "more of one", "- one a", "- one b"]
    # pieces end where an item of the outer list ends
    long = "".join(f"- item {i}\n" + "".join(f"  - part {i}.{j} of it\n" for j in range(4)) for i in range(12))
    assert all(long[s:].startswith("- item") for s, _, _ in cut(long, 250, 0))


def test_elements_of_markup():
    rows = "".join(f"<tr><td>cell {i}</td><td>{'x' * 20}</td></tr>" for i in range(30))
    text = f"<div><p>before</p><table>{rows}</table><p>after</p></div>"
    parts = cut(text, 300, 0)
    assert all(text[:e].endswith(("</tr>", "</table>", "<table>", "</p>", "</div>", "<div>")) for _, e, _ in parts) and len(parts) > 5
    loose = "<ul>" + "".join(f"<li>point {i} {'y' * 30}" for i in range(30)) + "</ul>"
    assert all(loose[s:].startswith(("<li>", "<ul>", "</ul>")) for s, _, _ in cut(loose, 200, 0))
    for t in (text, loose, "<p>" * 50 + "a" * 50, "</p></li>" * 30 + "<p>z", "<ul><li>" * 40):
        assert "".join(t[s:e] for s, e, _ in cut(t, 40, 0)) == t


# -------------------------------------------------------------------- problem 9


def test_pfair_keeps_within_one_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    done = dict.fromkeys(weights, 0)
    for slot, s, j in itertools.islice(pfair(weights, dict.fromkeys(weights, 10**6)), 1000):
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[k] - w * (slot + 1)) < 1 for k, w in weights.items())
    assert sum(done.values()) == 1000 and list(pfair({}, {})) == []
    assert [slot for slot, _, _ in pfair({"a": 0.5}, {"a": 3})] == [0, 2, 4]
    # every block gets a slot, whatever the others leave free
    placed = list(pfair({"a": 0.9, "b": 0.1}, {"a": 5, "b": 70}))
    assert len(placed) == 75 and len({slot for slot, _, _ in placed}) == 75
    with pytest.raises(ValueError):
        list(pfair({"a": 0.7, "b": 0.7}, {"a": 1, "b": 1}))


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, s, r.randrange(1, 40)) for i, s in enumerate(["big"] * 600 + ["mid"] * 200 + ["small"] * 20 + [None] * 30 + ["other"] * 50)]
    counted = spark.createDataFrame(docs, "doc long, source string, tokens long")
    targets = spark.createDataFrame([("Big ", 0.5, 1), ("mid", 0.4, 3), ("small", 0.1, 2), ("none", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mix_sources(counted, targets, slots=100, slice_rows=64)
    report = {r.source: r for r in mix.report.collect()}
    total = sum(d[2] for d in docs)
    for s, share, most in (("big", 0.5, 1), ("mid", 0.4, 3), ("small", 0.1, 2)):
        own = sum(d[2] for d in docs if d[1] == s)
        assert report[s].tokens == own and report[s].reachable == (own * most >= share * total)
        assert report[s].used_tokens >= min(share * total, own * most) and report[s].used_tokens <= min(share * total + 40, own * most)
    placed = mix.placed.collect()
    size = {d[0]: d[2] for d in docs}
    uses = {}
    for p in placed:
        uses.setdefault(p.doc, set()).add(p.use)
        assert p.tokens == size[p.doc]
    assert all(len(u) <= {"big": 1, "mid": 3, "small": 2}[docs[d][1]] for d, u in uses.items()) and len(placed) == sum(map(len, uses.values()))
    for s in ("big", "mid", "small"):  # documents lie one behind the other in their source's stream
        at = 0
        for p in sorted((p for p in placed if p.source == s), key=lambda p: p.start):
            assert p.start == at
            at += p.tokens
    again = mix_sources(counted, targets, slots=100, slice_rows=64)
    assert sorted(map(tuple, again.placed.collect())) == sorted(map(tuple, placed))
    empty = mix_sources(counted.limit(0), targets)
    assert empty.placed.count() == 0 and all(r.used_tokens == 0 for r in empty.report.collect())


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", " A"), (1, "hello world", " A"), (2, None, None), (3, "", "b"), (4, "<|endoftext|>" * 3, "b"), (None, "x", "b")], "doc_id long, text string, source string")
    got = {r.doc: (r.source, r.tokens) for r in token_counts(df, "doc_id", "text", "source", Q.VOCABULARY).collect()}
    assert got[1] == ("a", 2) and got[2] == (None, 0) and got[3] == ("b", 0) and got[4][1] > 3 and len(got) == 4


def test_queries_name_their_columns(spark, data):
    for name, columns in {"p5_found": ["case_kind", "item_kind", "id", "chunk_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["source"], "p10_found": ["doc_a", "doc_b"]}.items():
        df = Q.QUERIES[name](spark, data)
        assert df.columns == columns and df.count() == df.distinct().count()
