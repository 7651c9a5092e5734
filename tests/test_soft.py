"""Soft filters, joins and aggregates, clusters, metrics, nested JSON, streams."""

import itertools
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semframe.functions.models import CallableEmbedding, CallableGenerator, CallableValidator, DictionaryEmbedding, EchoGenerator, HashedNgramEmbedding, LetterEmbedding, OverlapValidator
from semframe.functions.models.adapters import ChatGenerator, ChatValidator, PooledEmbedding, SentenceEmbedding, ServerChat
from semframe.functions.models.roles import with_embeddings
from semframe.functions.serialize import braced, plain
from semframe.functions.vector import DISTANCES, cosine, literal, mean_pool, normalized, vector_topk
from semframe.operators.aggregate import Count, CustomAgg, SetAgg, Sum, _in_parts, hash_aggregate, soft_aggregate
from semframe.operators.cluster import CallableClusterer, DBSCANClusterer, HDBSCANClusterer, KMeansClusterer
from semframe.operators.cells import Forest, near_blocks, squared_distances
from semframe.operators.components import connected_components
from semframe.operators.criteria import All, Col, Const, HardEqual, SoftEqual, SoftValidate, select
from semframe.operators.joins import similar_pairs, soft_join
from semframe.operators.metrics import bleu, bleu_representativeness, calc_bleu, classify_one_vs_all, cluster_scores, expected_mi, match_metrics, text_tokens, threshold_sweep
from semframe.operators.nested import child_cells, child_table, child_tables, nested_nodes, nested_objects, nested_strings
from semframe.relation import Relation
from semframe.sources.scan import values
from tests.util import same

CARS = ["bmw", "audi", "fiat"]
PLANTS = ["rose", "oak", "fern"]
WORLD = DictionaryEmbedding({w: [1, 0.1 * i] for i, w in enumerate(CARS)} | {w: [0.1 * i, 1] for i, w in enumerate(PLANTS)} | {"car brand": [1, 0]})


@pytest.fixture(scope="module")
def objects(spark):
    return values(spark, "objects", ["object"], [(w,) for w in CARS + PLANTS])


def test_offline_models_agree_with_their_columns(spark):
    texts = ["Hello World", "", "zebra zebra", "Ünï"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for model in (LetterEmbedding(), LetterEmbedding(unit=True), HashedNgramEmbedding(32)):
        got = {r.t: r.v for r in with_embeddings(df, "t", "v", model).collect()}
        assert got.pop(None) is None
        assert all(np.allclose(got[t], model(t)) for t in texts)
        assert model([]).shape == (0, model.size)
    assert EchoGenerator()("Hi") == "hi" and CallableGenerator(str.upper)("a") == "A"
    prompt = 'Is "red steel" a "steel ring"?'
    assert OverlapValidator()(prompt) and not OverlapValidator(2)(prompt)
    assert spark.createDataFrame([(prompt,)], "p string").select(OverlapValidator().to_column(F.col("p"))).first()[0]


def test_adapters_are_lazy_and_strict(monkeypatch):
    chat = ServerChat("http://localhost:9", "m")
    for told, whole, ending in (("Yes.", True, True), ("I think: yes", False, True), ("no", False, False)):
        monkeypatch.setattr(ServerChat, "answer", lambda *a, told=told: told)
        assert ChatValidator(chat)("p") is whole and ChatValidator(chat, ending=True)("p") is ending
    assert ChatGenerator(chat, lower=True)("p") == "no"
    for model in (SentenceEmbedding(), PooledEmbedding()):
        with pytest.raises(ImportError):
            model.embed(["x"])


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, -1.0])], "id int, v array<double>")
    got = {r.id: r for r in df.select("id", cosine(F.col("v"), literal([3, 4])).alias("c"), normalized(F.col("v")).alias("n"), *[d(F.col("v"), literal([1, 1])).alias(k) for k, d in DISTANCES.items()]).collect()}
    assert got[1].c == pytest.approx(1) and got[2].c == 0 and got[1].n == [0.6, 0.8] and got[2].n == [0, 0]
    assert got[1].l2 == pytest.approx(math.sqrt(13)) and got[1].ip == -7 and got[1].l1 == 5 and got[3].hamming == 1 and got[3].jaccard == 0.5
    assert [r.id for r in vector_topk(df, "v", [1, -1], 2).collect()] == [3, 2]
    assert df.select(mean_pool([F.col("v"), literal([1, 2]), F.lit(None).cast("array<double>")]).alias("m")).first().m == [2.0, 3.0]


def test_soft_filter(spark, objects):
    near = SoftEqual(Col("object"), Const("car brand"), WORLD, method="threshold", threshold=0.9)
    kept = {r["object"] for r in select(objects, near).fetch_all()}
    assert kept == set(CARS) and {r["object"] for r in select(objects, ~near).fetch_all()} == set(PLANTS)
    # inclusive at the threshold
    exact = float(cosine_of([1, 0.2], [1, 0]))
    assert {r["object"] for r in select(objects, SoftEqual(Col("object"), Const("car brand"), WORLD, method="threshold", threshold=exact)).fetch_all()} == set(CARS)
    asked = []
    yes = CallableValidator(lambda p: "bmw" in p or "rose" in p)
    both = SoftEqual(Col("object"), Const("car brand"), WORLD, yes, threshold=0.9)
    assert [r["object"] for r in select(objects, both).fetch_all()] == ["bmw"]
    only = SoftEqual(Col("object"), Const("car brand"), validator=yes, method="zero-few-shot")
    assert {r["object"] for r in select(objects, only).fetch_all()} == {"bmw", "rose"}
    assert select(objects, All([both, HardEqual(Col("object"), Const("oak"))])).fetch_all() == [] and asked == []
    valid = SoftValidate("Is {object} red?", CallableValidator({"Is rose red?": True}))
    assert select(objects, valid).fetch_all() == [{"object": "rose"}] and select(objects, valid).columns == ["object"]
    with pytest.raises(ValueError):
        SoftEqual(Col("object"), Const("x"), WORLD)
    record = SoftEqual(None, Const("bmw, 1"), CallableEmbedding(lambda ts: [[t == "bmw, 1", 1] for t in ts], 2), method="threshold", threshold=0.99)
    rows = values(spark, "r", ["a", "b", "c"], [("bmw", 1, None), ("bmw", None, None)], "a string, b int, c int")
    assert len(select(rows, record).fetch_all()) == 1


def cosine_of(u, v):
    u, v = np.array(u, float), np.array(v, float)
    return sum(u * v) / (math.sqrt(sum(u * u)) * math.sqrt(sum(v * v)))


L = [("red steel ring", "x"), ("blue bolt", None), ("green nut", "y"), (None, None)]
R = [("steel ring red", "x"), ("a blue bolt", "z"), ("nut", None)]


@pytest.mark.parametrize("physical", ["native", "cells"])
@pytest.mark.parametrize("comparison,form", [("RECORD_WISE", "FULL_SERIALIZED"), ("RECORD_WISE", "FIELD_SERIALIZED"), ("COLUMN_WISE", "FULL_SERIALIZED")])
def test_soft_join_is_brute_force(spark, comparison, form, physical):
    model, least = LetterEmbedding(unit=True), 0.35 if form == "FIELD_SERIALIZED" else 0.6
    l, r = values(spark, "l", ["a", "b"], L, "a string, b string"), values(spark, "r", ["c", "d"], R, "c string, d string")

    def vectors(row, names):
        cells = [c for c in row if c is not None]
        if comparison == "COLUMN_WISE":
            return [model(c) if c is not None else np.zeros(26) for c in row]
        if form == "FIELD_SERIALIZED":
            return [sum(model(c) for c in cells) / len(cells)] if cells else None
        return [model("{" + ", ".join(f"{n}: '{c}'" for n, c in zip(names, row) if c is not None) + "}")]

    want = []
    for x, y in itertools.product(L, R):
        u, v = vectors(x, "ab"), vectors(y, "cd")
        if u is not None and v is not None and sum(p @ q for p, q in zip(u, v)) / len(u) > least:
            want.append({"a": x[0], "b": x[1], "c": y[0], "d": y[1]})
    got = soft_join(l, r, method="threshold", comparison=comparison, form=form, threshold=least, model=model, columns_left=["a", "b"], columns_right=["c", "d"], physical=physical)
    assert same(got.fetch_all(), want) and want
    every = got.df.count()
    yes = CallableValidator(lambda p: "ring" in p)
    both = soft_join(l, r, comparison=comparison, form=form, threshold=least, model=model, validator=yes, columns_left=["a", "b"], columns_right=["c", "d"], physical=physical)
    assert same(both.fetch_all(), [w for w in want if "ring" in f"{w['a']}{w['c']}"]) and both.df.count() <= every


def test_soft_join_edges(spark):
    l, r = values(spark, "l", ["a"], [("x",)], "a string"), values(spark, "r", ["a"], [], "a string")
    model = LetterEmbedding(unit=True)
    assert soft_join(l, r, method="threshold", threshold=0.1, model=model).fetch_all() == []
    assert soft_join(r, l, method="threshold", threshold=0.1, model=model).columns == ["r.a", "l.a"]
    # strict at the threshold
    twin = values(spark, "t", ["a"], [("x",)], "a string")
    assert soft_join(l, twin, method="threshold", threshold=1.0, model=model, serializer=plain).fetch_all() == []
    assert soft_join(l, twin, method="threshold", threshold=0.99, model=model, serializer=plain, with_score=True).fetch_one()["similarity"] == 1.0
    assert soft_join(l, twin, method="zero-shot-prompting", validator=CallableValidator(lambda p: True)).df.count() == 1
    for bad in ({"method": "none"}, {"method": "threshold"}, {"method": "both", "threshold": 1, "model": model}, {"method": "threshold", "threshold": 1, "model": model, "comparison": "COLUMN_WISE"}):
        with pytest.raises(ValueError):
            soft_join(l, twin, **bad)


def test_similar_pairs_in_slices(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 4)), rng.normal(size=(30, 4))
    da = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "l long, v array<double>")
    db = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "r long, v array<double>")
    got = {(r.l, r.r) for r in similar_pairs(da, db, 1.5, physical="cells").collect()}
    assert got == {(i, j) for i in range(40) for j in range(30) if a[i] @ b[j] > 1.5}
    got = {(r.l, r.r) for r in similar_pairs(da, db, 2.0, "l2", physical="cells").collect()}
    assert got == {(i, j) for i in range(40) for j in range(30) if ((a[i] - b[j]) ** 2).sum() < 2.0}


@pytest.mark.parametrize("metric, threshold, size", [("ip", 1.0, 0), ("ip", -0.5, 0), ("l2", 0.7, 0), ("l2", 0.7, 1 << 20)])
def test_blocks_of_cells_are_complete(spark, metric, threshold, size):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 3)), np.repeat([[1.0, 1, 0]], 50, 0), [[0, 0, 0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    near = x @ x.T > threshold if metric == "ip" else squared_distances(x, x) < threshold
    small = {"block_rows": 16, "probes_a_task": 40, "small_bytes": size}
    got = [tuple(r) for r in near_blocks(df, df, threshold, metric, lambda _, hit, q, e: [q[np.nonzero(hit)[0]], e[np.nonzero(hit)[1]]], "a long, b long", **small).collect()]
    assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))
    forest = Forest()
    links = near_blocks(df, df, threshold, metric, lambda _, hit, q, e: forest.links(hit & (q[:, None] != e[None, :]), q, e), "a long, b long", **small)
    assert links.count() < 3 * len(x) * 13
    label = np.arange(len(x))
    for _ in x:
        label = np.where(near | np.eye(len(x), dtype=bool), label[None, :], len(x)).min(1)
    assert {r.node: r.label for r in connected_components(links).collect()} == {i: int(c) for i, c in enumerate(label) if (label == c).sum() > 1}


def test_dbscan_is_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 2))
    near = squared_distances(x, x) <= 0.09
    core = near.sum(1) >= 4
    label = np.where(core, np.arange(len(x)), len(x))
    for _ in x:
        label = np.where(core, np.where(near & core[None, :], label[None, :], len(x)).min(1), label)
    want = [int(label[i]) if core[i] else int(min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)) for i in range(len(x))]
    got = DBSCANClusterer(0.3, 4).fit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"))
    assert {r.id: r.cluster for r in got.collect()} == dict(enumerate(want)) and -1 in want and len(set(want)) > 3


def test_folds_in_parts(spark):
    df = spark.createDataFrame([(i % 3 if i % 3 else None, i) for i in range(500)], "k int, v long")
    fold = CustomAgg("v", "total", "long", fold=lambda a, b: a + b, merge=lambda a, b: a + b)
    got = {r.k: r.total for r in _in_parts(Relation(df, "t"), ["k"], [fold], rows=20).collect()}
    assert got == {k: sum(i for i in range(500) if (i % 3 or None) == k) for k in (None, 1, 2)}
    assert {tuple(r.values()) for r in hash_aggregate(Relation(df, "t"), ["k"], [fold]).fetch_all()} == set(got.items())
    for bad in ({}, {"function": sum, "native": F.sum}, {"function": sum, "merge": max}):
        with pytest.raises(ValueError):
            CustomAgg("v", "x", **bad)


def test_expected_information_is_the_mean_over_all_orders(spark):
    labels = [0, 0, 0, 1, 1, 2]
    other = [0, 0, 1, 1, 1, 1]
    told = []
    for turned in set(itertools.permutations(other)):
        n = len(labels)
        cells = Counter(zip(labels, turned))
        told.append(sum(c / n * math.log(n * c / (labels.count(a) * other.count(b))) for (a, b), c in cells.items()))
    sizes = spark.createDataFrame([(a, ca, b, cb) for a, ca in Counter(Counter(labels).values()).items() for b, cb in Counter(Counter(other).values()).items()], "a long, ca long, b long, cb long")
    assert expected_mi(sizes, 6) == pytest.approx(sum(told) / len(told))


def test_calc_bleu(spark):
    truth, found = spark.createDataFrame([("the red bolt is here", 1), ("a ring", 2)], "t string, n int"), spark.createDataFrame([("the red bolt is there", 1), ("zzz", 9)], "t string, n int")
    got = calc_bleu(truth, found, ["t", "n"]).first()
    for n in range(1, 5):
        want = [max(bleu(text_tokens(f"{p.t}, {p.n}"), text_tokens(f"{t.t}, {t.n}"), n) for p in found.collect()) for t in truth.collect()]
        assert got[f"bleu{n}"] == pytest.approx(sum(want) / 2)
    assert calc_bleu(truth, truth, ["t"]).first().bleu4 == 1 and calc_bleu(truth, found.limit(0), ["t"]).first().bleu1 == -1


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(None, 1), (5, None)] + [(1000, i) for i in range(1001, 1060)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(200):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusterers(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[20, 20]]])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")

    def groups(c):
        out = {}
        for r in c.fit(df).collect():
            out.setdefault(r.cluster, set()).add(r.id)
        return out

    blobs = [set(range(30)), set(range(30, 60))]
    for c in (DBSCANClusterer(1.0, 3), HDBSCANClusterer(5)):
        found = groups(c)
        assert found.pop(-1) == {60} and sorted(found.values(), key=min) == blobs
    assert sorted(map(len, groups(KMeansClusterer(3)).values())) == [1, 30, 30]
    assert len(groups(DBSCANClusterer(0.05, 1, "cosine"))) >= 1
    assert set(groups(CallableClusterer(lambda m: np.arange(len(m)) % 2))) == {0, 1}
    with pytest.raises(ValueError):
        CallableClusterer(len, max_rows=5).fit(df)
    for bad in ({}, {"k": 1, "relative": 0.5}, {"relative": 1.5}):
        with pytest.raises(ValueError):
            KMeansClusterer(**bad)
    empty = df.where("id < 0")
    for c in (DBSCANClusterer(), HDBSCANClusterer(), KMeansClusterer(2)):
        assert c.fit(empty).count() == 0


def test_soft_aggregate(spark):
    rows = values(spark, "m", ["title", "studio", "n"], [("a", "Disney", 1), ("b", "disney", 2), ("c", "Fox", 4), ("d", None, 8)], "title string, studio string, n int")
    model = LetterEmbedding()
    got = soft_aggregate(rows, ["studio"], [Sum("n", "n"), SetAgg("title", "t")], model, DBSCANClusterer(0.1, 1), serializer=lambda c: F.coalesce(plain(c), F.lit("")))
    assert same(got.fetch_all(), [{"studio": ["Disney", "disney"], "n": 3, "t": ["a", "b"]}, {"studio": ["Fox"], "n": 4, "t": ["c"]}, {"studio": [None], "n": 8, "t": ["d"]}])
    # noise points are groups of their own, and the groups part the input
    alone = soft_aggregate(rows, ["studio", "title"], [Count("n", "k")], model, DBSCANClusterer(0.1, 3), form="FIELD_SERIALIZED")
    assert len(alone.fetch_all()) == 4 and sum(r["k"] for r in alone.fetch_all()) == 4
    named = soft_aggregate(rows, ["studio"], [Sum("n", "n")], model, DBSCANClusterer(0.1, 1), summary=EchoGenerator(), summary_prompt="Of ")
    assert "of disney, disney" in {r["key"] for r in named.fetch_all()} and named.columns == ["key", "n"]
    flat = soft_aggregate(rows, ["studio"], [Sum("n", "n")], model, KMeansClusterer(2), reduce_dimensions=2, serializer=braced)
    assert sum(r["n"] for r in flat.fetch_all()) == 15
    assert soft_aggregate(select(rows, HardEqual(Col("n"), Const(0))), ["studio"], [Sum("n", "n")], model, DBSCANClusterer(1, 1)).fetch_all() == []


def test_metrics(spark, objects):
    t, p = spark.createDataFrame([(1, 2), (3, 4), (5, None)], "a int, b int"), spark.createDataFrame([(1, 2), (1, 2), (9, 9), (5, None)], "a int, b int")
    got = match_metrics(t, p, ["a", "b"]).first()
    assert (got.tp, got.fp, got.fn) == (2, 1, 1) and got.precision == got.recall == got.f1 == pytest.approx(2 / 3)
    assert match_metrics(t.limit(0), p.limit(0), ["a"]).first().f1 == 0
    s = spark.createDataFrame([(0.9, True), (0.6, False), (0.5, True), (0.1, None)], "s double, t boolean")
    rows = {r.threshold: (r.tp, r.fp, r.fn) for r in threshold_sweep(s, "s", "t", [0.5, 0.95, 0.6]).collect()}
    assert rows == {0.5: (2, 1, 0), 0.6: (1, 1, 1), 0.95: (0, 0, 2)}
    same_ = spark.createDataFrame([(i, i // 3, i // 3) for i in range(9)], "i int, a int, b int")
    assert all(v == pytest.approx(1) or k == "mi" for k, v in cluster_scores(same_, "a", "b").items())
    other = cluster_scores(spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 2)], "a int, b int"), "a", "b")
    # values of the closed forms, by hand
    assert other["rand"] == pytest.approx(9 / 15) and other["ari"] == pytest.approx((2 - 6 * 4 / 15) / ((6 + 4) / 2 - 6 * 4 / 15)) and other["fmi"] == pytest.approx(2 / math.sqrt(24))
    assert other["homogeneity"] == pytest.approx(0.5408520829727557) and other["ami"] < other["nmi"] < 1
    assert bleu("a b c d".split(), "a b c d".split()) == pytest.approx(1) and bleu(["a"], []) == 0 and bleu(["a"], ["b"]) == 0
    texts, outs = spark.createDataFrame([(1, "a b c d"), (1, "x y")], "g int, t string"), spark.createDataFrame([(1, "a b c d")], "g int, o string")
    assert bleu_representativeness(texts, "t", outs, "o", "g").first().bleu == pytest.approx(0.5)
    classes = values(spark, "c", ["class"], [("car brand",)])
    assert {r["object"] for r in classify_one_vs_all(objects, classes, ["object"], "class", WORLD, 0.9).fetch_all()} == set(CARS)


def test_nested(spark):
    inner = '{"name": ["n"], "own": [{"id": "o1", "properties": {"of": [{"id": "p1", "properties": {}}, null, {"id": null, "properties": {"of": {"id": 7}}}]}}], "s": ["plain"], "x": {"id": "x1"}}'
    wrapped = '"{\\"own\\": {\\"id\\": \\"w\\"}}"'
    rows = [("e1", inner, '["r1", null, "r1"]', 1), ("e2", wrapped, '"r2"', 1), ("e2", "{broken", '"[\\"r3\\"]"', 1), ("e3", None, "null", 1), (None, "", "[]", 1)]
    df = spark.createDataFrame(rows, "id string, properties string, referents string, row int")
    nodes = nested_nodes(df, "id", "properties")
    got = {(r.record_id, r.parent_id, r.prop, r.child_id) for r in nested_objects(nodes).collect()}
    assert got == {("e1", "e1", "own", "o1"), ("e1", "o1", "of", "p1"), ("e1", "o1", "of", "7"), ("e1", "e1", "x", "x1"), ("e2", "e2", "own", "w")}
    assert sorted((r.record_id, r.child_id) for r in nested_strings(nested_nodes(df, "id", "referents")).collect()) == [("e1", "r1"), ("e1", "r1"), ("e2", "r2"), ("e2", "r3")]
    table = {r.id: r for r in child_table(nodes, "of").collect()}
    # values of several shapes keep their JSON text
    assert set(table) == {'"p1"', "7", "null"}
    parents = {r.node for r in nodes.collect()}
    assert all(r._parent_node in parents for r in table.values()) and table['"p1"']._ordinal == 0
    assert nested_objects(nested_nodes(df.limit(0), "id", "properties")).count() == 0
    wrapped = '{"a": {"id": "deep"}}'
    for _ in range(6):
        wrapped = json.dumps(wrapped)
    deep = spark.createDataFrame([("e9", " \n" + wrapped, '"no json"')], "id string, p string, q string")
    both = nested_nodes(deep, "id", ["p", "q"])
    assert [(r.source, r.child_id) for r in nested_objects(both).collect()] == [("p", "deep")] and nested_strings(both.where("source = 'q'")).first().child_id == "no json"
    with pytest.raises(ValueError):
        child_table(nested_nodes(spark.createDataFrame([("e", json.dumps({"x": {f"f{i}": i for i in range(9)}}))], "id string, p string"), "id", "p"), "x", max_fields=5)


def test_nested_tables_are_whole(spark):
    """Any number of properties and fields, and the rows that parents lead to."""
    many = {f"p{i}": {"id": i} for i in range(600)}
    wide = {"id": "w", "it's": {"id": 1}, "n": None, "t": [1, "x"]} | {f"f{i}": i + 0.5 for i in range(9)}
    rows = [("e1", json.dumps(many), '["r1", null, 7]'), ("e2", json.dumps({"name": ["n"], "wide": [wide, {}, "plain", {"f1": True}]}), '[{"id": "o"}]'), ("e3", "null", "{broken")]
    df = spark.createDataFrame(rows, "id string, p string, q string")
    nodes = nested_nodes(df, "id", ["p", "q"])
    tables = child_tables(nodes)
    assert len(tables) == 603 and set(tables) == set(many) | {None, "wide", "it's"}
    assert [r.id for r in tables["p599"].collect()] == [599] and "p600" not in tables
    assert sorted((r.record_id, r._value) for r in tables[None].select("record_id", "_value").collect() if r._value) == [("e1", '"r1"'), ("e1", "7")]
    # a row each for all objects; every parent is a row
    cells = [r.asDict() for r in child_cells(nodes).collect()]
    assert len(cells) == 600 + 5 + 4 and {r["parent_node"] for r in cells} - {None} <= {r["node"] for r in cells}
    assert sorted(r["cells"] for r in cells if r["prop"] is None and r["record_id"] == "e1" and len(r["cells"]) < 9) == ['"r1"', "7"]
    assert len(json.loads(next(r["cells"] for r in cells if r["prop"] is None and r["record_id"] == "e1" and len(r["cells"]) > 9))) == 600
    got = sorted((r["cells"] for r in cells if r["prop"] == "wide"), key=len)
    assert got[:2] == ["{}", '{"f1":"true"}'] and json.loads(got[2]) == {"id": "w", "it's": '{"id":1}', "n": "null", "t": '[1,"x"]'} | {f"f{i}": str(i + 0.5) for i in range(9)}
    # wider than a table or a map may be: the same cells
    assert sorted(map(repr, cells)) == sorted(repr(r.asDict()) for r in child_cells(nodes, most_fields=2).collect())
    fields = [r._fields for r in child_tables(nodes, max_fields=5)["wide"].collect()]
    assert sorted(map(len, fields)) == [0, 1, 13] and max(fields, key=len)["it's"] == '{"id":1}'
    assert sorted(r["it's"] or "" for r in tables["wide"].collect()) == ["", "", '{"id":1}']
    assert not child_tables(nested_nodes(df.limit(0), "id", ["p", "q"])) and not child_cells(nested_nodes(df.limit(0), "id", "p")).count()


def test_streams(spark, tmp_path, data):
    from semframe.plans.queries import QUERIES
    from semframe.operators.criteria import GreaterThan
    from semframe.operators.joins import hash_join
    from semframe.operators.project import project
    from semframe.operators.union import union
    from semframe.relation import Relation
    from semframe.streaming.streams import run_available, stream_folder, windowed_aggregate

    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    kinds = values(spark, "kinds", ["event_type", "kind"], [(r.event_type, r.event_type.upper()) for r in events.select("event_type").distinct().collect()])

    def plan(source):
        some = project(select(source, GreaterThan(Col("value"), Const(10))), ["event_id", "event_type", "value"])
        return hash_join(union([some, some]), kinds, f"{some.name}.event_type", "kinds.event_type")

    stream = stream_folder(spark, "events", str(tmp_path / "in"), events.schema)
    assert same(run_available(plan(stream), str(tmp_path / "out")).collect(), plan(Relation(events, "events")).df.collect())
    counted = windowed_aggregate(stream, "ts", "1 day", "365 days", ["event_type"], [Count("event_id", "n")])
    got = run_available(counted, str(tmp_path / "agg"))
    whole = {(r.window_start, r.event_type): r.n for r in QUERIES["stream_windows"](spark, data).collect()}
    assert all(whole[(r.window_start, r.event_type)] == r.n for r in got.collect())
