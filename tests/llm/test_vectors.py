"""Similar vectors and clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semframe.llm import queries as Q
from semframe.llm.density_clusters import density_clusters, describe_clusters, follow
from semframe.llm.multi_index import as_binary, as_matrix, unit_rows, walk
from semframe.llm.similar_vectors import most_similar, nearest_of, recall_against_all

DIM = 8


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, chunk_id long, e array<float>, vec string, vid long, k0 long")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, DIM)) * 3
    noise = rng.normal(size=(150, DIM))
    balls = np.concatenate([c + rng.normal(size=(20, DIM)) * 0.35 for c in centres])
    return np.concatenate([noise, balls]).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark, vectors):
    rows = [(i // 3, i % 3, v.tolist(), "clash", 0, 1) for i, v in enumerate(vectors)]
    rows += rows[:5]  # delivered twice
    rows += [(900, 0, None, None, None, None), (901, 0, [0.0] * DIM, None, None, None), (902, 0, [float("nan")] * DIM, None, None, None), (903, 0, [1.0] * 3, None, None, None), (904, 0, [None] + [1.0] * (DIM - 1), None, None, None), (None, 0, [1.0] * DIM, None, None, None)]
    rows += [(1000 + i, 0, [2.0 * x for x in vectors[0].tolist()], "copy", 0, 1) for i in range(9)]
    return frame(spark, rows)


def unit(vectors):
    return vectors / np.sqrt((vectors.astype(np.float64) ** 2).sum(1, keepdims=True))


def test_most_similar_is_brute_force(spark, table, vectors):
    every = np.concatenate([vectors, [vectors[0]] * 9])
    keys = [(i // 3, i % 3) for i in range(len(vectors))] + [(1000 + i, 0) for i in range(9)]
    c = unit(every) @ unit(every).T
    np.fill_diagonal(c, -2)
    got = {((r.a_id, r.a_chunk_id), (r.b_id, r.b_chunk_id)): r.cosine for r in most_similar(table, ["id", "chunk_id"], "e", 3, 0.9, dim=DIM).collect()}
    first = {0, *range(len(vectors), len(every))}  # the copies
    want = set()
    for i in range(len(every)):
        if i in first:
            continue
        near = sorted((j for j in range(len(every)) if c[i, j] >= 0.9 and j not in first), key=lambda j: -c[i, j])[:3]
        want |= {tuple(sorted((keys[i], keys[j]))) for j in near}
    plain = {p for p in got if not any(keys.index(k) in first for k in p)}
    assert plain == want
    assert all(got[p] == pytest.approx(c[keys.index(p[0]), keys.index(p[1])], abs=1e-5) for p in plain)
    copies = {p for p in got if all(keys.index(k) in first for k in p)}
    assert all(sum(keys[i] in p for p in copies) >= 3 for i in first) and len(copies) <= 3 * 10
    assert all(a < b for a, b in got)


def test_recall(spark, table):
    told = recall_against_all(table, ["id", "chunk_id"], "e", every=5, dim=DIM, wanted=200)
    assert told["recall"] >= 0.9 and told["queries"] > 20


def test_nearest_of(spark, table, vectors):
    rows = nearest_of(table, ["id", "chunk_id"], "e", every=7, k=4, dim=DIM, wanted=10**6).collect()
    keys = [(i // 3, i % 3) for i in range(len(vectors))]
    c = unit(vectors) @ unit(vectors).T
    np.fill_diagonal(c, -2)
    asked = {(r.id, r.chunk_id) for r in rows}
    assert asked == {k for k in keys if k[0] % 7 == 0} | {(k, 0) for k in range(1000, 1009) if k % 7 == 0}
    for i, k in enumerate(keys):
        if k in asked and k != (0, 0):
            mine = sorted((r for r in rows if (r.id, r.chunk_id) == k), key=lambda r: r["rank"])
            assert [r.cosine for r in mine] == pytest.approx(np.sort(c[i])[::-1][:4].tolist(), abs=1e-5)


def test_small_inputs(spark, table):
    none = table.limit(0)
    assert most_similar(none, ["id"], "e", dim=DIM).count() == 0 and density_clusters(none, ["id"], "e", dim=DIM).count() == 0
    one = frame(spark, [(1, 0, [1.0] * DIM, None, None, None)])
    assert most_similar(one, ["id"], "e", dim=DIM).count() == 0 and density_clusters(one, ["id"], "e", dim=DIM).count() == 0


@pytest.mark.parametrize("fit", [{}, {"cell_rows": 8, "block_rows": 16, "wanted": 120, "probes_a_task": 50}])
def test_clusters_are_components(spark, table, vectors, fit):
    every = np.concatenate([vectors, [vectors[0]] * 9])
    keys = [(i // 3, i % 3) for i in range(len(vectors))] + [(1000 + i, 0) for i in range(9)]
    near = unit(every) @ unit(every).T >= 0.9
    label = np.arange(len(every))
    for _ in range(len(every)):
        new = np.where(near, label[None, :], len(every)).min(1)
        if (new == label).all():
            break
        label = new
    want = {}
    for i, first in enumerate(label):
        if (label == first).sum() >= 5:
            want[keys[i]] = (min(keys[j] for j in np.flatnonzero(label == first)), int((label == first).sum()))
    rows = density_clusters(table, ["id", "chunk_id"], "e", 0.9, 5, dim=DIM, **fit)
    got = {(r.id, r.chunk_id): ((r.first_id, r.first_chunk_id), r.size) for r in rows.collect()}
    assert got == want and len(set(want.values())) > 5
    told = describe_clusters(rows, ["id", "chunk_id"]).collect()
    assert len(told) == len(set(want.values())) and all(len(t.typical) == 3 for t in told)


def test_walk_is_sorted_and_complete():
    rng = np.random.default_rng(0)
    first, second = rng.random((1, 5)), rng.random((1, 7))
    sizes = rng.integers(0, 3, (5, 7))
    cells = next(walk(first, second, sizes, 10**9))
    sums = [first[0, i] + second[0, j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == (sizes > 0).sum()
    few = next(walk(first, second, sizes, 4))
    assert few == cells[: len(few)] and sum(sizes[c] for c in few) >= 4
    assert len(next(walk(first, second, sizes, 1, min_cells=6))) == 6
    first, second, sizes = rng.random((20, 30)), rng.random((20, 40)), rng.integers(0, 3, (30, 40))
    for wanted in (1, 30, 10**9):
        assert list(walk(first, second, sizes, wanted, nearest=5)) == list(walk(first, second, sizes, wanted, nearest=50))


def test_bytes_and_pointers(spark):
    import pyarrow as pa

    m = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (as_matrix(as_binary(m).slice(1), 4) == m[1:]).all() and len(as_matrix(pa.array([], pa.binary()), 4)) == 0
    usable, rows = unit_rows(pa.array([[3.0, 4.0], None, [0.0, 0.0], [1.0], [float("inf"), 0.0]], pa.list_(pa.float32())), 2)
    assert usable.tolist() == [True, False, False, False, False] and rows.tolist() == [[pytest.approx(0.6), pytest.approx(0.8)]]
    chain = spark.createDataFrame([(i, max(0, i - 1)) for i in range(20)], "vid long, up long")
    assert {r.label for r in follow(chain).collect()} == {0}


def test_queries_name_their_columns(spark, data):
    assert Q.p1_found(spark, data).columns == ["collection", "id_a", "chunk_a", "id_b", "chunk_b"]
    found = Q.p3_found(spark, data)
    assert found.columns == ["collection", "id", "chunk_id", "first_id", "first_chunk_id"] and found.where(F.col("first_id") > F.col("id")).count() == 0
