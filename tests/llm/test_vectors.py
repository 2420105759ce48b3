"""Embedding operators against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import vectors


def clusters(seed, crowd=90, others=150, dim=16):
    rng = np.random.default_rng(seed)
    center = rng.standard_normal(dim)
    near = [center + 0.12 * rng.standard_normal(dim) for _ in range(crowd)]
    alone = [rng.standard_normal(dim) for _ in range(others)]
    pairs = [a + 0.05 * rng.standard_normal(dim) for a in alone[:40]]
    x = np.array(near + alone + pairs, "f4")
    label = np.array([1] * crowd + [i % 3 for i in range(others)] + [i % 3 for i in range(40)])
    return x, label


def brute(ids, x, label, least):
    u = x.astype("f8")
    u /= np.linalg.norm(u, axis=1)[:, None]
    good = (u @ u.T >= least) & (label[:, None] == label)
    np.fill_diagonal(good, False)
    comp = np.array(ids)
    while True:
        new = np.minimum(comp, np.where(good, comp[None, :], 10**9).min(1))
        if (new == comp).all():
            return good.sum(1), comp
        comp = new


def run(spark, rows, kind="vec_id bigint, embedding array<float>, label int, uid string, dim string"):
    return {r["vec_id"]: r for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, kind)).collect()}


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates(spark, monkeypatch, block):
    """With blocks of 16 the crowd is far larger than a window."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    x, label = clusters(3)
    ids = np.random.default_rng(1).permutation(len(x)) + 100
    rows = [(int(i), [float(v) for v in e], int(y), "a", "b") for i, e, y in zip(ids, x, label, strict=True)]
    rows += [(9001, None, 1, "a", "b"), (9002, [], 1, "a", "b"), (9003, [0.0] * 16, 1, "a", "b"), (9004, [float("nan")] * 16, 1, "a", "b"), (9005, rows[0][1], None, "a", "b"), (9006, [None] + [1.0] * 15, 1, "a", "b"), (9007, [1.0, 2.0], 1, "a", "b"), (9008, [1.0, 2.0], 1, "a", "b")]
    got = run(spark, rows)
    n, comp = brute(ids, x, label, 0.93)
    found = np.array([got[int(i)]["n_links"] for i in ids])
    assert (found <= n).all() and found.sum() >= 0.99 * n.sum()
    assert [got[int(i)]["component_id"] for i in ids] == comp.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(9001, 9007))
    assert got[9007]["n_links"] == got[9008]["n_links"] == 1 and not got[9008]["kept"] and got[9008]["component_id"] == 9007
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_crowd_over_many_partitions(spark, monkeypatch):
    """Copies that fill several range partitions and many blocks: each links with all others."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = run(spark, [(i, [1.0, 2.0, 3.0, -1.0], 1) for i in range(400)], "vec_id bigint, embedding array<float>, label int")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    assert sum(r["n_links"] for r in got.values()) == 400 * 399
    assert {r["n_links"] for r in got.values()} == {399} and {r["component_id"] for r in got.values()} == {0}


def test_every_link_of_a_crowd(spark, monkeypatch):
    """Near copies that the first signs split, and copies of one vector that start and end inside a block."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = np.array([c + 0.25 * rng.standard_normal(24) for c in rng.standard_normal((2, 24)) for _ in range(110)], "f4")
    x = np.concatenate([x, np.repeat(rng.standard_normal((1, 24)), 130, 0).astype("f4"), rng.standard_normal((60, 24)).astype("f4")])
    label, ids = np.ones(len(x), int), rng.permutation(len(x))
    got = run(spark, [(int(i), [float(v) for v in e], 1) for i, e in zip(ids, x, strict=True)], "vec_id bigint, embedding array<float>, label int")
    n, comp = brute(ids, x, label, 0.93)
    assert [got[int(i)]["n_links"] for i in ids] == n.tolist(), (sum(r["n_links"] for r in got.values()), n.sum())
    assert [got[int(i)]["component_id"] for i in ids] == comp.tolist()


def test_passes_follow_the_rows():
    at = [vectors.passes_for(n, 0.93) for n in (0, 1, 512, 10**5, 10**6, 10**7, 10**8)]
    assert at == sorted(at) and at[:3] == [vectors.PASSES] * 3 and at[-2] > at[3] > vectors.PASSES


def test_repeated_rows_and_nothing(spark):
    kind = "vec_id bigint, embedding array<double>, label int"
    got = vectors.near_duplicate_vectors(spark.createDataFrame([(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (None, [1.0, 0.0], 5)], kind)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)], key=str)
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], kind)).count() == 0


def test_labels_of_other_types(spark):
    rows = [(1, [1.0, 0.0], 1.2, "a"), (2, [1.0, 0.0], 1.7, "b"), (3, [1.0, 0.1], 1.7, "a"), (4, [1.0, 0.0], None, None)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x double, y string")
    comps = lambda c: {r["vec_id"]: r["component_id"] for r in vectors.near_duplicate_vectors(table, label_col=c).collect()}
    assert comps("x") == {1: 1, 2: 2, 3: 2, 4: 4} and comps("y") == {1: 1, 2: 2, 3: 1, 4: 4}


def nearest(ids, x, query, k):
    s = x.astype("f8") @ x[list(ids).index(query)].astype("f8")
    order = sorted((-v, i) for v, i in zip(s, ids, strict=True) if i != query)
    return [(i, -v) for v, i in order[:k]]


@pytest.mark.parametrize(("shard", "beam"), [(8192, 320), (150, 48)])
def test_nearest(spark, monkeypatch, shard, beam):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "BEAM", beam)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((600, 12)) * rng.uniform(0.5, 2, (600, 1))).astype("f4")
    ids = rng.permutation(600)
    kind = "vec_id bigint, embedding array<float>, score string, links int"
    rows = [(int(i), [float(v) for v in e], "s", 1) for i, e in zip(ids, x, strict=True)] + [(7000, None, "s", 1), (7020, [0.0] * 12, "s", 1), (None, [1.0] * 12, "s", 1)]
    got: dict = {}
    for r in vectors.nearest_neighbours(spark.createDataFrame(rows, kind), "vec_id % 20 = 0", k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        want = nearest(ids, x, q, 20)
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        exact = dict(nearest(ids, x, q, 600))
        assert all(abs(exact[v] - s) < 1e-9 for _, v, s in found)
        hits += len({v for v, _ in want} & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("stretch", [1.0, 3e6, 1e-30])
def test_recall_of_the_graph(spark, monkeypatch, stretch):
    """Structureless vectors in several shards, far more nodes than a search starts from or keeps, one of them stretched."""
    monkeypatch.setattr(vectors, "SHARD", 6000)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((21_000, 32)).astype("f4")
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= stretch
    table = spark.createDataFrame(pa.table({"my_vec_id": np.arange(len(x)), "e": pa.array(list(x))})).repartition(4)
    got = vectors.nearest_neighbours(table, "my_vec_id % 100 = 0", k=20, id_col="my_vec_id", vec_col="e").toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x.astype("f8") @ x[q].astype("f8")
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
    assert got["query_id"].nunique() == 210 and hits >= 0.9 * 20 * 210


def test_equal_vectors_and_ties(spark):
    """Of far more equal vectors than a result holds, those with the smallest ids; a query is not among its own."""
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(1, 120)] + [(200 + i, [2.0, 1.0, 0.0]) for i in range(10)]
    got: dict = {}
    for r in vectors.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id % 20 = 0 or vec_id = 3", k=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert list(got[20].values()) and [got[20][i] for i in range(1, 21)] == [i for i in range(1, 22) if i != 20]
    assert [got[3][i] for i in range(1, 21)] == [i for i in range(1, 22) if i != 3]
    assert [got[200][i] for i in range(1, 21)] == [*range(201, 210), *range(1, 12)]  # 5.0 with its own kind, 4.0 with the others


def test_few_candidates(spark):
    kind = "vec_id bigint, embedding array<float>"
    got = vectors.nearest_neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [1.0])], kind), k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 2), (0, 2, 3), (0, 3, 20), (20, 1, 0), (20, 2, 2), (20, 3, 3)]
    assert vectors.nearest_neighbours(spark.createDataFrame([], kind)).count() == 0
