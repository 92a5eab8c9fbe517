"""Vector operators against brute force, and the shared components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.llm import ann, nndescent
from matchlake.llm._common import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [1.0, None] + [1.0] * 14, 1), (None, [1.0] * 16, 1), (9006, [], 1), (9020, [1.0, 2.0], 1)]


def cloud(rng, n, groups=0, dim=16):
    rows = []
    for i in range(n):
        if groups and i % 3 == 0 and rows:
            base = np.array(rng.choice(rows)[1])
            v = base + np.random.default_rng(i).standard_normal(dim) * np.linalg.norm(base) * rng.choice([0, 0.01, 0.03, 0.06])
        else:
            v = np.random.default_rng(i + 10_000).standard_normal(dim)
        rows.append((i, [float(np.float32(x)) for x in v], rng.randrange(3) if i % 3 or not rows else rows[-1][2]))
    return rows


def true_links(rows, threshold):
    v = np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    links = (v @ v.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    return links


def components(links, ids):
    above = list(range(len(ids)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in zip(*np.nonzero(links)):
        a, b = sorted((root(i), root(j)))
        above[b] = a
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


@pytest.mark.parametrize("leaf, tile", [(256, 1024), (32, 16)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, leaf, tile):
    monkeypatch.setattr(nndescent, "LEAF", leaf)
    monkeypatch.setattr(nndescent.trees_for, "__defaults__", (0.98, 0.999, leaf))
    monkeypatch.setattr(nndescent, "TILE", tile)
    rows = cloud(random.Random(8), 400, groups=1)
    links = true_links(rows, 0.98)
    want = components(links, [r[0] for r in rows])
    frame = spark.createDataFrame([*rows, *ODD, (9100, rows[0][1], None)], SCHEMA).withColumn("rep", F.lit(1)).withColumn("v", F.lit(2))
    found = {r["id"]: r for r in nndescent.near_duplicates(frame).collect()}
    assert len(found) == 400 + len(ODD) + 1
    wrong = [i for i, r in enumerate(rows) if found[r[0]]["n_links"] != links[i].sum()]
    assert len(wrong) <= 400 * 0.01
    if leaf == 256:
        assert not wrong and all(found[i]["component_id"] == c and found[i]["kept"] == (i == c) for i, c in want.items())
    for i in (9001, 9002, 9003, 9004, 9005, 9006, 9020, 9100):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)


def test_a_saturated_list_grows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + rng.standard_normal(16) * 0.01], 1) for i in range(120)]
    found = nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA), neighbours=3).collect()
    assert all(r["n_links"] == 119 and r["component_id"] == 0 for r in found)


def test_near_duplicates_of_nothing(spark):
    assert nndescent.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nndescent.near_duplicates(spark.createDataFrame(ODD, SCHEMA)).where("n_links > 0").count() == 0


def test_trees_reach_the_recall():
    for n in (10, 10_000, 10_000_000):
        depth, trees = nndescent.trees_for(n)
        together = (1 - math.acos(0.98) / math.pi) ** depth
        assert 1 - (1 - together) ** trees >= 0.999 - 1e-9


def test_search_finds_the_nearest(spark):
    rows = cloud(random.Random(4), 1500, groups=1)
    frame = spark.createDataFrame([*rows, *ODD], SCHEMA).withColumn("list", F.lit(1))
    found = ann.search(frame, F.col("vec_id") % 20 == 0).toPandas()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = (v * v[q]).sum(axis=1)
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))][:20]
        own = found[found["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own["score"], score[own["vec_id"]], rtol=1e-12)
        order = np.lexsort((own["vec_id"].to_numpy(), -own["score"].to_numpy()))
        assert (order == np.arange(20)).all()
        hits += len(set(best) & set(own["vec_id"]))
        total += 20
    assert hits / total >= 0.9
    assert not set(found["query_id"]) & {9002, 9006} and 9020 not in set(found["vec_id"])


def test_search_with_few_candidates_and_ties(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 15)] + [(20, [1.0, 0.0], 0), (40, [0.0, 3.0], 0)]
    found = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    own = [r["vec_id"] for r in found if r["query_id"] == 20]
    assert own == [*range(15), 40] and [r["rank"] for r in found if r["query_id"] == 20] == list(range(1, 17))
    assert ann.search(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_large_lists_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 8)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 3)
    rows = cloud(random.Random(5), 300)
    found = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).toPandas()
    assert len(found) == 15 * 20 and not found.duplicated(["query_id", "vec_id"]).any()


def test_of_rows_that_share_an_id_the_best_counts(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [9.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, [3.0, 0.0], 0), (20, [1.0, 0.0], 0)]
    found = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 9.0), (2, 3.0)]


@pytest.mark.parametrize("share, size", [(0.2, 1.0), (0.9, 1e30)])
def test_nearest_in_the_lists_that_a_query_wants(share, size):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 8)) * size
    v[100:160] = v[100]
    ids = rng.permutation(3000) // 2  # each id twice
    lists = [(at, at + 100) for at in range(0, 3000, 100)]
    wanted = rng.random((40, 30)) < share
    i, j, s = ann.nearest(v[:40], ids[:40], v, ids, 20, lists, wanted)
    for n in range(40):
        best = {}
        for c in np.flatnonzero(np.repeat(wanted[n], 100) & (ids != ids[n])).tolist():
            best[ids[c]] = max(best.get(ids[c], -np.inf), (v[n] * v[c]).sum())
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert list(zip(j[i == n], s[i == n])) == want


def test_a_walk_and_all_distances_find_the_same_centroids(monkeypatch):
    rng = np.random.default_rng(3)
    centres, q = rng.standard_normal((600, 6)), rng.standard_normal((50, 6))
    direct = ann.CentroidGraph(centres, rng).search(q, 16)
    monkeypatch.setattr(ann, "DIRECT", 100)
    walked = ann.CentroidGraph(centres, rng).search(q, 16)
    assert np.mean([len(set(a) & set(b)) / 16 for a, b in zip(direct[0], walked[0])]) > 0.95
    assert (direct[0] == squared_order(q, centres, 16)).all() and np.allclose(direct[1], np.sqrt(np.take_along_axis(ann.squared(q, centres), direct[0], axis=1)), atol=1e-5)


def squared_order(q, centres, k):
    return np.argsort(ann.squared(q, centres), axis=1)[:, :k]


@pytest.mark.parametrize("native", [False, True])
def test_components_of_random_graphs_and_chains(spark, native):
    rng = random.Random(0)
    for edges in ([(i, i + 1) for i in range(200)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(0, i) for i in range(1, 100)], [(5, 5), (None, 3)], []):
        frame = spark.createDataFrame(edges, "a long, b long")
        above = {}

        def root(i, above=above):
            while above.setdefault(i, i) != i:
                i = above[i]
            return i

        for a, b in edges:
            if a is not None and b is not None and a != b:
                x, y = sorted((root(a), root(b)))
                above[y] = x
        found = {r["node"]: r["component"] for r in connected_components(frame, native=native).collect()}
        assert found == {i: root(i) for i in above}
