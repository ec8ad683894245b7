"""Neighbour graphs, density clusters and layouts against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import density, neighbours

SF = "/root/testdata/sf0.01"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, v array<double>")


def brute_graph(x, k, metric):
    """(i, j) -> distance of the k nearest rows of each row."""
    d = neighbours.distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)): d[i, j] for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (d[i, j], j))[: min(k, len(x) - 1)] if j != i}


def brute_forest(graph, n, min_samples):
    """Kruskal over mutual reachability."""
    near = {i: sorted(d for (a, _), d in graph.items() if a == i)[:min_samples] for i in range(n)}
    core = {i: ds[-1] if ds else 0.0 for i, ds in near.items()}
    edges = {}
    for (i, j), d in graph.items():
        edges[min(i, j), max(i, j)] = max(d, core[i], core[j])
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    kept = []
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if find(a) != find(b):
            root[find(b)] = find(a)
            kept.append((a, b, w))
    return kept


def brute_topics(forest, n, least, method):
    """Clusters from the top down: take away the heaviest edge, see which sides are large enough."""

    def parts(nodes, edges):
        left, out = set(nodes), []
        by = {}
        for a, b, w in edges:
            by.setdefault(a, []).append(b)
            by.setdefault(b, []).append(a)
        while left:
            stack, group = [min(left)], set()
            while stack:
                v = stack.pop()
                if v not in group:
                    group.add(v)
                    stack += by.get(v, [])
            left -= group
            out.append(group)
        return out

    def grow(nodes, edges, birth):
        """(rows, stability, children) of the cluster that these rows are at first."""
        rows, total, mine = set(nodes), 0.0, set(nodes)
        while True:
            inner = sorted((e for e in edges if e[0] in mine and e[1] in mine), key=lambda e: (e[2], e[0], e[1]))
            if not inner:
                raise AssertionError("a cluster has edges")
            density = 1 / max(inner[-1][2], density_least)
            sides = parts(mine, inner[:-1])
            big = [s for s in sides if len(s) >= least]
            if len(big) == 1:
                total += (len(mine) - len(big[0])) * (density - birth)
                mine = big[0]
            else:
                total += len(mine) * (density - birth)
                return rows, total, [grow(s, inner[:-1], density) for s in big]

    density_least = density.LEAST
    tops = [grow(p, forest, 0.0) for p in parts(range(n), forest) if len(p) >= least]

    def pick(node, whole):
        rows, total, children = node
        below = [pick(c, False) for c in children]
        worth = sum(w for w, _ in below)
        chosen = [g for _, gs in below for g in gs]
        if not whole and (not children or (method == "eom" and total >= worth)):
            return total, [rows]
        return worth, chosen

    groups = [g for t in tops for g in pick(t, len(tops) == 1)[1]]
    return {frozenset(g) for g in groups}


def topics(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["topic_id"], set()).add(r["id"])
    return got


def blobs(rng, sizes, dims=3, gap=8.0):
    return np.concatenate([rng.normal(gap * k, 1, (n, dims)) for k, n in enumerate(sizes)] + [rng.uniform(-10, gap * len(sizes) + 10, (25, dims))]).round(6)


@pytest.mark.parametrize("method", ["eom", "leaf"])
@pytest.mark.parametrize("block", [10**6, 40])
def test_clusters_against_brute_force(spark, method, block):
    x = blobs(np.random.default_rng(4), (60, 40, 30))
    graph = neighbours.nearest_of(frame(spark, x), frame(spark, x), 12, "euclidean")
    want_graph = brute_graph(x, 12, "euclidean")
    assert {(r["id"], r["near"]) for r in graph.collect()} == set(want_graph)
    got = topics(density.cluster(graph, frame(spark, x), 8, 6, method, block))
    want = brute_topics(brute_forest(want_graph, len(x), 6), len(x), 8, method)
    noise = got.pop(-1, set())
    assert {frozenset(g) for g in got.values()} == want and len(noise) + sum(map(len, want)) == len(x) and len(want) >= 3
    assert [len(got[t]) for t in sorted(got)] == sorted(map(len, want), reverse=True) and sorted(got) == list(range(len(want)))


def test_embeddings_against_brute_force(spark):
    rows = neighbours.prepared(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding").cache()
    table = {r["id"]: r["v"] for r in rows.collect()}
    ids = sorted(table)
    x = np.array([table[i] for i in ids])
    graph = neighbours.nearest_of(rows, rows, 10)
    want_graph = brute_graph(x, 10, "cosine")
    assert {(ids.index(r["id"]), ids.index(r["near"])) for r in graph.collect()} == set(want_graph) and len(ids) == 500
    edges = density.mutual_reachability(graph, 5)
    forest = sorted((r["a"], r["b"], round(r["w"], 9)) for r in density.spanning_forest(edges).collect())
    want = brute_forest(want_graph, len(ids), 5)
    assert forest == sorted((ids[a], ids[b], round(w, 9)) for a, b, w in want)
    got = topics(density.cluster(graph, rows, 5, 5))
    got.pop(-1, None)
    assert {frozenset(g) for g in got.values()} == {frozenset(ids[i] for i in g) for g in brute_topics(want, len(ids), 5, "eom")}


def test_copies_chains_and_odd_rows(spark):
    x = [[0.0, 0.0]] * 30 + [[5.0, 5.0 + 0.01 * k] for k in range(30)] + [[100.0, 100.0]]
    rows = frame(spark, x).unionByName(spark.createDataFrame([(1000, None), (None, [0.0, 0.0]), (1001, [float("nan"), 0.0]), (1002, [1.0]), (5, [9.0, 9.0])], "id long, v array<double>"))
    ready = neighbours.prepared(rows, "id", "v", "euclidean")
    assert {r["id"]: r["v"] for r in ready.collect()}.keys() == set(range(61)) and ready.filter("id = 5").first()["v"] == [0.0, 0.0]
    got = topics(density.cluster(neighbours.nearest_of(ready, ready, 5, "euclidean"), rows.select("id"), 10, 5))
    # Row 60 leaves its cluster long before that ends, but the cluster is all that its part of the graph has.
    assert got == {0: set(range(30, 61)), 1: set(range(30)), -1: {1000, 1001, 1002}}
    nothing = ready.limit(0)
    assert density.cluster(neighbours.nearest_of(nothing, nothing, 5), nothing).count() == 0
    alone = density.cluster(neighbours.nearest_of(nothing, nothing, 5), rows.select("id"))
    assert alone.filter("topic_id = -1").count() == 64 and alone.count() == 64


def test_string_ids(spark):
    x = blobs(np.random.default_rng(1), (20, 20), 2, 30.0)
    rows = frame(spark, x).withColumn("id", F.concat(F.lit("r"), F.col("id").cast("string")))
    got = topics(density.cluster(neighbours.descend(rows, "id", "v", 6, "euclidean"), rows, 10, 5))
    assert {frozenset(g) for t, g in got.items() if t != -1} >= {frozenset(f"r{i}" for i in range(20))} or len(got) == 3


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_exact_neighbours(spark, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 4)).round(2)
    x[40:60] = x[3]  # ties go to the least id
    rows = neighbours.prepared(frame(spark, x).repartition(5), "id", "v", metric)
    table = {r["id"]: r["v"] for r in rows.collect()}
    want = brute_graph(np.array([table[i] for i in range(150)]), 7, metric)
    for block in (2048, 40):
        got = neighbours.nearest_of(rows, rows, 7, metric, block)
        assert {(r["id"], r["near"]): r["distance"] for r in got.collect()} == want
        assert got.groupBy("id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).filter("m <> 7 or n <> 7").count() == 0


def test_descent_finds_most(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    graph = neighbours.descend(vectors, "vec_id", "embedding", 15)
    assert graph.count() == 500 * 15 and graph.filter("id = near").count() == 0 and graph.select("id", "near").distinct().count() == 500 * 15
    assert neighbours.recall(graph, vectors, "vec_id", "embedding", 15) >= 0.9


def test_descent_of_many_copies(spark):
    """Copies all have the same least neighbours: no row's list may grow with their number, and none is lost."""
    x = np.concatenate([np.zeros((1500, 3)), np.random.default_rng(3).normal(5, 1, (200, 3))])
    graph = neighbours.descend(frame(spark, x), "id", "v", 5, "euclidean", rounds=4)
    near = {}
    for r in graph.collect():
        near.setdefault(r["id"], []).append(r["distance"])
    assert set(near) == set(range(1700)) and all(len(v) == 5 for v in near.values()) and all(max(near[i]) == 0 for i in range(1500))


def test_weights_against_brute_force(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))
    graph = neighbours.nearest_of(frame(spark, x), frame(spark, x), 8, "euclidean")
    lists = {}
    for r in graph.collect():
        lists.setdefault(r["id"], []).append((r["distance"], r["near"]))
    sides = {}
    for i, near in lists.items():
        first, low, high = min(near)[0], 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(math.exp(-(d - first) / mid) for d, _ in near) > math.log2(8) else (mid, high)
        for d, j in near:
            sides[i, j] = math.exp(-(d - first) / low)
    got = {(r["a"], r["b"]): r["weight"] for r in neighbours.fuzzy_weights(graph, 8).collect()}
    assert set(got) == {(min(p), max(p)) for p in sides}
    for (a, b), w in got.items():
        p, q = sides.get((a, b), 0.0), sides.get((b, a), 0.0)
        assert abs(w - (p + q - p * q)) < 1e-6


def test_layout_keeps_neighbours_better_than_components(spark):
    from plumbline.operators import vectors as V

    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    reduced = neighbours.reduce(table, "vec_id", "embedding", 5)
    places = reduced.select(F.col("vec_id").alias("id"), F.col("reduced").alias("v")).cache()
    rows = neighbours.prepared(table, "vec_id", "embedding").cache()
    components = V.reduce(rows, "v", 5).select("id", F.col("reduced").alias("v"))
    mine, theirs = neighbours.trustworthiness(rows, places), neighbours.trustworthiness(rows, components)
    assert mine > theirs and places.count() == 500 and places.filter(F.size("v") != 5).count() == 0
    # By hand, over all rows.
    before = neighbours.distances(*[np.array([r["v"] for r in rows.orderBy("id").collect()])] * 2, "cosine")
    after = neighbours.distances(*[np.array([r["v"] for r in places.orderBy("id").collect()])] * 2, "euclidean")
    cost = 0
    for i in range(500):
        near = [j for j in np.argsort(after[i], kind="stable") if j != i][:15]
        cost += sum(max(0, int((before[i] < before[i, j]).sum()) - 15) for j in near)
    assert abs(1 - cost * 2 / (500 * 15 * (1000 - 46)) - mine) < 0.01


def test_empty_tables_of_vectors(spark):
    nothing = frame(spark, [[1.0]]).limit(0)
    assert neighbours.descend(nothing, "id", "v").count() == 0
    assert neighbours.reduce(nothing, "id", "v").count() == 0
    assert neighbours.reduce(frame(spark, [[1.0, 2.0]]), "id", "v", 1).count() == 1
