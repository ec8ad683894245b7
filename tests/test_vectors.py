"""Vectors and ranks on odd tables, against brute force, for every size of block."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators import ranks, vectors

NUMBER = st.one_of(st.integers(-3, 3).map(float), st.just(0.25), st.just(float("nan")), st.just(float("inf")), st.none())
VECTOR = st.one_of(st.none(), st.lists(st.integers(-3, 3).map(float), min_size=2, max_size=2), st.lists(NUMBER, min_size=0, max_size=3))


def good(v, size=2):
    return v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), VECTOR, st.one_of(st.none(), st.sampled_from("abcde"))), max_size=12), st.lists(st.lists(st.integers(-3, 3).map(float), min_size=2, max_size=2), min_size=1, max_size=5), st.booleans())
def test_nearest_against_brute_force(spark, rows, cents, exclude):
    """Null, repeated and odd rows, string topics, ties: the same with one block and with several."""
    topics = list(zip("edcba", cents, strict=False))
    frame = spark.createDataFrame(rows, "id int, v array<double>, own string")
    table = spark.createDataFrame([*topics, (None, [9.0, 9.0]), ("z", [float("nan"), 1.0]), ("y", None), ("x", [1.0])], "topic string, centroid array<double>")
    want = []
    for i, v, own in rows:
        if good(v):
            sims = {t: round(v[0] * c[0] + v[1] * c[1], 12) for t, c in topics if not (exclude and t == own)}
            best = min(sims, key=lambda t: (-sims[t], t)) if sims else None
            want.append((i, *((own,) if exclude else ()), best, sims.get(best)))
    for block in (10_000, 2, 1):
        got = vectors.nearest(frame, "id", "v", table, "topic", exclude="own" if exclude else None, block=block)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), block


def test_nearest_of_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    none = spark.createDataFrame([], "topic string, centroid array<double>")
    assert vectors.nearest(rows, "id", "v", none, "topic").collect() == []
    some = spark.createDataFrame([("a", [1.0, 0.0])], "topic string, centroid array<double>")
    assert vectors.nearest(rows.limit(0), "id", "v", some, "topic").collect() == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abc")), VECTOR), min_size=1, max_size=20))
def test_centroids_against_brute_force(spark, rows):
    got = {r["topic"]: r["centroid"] for r in vectors.centroids(spark.createDataFrame(rows, "topic string, v array<double>").repartition(3), "topic", "v", size=2).collect()}
    want = {}
    for t, v in rows:
        if t is not None and good(v):
            want.setdefault(t, []).append(v)
    assert set(got) == set(want)
    for t, vs in want.items():
        mean = np.mean(vs, axis=0)
        length = np.linalg.norm(mean)
        assert np.allclose(got[t], mean / length if length else mean, atol=1e-9)


def test_the_commonest_length_counts(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [5.0]), ("b", [1.0, 2.0, 3.0]), ("b", None)]
    got = vectors.centroids(spark.createDataFrame(rows, "topic string, v array<double>"), "topic", "v").collect()
    assert [r["topic"] for r in got] == ["a"] and np.allclose(got[0]["centroid"], [math.sqrt(0.5)] * 2)


@pytest.mark.parametrize("block", [10_000, 2])
def test_silhouette_against_brute_force(spark, block):
    rng = np.random.default_rng(7)
    rows = [(str(i % 5), [float(x) for x in rng.normal(i % 5, 1, 3)]) for i in range(60)] + [("alone", [1.0, 2.0, 3.0]), ("0", None), (None, [1.0, 1.0, 1.0]), ("1", [float("nan"), 1.0, 1.0])]
    kept = [(t, np.array(v) / np.linalg.norm(v)) for t, v in rows if t is not None and good(v, 3)]
    want = {}
    for i, (t, v) in enumerate(kept):
        far = {}
        for j, (u, w) in enumerate(kept):
            if i != j:
                far.setdefault(u, []).append(1 - v @ w)
        a, b = np.mean(far[t]) if t in far else None, min(np.mean(d) for u, d in far.items() if u != t)
        want.setdefault(t, []).append(0.0 if a is None else (b - a) / max(a, b))
    got = {r["topic"]: (r["n"], r["silhouette"]) for r in vectors.silhouette(spark.createDataFrame(rows, "topic string, v array<double>").repartition(4), "topic", "v", block=block).collect()}
    assert set(got) == set(want)
    for t, values in want.items():
        assert got[t][0] == len(values) and abs(got[t][1] - np.mean(values)) < 1e-9


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.integers(-3, 3), st.floats(-1e300, 1e300)), min_size=1, max_size=80), st.sampled_from([1, 3, 1000]))
def test_percentiles_against_numpy(spark, values, few):
    frame = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    got = ranks.percentiles(frame, "x", [0.0, 0.1, 0.5, 0.9, 1.0], few)
    ordered = sorted(map(float, values))
    for s, v in got.items():
        at = s * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert v == low + (at - math.floor(at)) * (high - low)


def test_percentiles_of_many_rows(spark):
    """A heavy value and far outliers: ranges narrow all the same."""
    frame = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7.5 WHEN id % 1000 = 1 THEN 1e200 * id ELSE sin(id) END AS x")
    values = np.sort(frame.toPandas()["x"].to_numpy())
    got = ranks.percentiles(frame, "x", [0.001, 0.25, 0.5, 0.75, 0.9995], few=50)
    for s, v in got.items():
        assert math.isclose(v, np.quantile(values, s), rel_tol=1e-12)
    assert ranks.percentiles(frame.limit(0), "x", [0.5]) == {0.5: None}
