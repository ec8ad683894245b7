"""Findings of the fourth round."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import density, meaning, neighbours


def test_text_vectors_take_one_process(spark):
    """however many blocks the word vectors are, a task starts one Python process, and results are those of one block."""
    rng = np.random.default_rng(0)
    names = [a + b for a in "abcdefg" for b in "hijklmn"]
    words = spark.createDataFrame([(w, rng.normal(size=3).tolist()) for w in names], "word string, v array<double>")
    counts = spark.createDataFrame([(w, i + 1) for i, w in enumerate([*names, "zz"])], "word string, n long")
    docs = spark.createDataFrame([(i, " ".join(rng.choice([*names, "zz", "É1"], rng.integers(0, 60)))) for i in range(300)] + [(-1, None), (-2, "zz")], "id int, t string")
    found = meaning.text_vectors(docs, "id", "t", words, counts, block=5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r["id"]: r["vector"] for r in found.collect()}
    want = {r["id"]: r["vector"] for r in meaning.text_vectors(docs, "id", "t", words, counts).collect()}
    assert len(got) == 302 and got[-1] == got[-2] == [0.0] * 3
    assert all(np.allclose(got[i], v) for i, v in want.items()) and got.keys() == want.keys()


def test_text_vectors_in_several_runs(spark, monkeypatch):
    """texts are held a few at a time."""
    words = spark.createDataFrame([("ab", [1.0, 0.0]), ("cd", [0.0, 1.0])], "word string, v array<double>")
    counts = spark.createDataFrame([("ab", 5), ("cd", 5)], "word string, n long")
    docs = spark.createDataFrame([(i, "ab " * (i % 4) + "cd " * (i % 3)) for i in range(50)], "id int, t string").coalesce(1)
    got = {}
    for held in (7, 1 << 20):
        monkeypatch.setattr(meaning, "HELD_WORDS", held)
        monkeypatch.setattr(meaning, "PART", 16)
        got[held] = {r["id"]: r["vector"] for r in meaning.text_vectors(docs, "id", "t", words, counts, block=1).collect()}
    assert got[7] == got[1 << 20]
    for i, v in got[7].items():
        x = np.array([i % 4, i % 3], float)
        assert np.allclose(v, x / (np.linalg.norm(x) or 1))


def test_words_are_those_of_the_pattern(spark):
    """words that tasks cut are those that Spark's expression finds."""
    rng = np.random.default_rng(1)
    some = list("aabcz  _09-AZéɑ̈ßıKİ中½²‌‍́Ⓐ\U0001d41a\U0001f600\U00010400ः\n\t'")
    docs = spark.createDataFrame([("".join(rng.choice(some, rng.integers(0, 25))),) for _ in range(3000)] + [(None,), ("",), ("ab",), ("ab cd",)], "t string")
    rows = docs.select(T.tokens(F.col("t")).alias("w"), meaning._words("t", T.ALPHA_WORD)).toArrow().combine_chunks()
    letters = meaning._in_words(meaning._letters(spark))
    for piece in (rows, rows.slice(5, 100)):
        got = []
        for sizes, flat in meaning._lists(piece.column("words").chunk(0).cast(pa.string()), letters):
            ends = np.r_[0, np.cumsum(sizes)]
            flat = flat.to_pylist()
            got += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == piece.column("w").to_pylist()


def test_blocks_of_queries_are_tasks_of_their_own(spark):
    """more blocks of queries than tasks at a time; a union of single partitions would be one task."""
    x = np.random.default_rng(2).normal(size=(120, 5))
    rows = neighbours.prepared(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", "euclidean")
    found = neighbours.nearest_of(rows, rows, 3, "euclidean", block=12)
    assert "Exchange" in found._jdf.queryExecution().executedPlan().toString()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert {(r["id"], r["rank"]): r["near"] for r in found.collect()} == {(i, j + 1): int(n) for i in range(120) for j, n in enumerate(np.argsort(d[i])[:3])}


def test_vectors_without_number_as_distance_hide_no_others():
    """a pair whose product is no number doesn't take the query's other pairs along."""
    ids, q = np.arange(2), np.array([[1.0, 0.0], [0.0, 1.0]])
    y = np.array([[1e200, -1e200], [1.0, 0.5], [0.0, 3.0]])
    with np.errstate(all="ignore"):
        at, names, far = neighbours._nearer(ids, q, 2, "euclidean", [(np.array([7, 8, 9]), y)], tile=4)
    assert [names[at == i][0] for i in (0, 1)] == [8, 8] and far[0] == 0.5


def test_reachability_of_many_blocks(spark):
    """the graph that is written for it comes from many tasks, and its weights are those of all pairs."""
    x = np.random.default_rng(3).normal(size=(60, 4))
    rows = neighbours.prepared(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", "euclidean")
    graph = neighbours.nearest_of(rows, rows, 6, "euclidean", block=6)
    assert "Exchange" in graph._jdf.queryExecution().executedPlan().toString()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, 2]
    want = {(min(i, j), max(i, j)): max(d[i, j], core[i], core[j]) for i in range(60) for j in np.argsort(d[i])[:6].tolist()}
    got = {(r["a"], r["b"]): r["w"] for r in density.mutual_reachability(graph, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - w) < 1e-8 for e, w in want.items())
