"""Components of odd edges, reports, file order, NPY by ranges, suggestions, index within a row, resumable assignment, the entry."""

import builtins
import importlib
import sys
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import graph, review, terms
from plumbline.plans import pipelines
from plumbline.sources import io


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 7), (8, None), (None, 9), (None, None), (3, 3), (2, None)], "a int, b int")
    assert sorted(map(tuple, graph.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 9)]
    assert graph.components(edges.limit(0)).count() == 0


def test_markdown_cells(spark):
    df = spark.createDataFrame([(1, "a|b\nc\r\nd\\e"), (2, None)] + [(k, "x") for k in range(3, 9)], "n int, t string")
    text = io.markdown(df, ["n"], limit=2)
    assert text.split("\n")[2:] == ["| 1 | a\\|b<br>c<br>d\\\\e |", "| 2 |  |", "", "6 more rows"]
    assert io.markdown(df, ["n"]).endswith("| 8 | x |")


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f4", "<i2"])
def test_npy_by_ranges(spark, tmp_path, kind):
    x = (np.random.default_rng(1).normal(size=(25_003, 6)) * 50).astype(kind)
    np.save(f"{tmp_path}/m.npy", x)
    part = 2000 * 6 * x.dtype.itemsize
    df = io.read_npy_ranges(spark, f"file://{tmp_path}/m.npy", part_bytes=part)
    assert df.rdd.getNumPartitions() == 13
    got = df.orderBy("id").toPandas()
    assert got["id"].tolist() == list(range(25_003)) and np.array_equal(np.stack(got["vec"].to_numpy()), x.astype(np.float32))
    whole = io.read_npy(spark, f"file://{tmp_path}/m.npy").orderBy("id").toPandas()
    assert np.array_equal(np.stack(whole["vec"].to_numpy()), np.stack(got["vec"].to_numpy()))


def test_npy_that_is_no_matrix(spark, tmp_path):
    np.save(f"{tmp_path}/v.npy", np.zeros(5, np.float32))
    np.save(f"{tmp_path}/e.npy", np.zeros((0, 3), np.float32))
    np.save(f"{tmp_path}/s.npy", np.ones((100, 3), np.float32))
    with open(f"{tmp_path}/s.npy", "r+b") as f:
        f.truncate(600)
    assert io.read_npy_ranges(spark, f"file://{tmp_path}/e.npy").count() == 0
    for name, message in (("v", "a matrix of numbers"), ("s", "ends within row")):
        with pytest.raises(Exception, match=message):
            io.read_npy_ranges(spark, f"file://{tmp_path}/{name}.npy").collect()


def test_first_and_last_by_place(spark, tmp_path):
    """Two files of one key: values are in no order of their own."""
    lines = [("b.csv", ["k1,9", "k2,5", "k1,1", ",7"]), ("a.csv", ["k1,4", "k3,8", "k3,2"])]
    for name, rows in lines:
        (tmp_path / name).write_text("key,value\n" + "\n".join(rows) + "\n")
    table = spark.read.option("header", True).schema("key string, value int").csv(f"file://{tmp_path}")
    assert {r["key"]: r["value"] for r in io.first_by_place(table, "key").collect()} == {"k1": 4, "k2": 5, "k3": 8}
    assert {r["key"]: r["value"] for r in io.first_by_place(table, "key", last=True).collect()} == {"k1": 1, "k2": 5, "k3": 2}
    assert io.first_by_place(table, "key").columns == ["key", "value"]


def test_suggestions_of_a_long_registry(spark, monkeypatch):
    registry = spark.createDataFrame([(f"group {i:04d}", 5000 - i) for i in range(2500)] + [("Testing", 9000), (None, 1)], "`group` string, `order` int")
    log = spark.createDataFrame([("a", "should be Group 0007: x"), ("b", "Should be testing or not"), ("c", "should be test"), ("d", "nothing"), ("e", None), ("f", "should be group"), ("f", "should be Testing"), ("g", "should be unheard")], "k string, notes string")
    want = {"a": "group 0007", "b": "Testing", "c": "Testing", "f": "group 2499"}
    assert {r["k"]: r["suggestion"] for r in review.suggested_group(log, registry, "k").collect()} == want
    assert review.suggested_group(log, registry.limit(0), "k").count() == 0


def test_index_within_a_row(spark):
    texts = [["b", "a", "b", "é", "a", "b"], [], None, ["x"], [str(i % 7) for i in range(5000)]]
    df = spark.createDataFrame([(w,) for w in texts], "w array<string>")
    got = [r[0] for r in df.select(T.inverted_index(F.col("w"))).collect()]
    for words, index in zip(texts, got, strict=True):
        want = None
        if words is not None:
            want = {}
            for p, w in enumerate(words):
                want.setdefault(w, []).append(p)
        assert index == want
    back = [r[0] for r in df.select(T.inverted_index_text(T.inverted_index(F.col("w")))).collect()]
    assert back == [" ".join(w) if w else None for w in texts]


def test_cooccurrence_both_ways(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma alpha"), (2, "beta alpha"), (3, None), (4, "delta gamma beta"), (5, "")], "id int, t string")
    words = spark.createDataFrame([(w, 1) for w in ("alpha", "beta", "gamma", "other")] + [("alpha", 2)], "term string, rank int")
    a, b = terms.cooccurrence(terms.doc_terms(docs, "id", "t"), "id", words), terms.cooccurrence_in_texts(docs, "t", words)
    for x, y in zip(a, b, strict=True):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())) != []


def test_assignment_of_another_model(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 3 - 1), 1.0]) for i in range(50)] + [(None, [1.0, 0.0]), (3, None)], "id long, v array<double>")
    cents = spark.createDataFrame([("r", [1.0, 0.0]), ("l", [-1.0, 0.0])], "topic string, centroid array<double>")
    out = f"file://{tmp_path}/assigned"
    first = pipelines.assign_all(rows, "id", "v", cents, "topic", out, 4)
    assert first.count() == 51 and first.columns == ["id", "topic", "sim"]
    turned = cents.withColumn("topic", F.when(F.col("topic") == "r", "l").otherwise("r"))
    again = pipelines.assign_all(rows, "id", "v", turned, "topic", out, 4)
    a, b = ({r["id"]: r["topic"] for r in x.filter("id % 3 <> 1").collect()} for x in (first, again))
    assert a.keys() == b.keys() and all(a[i] != b[i] for i in a)
    assert pipelines.assign_all(rows.limit(0), "id", "v", cents, "topic", out, 4).count() == 51  # all parts are whole: no row is read


@pytest.mark.parametrize("missing", ["regex", "zstandard", "tokenizers", "sentencepiece", "public_tokenizers", "plumbline.llm", "corpus_pipeline"])
def test_entry_without_an_optional_module(monkeypatch, missing):
    """The library's queries stay when the optional part can't be imported."""
    import __spark_entry__
    from plumbline import catalog

    real = builtins.__import__

    def guarded(name, globals=None, locals=None, fromlist=(), level=0):
        if name == missing or name.startswith(missing + ".") or (missing == "plumbline.llm" and name == "plumbline" and "llm" in (fromlist or ())):
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
        return real(name, globals, locals, fromlist, level)

    for name in [n for n in sys.modules if n.startswith(("plumbline.llm", "corpus_pipeline")) or n == missing or n.startswith(missing + ".")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(importlib.import_module("plumbline"), "llm", raising=False)
    monkeypatch.setattr(builtins, "__import__", guarded)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        names = set(__spark_entry__.queries())
        assert set(catalog.QUERIES) <= names and set(catalog.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    if missing in ("regex", "public_tokenizers", "plumbline.llm", "corpus_pipeline"):  # the others are wanted when a query runs
        assert "pipeline" not in names and any("left out" in str(w.message) for w in said)
