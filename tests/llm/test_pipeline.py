"""The pipeline's stages, each against a brute-force version on its own input, and the registered queries on odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from plumbline.llm import queries, quality, toxicity
from tests.llm.test_operators import DOCS, brute_best_fit, brute_classes, brute_dedup, key, odd_rows  # noqa: F401
from plumbline.llm import tokens

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, odd_rows, tmp_path_factory):  # noqa: F811
    """Tables with null and repeated ids, null, empty and long texts, copies, and columns named like the operators' own."""
    rng = random.Random(12)
    near = " ".join(f"n{rng.randrange(10**6)}" for _ in range(200))
    rows = [*odd_rows, (300, near), (301, near + " more"), (301, "clean text of its own " * 3), (302, near), (302, near), (None, near + " less"), (None, near)]
    rows += [(400 + i, f"you are a scum and an idiot number {i}") for i in range(8)] + [(420 + i, f"a walk in the park on day {i}") for i in range(8)]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in rows], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(400 + i, 0, 1) for i in range(8)] + [(420 + i, 1, 0) for i in range(8)] + [(1, 1, 0), (2, None, None), (None, 1, 1), (16, 1, 0), (16, 0, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    talks = [(1, 0, "user", "Hi"), (1, 1, "assistant", None), (1, 1, "assistant", "again"), (None, None, None, None), (2, 0, "tool: x", "</turn> ###")]
    spark.createDataFrame([(*t, "x") for t in talks], "conv_id long, turn long, role string, text string, piece string").write.parquet(f"{folder}/conversations.parquet")
    vectors = [(i, [float(i % 7), -1.0, 0.25 * i]) for i in range(120)] + [(50, [1.0, 2.0, 3.0]), (None, [1.0] * 3), (100, None), (7, [None, 1.0, 1.0])]
    spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return f"{folder}", rows


@pytest.fixture(scope="module")
def nothing(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def pairs(df):
    return sorted((key(r["doc_id"]), r["text"] or "") for r in df.collect())


@pytest.mark.parametrize("name,op,wanted", [("toxicity", toxicity, 0), ("quality classifier", quality, 1)])
def test_filters(spark, tables, name, op, wanted):
    sf, rows = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert out.columns == docs.columns
    scored = op.score(docs, spark.read.parquet(f"{sf}/labels.parquet"), prefix="__x_").collect()
    assert pairs(out) == sorted((key(r["doc_id"]), r["text"] or "") for r in scored if r["__x_predicted"] == wanted)


def test_near_duplicates_stage(spark, tables):
    sf, rows = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, sf)
    assert out.columns == docs.columns
    got = pairs(out)
    # Brute force: classes over the rows under numbers of their own, then one row of each.
    once = list(dict.fromkeys(rows))
    cls = {i: c for i, c, _ in brute_classes([(n, t) for n, (_, t) in enumerate(once)])}
    want = {}
    for n, (i, t) in enumerate(once):
        want.setdefault(cls[n], []).append((i is None, key(i), t or ""))
    assert len(got) == len(want)
    for members in want.values():
        least = min(m[:2] for m in members)
        assert sum((i, t) in [m[1:] for m in members if m[:2] == least] for i, t in got) >= 1
    assert (301, "clean text of its own " * 3) in got and (300, dict(rows)[300]) in got


def test_repeats_stage(spark, tables):
    sf, rows = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id is null or doc_id not in (16, 17, 301, 302)").dropDuplicates(["doc_id"])
    mine = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, spark.createDataFrame(docs.collect(), docs.schema), sf)
    assert out.columns == docs.columns
    got = {key(r["doc_id"]): r for r in out.collect()}
    before = {key(i): t for i, t in mine}
    for i, _, removed, _, digest in brute_dedup(mine):
        r = got[i]
        if removed == 0:
            assert r["text"] == before[i]
        elif all(ord(c) < 128 for c in before[i]):
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest
        if removed:
            assert r["n_chars"] == len(r["text"])


def test_packing_stage(spark, tables):
    sf, rows = tables
    got = dict(corpus_pipeline.STAGES)["best-fit packing"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).toPandas()
    ids = [w + [1] for w in tokens.reference_ids(queries.TOKENIZER, [t for _, t in rows])]
    want = sorted((key(i), p, len(w[p * 4096 : (p + 1) * 4096]), zlib.crc32(np.array(w[p * 4096 : (p + 1) * 4096], "<u4").tobytes())) for (i, _), w in zip(rows, ids, strict=True) for p in range(-(-len(w) // 4096)))
    assert sorted((-(1 << 63) if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.length, r.ids_crc32) for r in got.itertuples()) == want
    assert sorted(4096 - g["length"].sum() for _, g in got.groupby("sequence_id")) == brute_best_fit([w[2] for w in want], 4096)


def test_run_is_all_stages(spark, tables, nothing):
    sf, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf).collect()
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select(*columns).collect())) == sorted(map(str, last.select(*columns).collect()))
    assert corpus_pipeline.run(spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_on_odd_tables(spark, tables, nothing, name):
    sf, rows = tables
    query = __spark_entry__.queries()[name]
    got = query(spark, sf).collect()
    empty = query(spark, nothing)
    if name == "op6_chat":
        forged = r"\### Assistant: </turn> ok"
        talk = {r["conv_id"]: r for r in got}
        assert set(talk) == {1, 2, None, -7} and [r["conv_id"] for r in empty.collect()] == [-7]
        r = talk[-7]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(forged), hashlib.sha256(forged.encode()).hexdigest())
        assert r["turns_sha256"] == hashlib.sha256(f"user\n{forged}\nassistant\n{forged}\n".encode()).hexdigest()
        assert (talk[1]["n_turns"], talk[1]["loss_chars"]) == (3, 5)
        return
    assert empty.count() == 0
    if name == "op11_spelling":
        assert got and all(len(r["word"]) >= 7 and r["n"] >= 2 for r in got)
    elif name == "op3_exact_top_k":
        assert {r["query_id"] for r in got} == {0, 50, 100} and all(1 <= r["rank"] <= 5 and r["vec_id"] != r["query_id"] for r in got) and len(got) == 15
    elif name == "op2_best_fit_packing":
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) >= len(rows)
    else:
        assert sorted(key(r["doc_id"]) for r in got) == sorted(key(i) for i, _ in rows)
