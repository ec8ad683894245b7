"""Columns of users keep their values, whatever they are named, through every stage and operator that returns them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import jaccard_join, quality, suffix_dedup, toxicity

OWN = ["__doc", "__tie", "__slot", "__text_key", "__stage_predicted", "__stage_score", "__stage_n_removed", "__stage_n_bytes", "__plumbline_text", "c0", "c1", "row", "doc", "text_key", "node", "no_id", "slot", "bucket", "kind", "Score", "PREDICTED", "__STAGE_Predicted", "n_bytes", "N_Removed", "kept_sha256", "with.dot", "with `tick`", "first"]


@pytest.fixture(scope="module")
def docs(spark):
    names = [n for n in OWN if [m.casefold() for m in OWN].index(n.casefold()) == OWN.index(n)]
    text = lambda i: " ".join(f"{'fair' if i % 3 else 'JUNK'}{(i * 7 + j) % 900}" for j in range(80))
    rows = [(i, text(i % 30) + (" you are scum, you idiot" if i % 9 == 0 else ""), *(f"{n} of {i}" for n in names)) for i in range(60)] + [(None, None, *(f"{n} of none" for n in names))]
    return spark.createDataFrame(rows, ["doc_id", "text", *names]).withColumn("n_chars", F.length("text")).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")


def others(df, but=()):
    names = [n for n in df.columns if n not in ("text", "n_chars") and n.casefold() not in but]
    return sorted(str([(n, r[n]) for n in names]) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, docs, labels, name, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got, given = others(out), others(docs)
    assert set(got) <= set(given) and len(got) >= 10


def test_packing_takes_any_columns(spark, docs, labels):
    assert dict(corpus_pipeline.STAGES)["best-fit packing"](spark, docs, "").count() >= 61


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores_keep_columns(docs, labels, op):
    out = op.score(docs, labels)
    assert [c.casefold() for c in out.columns].count("score") == 1 == [c.casefold() for c in out.columns].count("predicted")
    gone = ("score", "predicted")
    assert others(out, gone) == others(docs, gone) and out.filter("score between 0 and 1").count() == 61
    same = op.score(docs, labels, prefix="__x_")
    assert same.columns == [*docs.columns, "__x_score", "__x_predicted"] and others(same, ("__x_score", "__x_predicted")) == others(docs)


def test_dedup_keeps_columns(docs):
    out = suffix_dedup.deduplicate(docs)
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert out.columns[-4:] == list(added) and others(out, added) == others(docs, added)
    same = suffix_dedup.deduplicate(docs, prefix="__x_")
    assert same.columns == [*docs.columns, *(f"__x_{a}" for a in added)] and others(same, tuple(f"__x_{a}" for a in added)) == others(docs)


def test_keep_first_keeps_columns(docs):
    out = jaccard_join.keep_first(docs)
    assert out.columns == docs.columns and set(others(out)) <= set(others(docs)) and out.count() < docs.count()
