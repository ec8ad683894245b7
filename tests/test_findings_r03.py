"""Findings of the third round."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.llm import suffix_dedup
from plumbline.operators import match, meaning, neighbours, terms
from plumbline.plans import cleaning_queries


def joined_rows(df) -> int:
    """Rows that the joins of a plan put out, all together."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = df.select("*")._jdf.queryExecution()
        run.toRdd().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    return sum(p.metrics().get("numOutputRows").get().value() for p in nodes(run.executedPlan()) if "Join" in p.nodeName())


def test_covered_places():
    """Pipeline: how much of a run is within found spans, against marks on every place."""
    rng = np.random.default_rng(0)
    for n in (0, 1, 40):
        lo = rng.integers(0, 300, n)
        hi = lo + rng.integers(1, 30, n)
        a = rng.integers(0, 330, 200)
        b = a + rng.integers(0, 40, 200)
        marks = np.zeros(400, bool)
        for x, y in zip(lo, hi, strict=True):
            marks[x:y] = True
        assert suffix_dedup._covered(lo, hi, a, b).tolist() == [int(marks[x:y].sum()) for x, y in zip(a, b, strict=True)]


def test_first_runs_hold_no_numbers_for_each_byte():
    """Pipeline: copies within a task take memory for runs and spans, not 29 bytes for each byte of text."""
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 3_000_000).astype(np.uint8)
    data = np.r_[text, text[:50_000]]
    offsets = np.array([0, len(text), len(data)])
    empty = np.zeros(1, np.int64)

    def part(at, doc):
        pos = np.arange(0, 40_000, 400, dtype=np.int64)
        n = len(pos)
        return {"anchor": pos.astype(np.uint64), "content": pos.astype(np.uint64), "doc": empty.repeat(n) + doc, "tie": empty.repeat(n), "slot": empty.repeat(n).astype(np.int32), "pos": pos.astype(np.int32), "size": np.full(n, 500, np.int32), "at": pos + at}

    tracemalloc.start()
    rows = list(suffix_dedup._first_runs([part(int(offsets[0]), 1), part(int(offsets[1]), 2)], [data], 0, 100, 1, 256))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 3
    assert peak < 8 * len(data)


def test_common_titles_make_no_pairs(spark):
    """400 papers and 400 candidates of one title."""
    papers = spark.range(400).select(F.col("id"), F.lit("Testing the Test").alias("title"), (2000 + F.col("id") % 3).cast("int").alias("year"))
    works = spark.range(400).select(F.col("id").alias("work"), F.lit("Testing the test").alias("title"), (2000 + F.col("id") % 4).cast("int").alias("year"), (-F.col("id") % 5).alias("position"))
    found = match.match_titles(papers, works, "id", "work", compose=False)
    assert found.count() == 400
    assert joined_rows(found) <= 2 * 400


def test_titles_by_brute_force(spark):
    """keys that differ in articles and signs, missing values, papers listed twice, candidates of own."""
    rng = np.random.default_rng(3)
    titles = ["On the Way", "the way!", "Way", "way", "A way <b>", "Testing", "testing.", "...", None, ""]
    pick = lambda n, least: [(int(rng.integers(0, n)) if rng.random() > 0.05 else None, titles[rng.integers(0, 10)], int(rng.integers(2000, 2004)) if rng.random() > 0.1 else None) for _ in range(least)]
    p, w = pick(30, 60), [(*x, int(rng.integers(0, 3)) if rng.random() > 0.1 else None, f"w{rng.integers(0, 25)}") for x in pick(30, 60)]
    papers = spark.createDataFrame(p, "id int, title string, year int")
    works = spark.createDataFrame(w, "id int, title string, year int, position int, work string")
    forms = {r["title"]: (r["k"], r["n"]) for r in papers.unionByName(works.select("id", "title", "year")).select("title", T.loose_key(F.col("title"), False).alias("k"), T.normalize(F.col("title"), False).alias("n")).collect()}
    null_first = lambda x: (x is not None, x)
    for own in (False, True):
        want = {}
        for i, title, year in p:
            for j, other, work_year, position, work in w:
                (k, n), (wk, wn) = forms[title], forms[other]
                if year is None or work_year is None or k == "" or k != wk or abs(year - work_year) > 1 or own and (i is None or i != j):
                    continue
                hit = (not (n == wn and year == work_year), null_first(position), work)
                want[i] = min(want.get(i, hit), hit)
        got = match.match_titles(papers, works, "id", "work", compose=False, own=own).collect()
        assert sorted(map(tuple, got), key=str) == sorted(((i, h[2], "loose" if h[0] else "strict") for i, h in want.items()), key=str)


def test_strict_matches_of_copies(spark, tmp_path):
    """a table of copies of one text; each is matched, and no pairs of copies are made."""
    d = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("One text that many documents share, word by word.").alias("text"), F.lit("web").alias("source"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    found = cleaning_queries.strict_title_match(spark, str(tmp_path))
    assert found.count() > 0
    assert joined_rows(found) <= 2 * 300


def test_totals_of_pairs_and_sums_without_vectors_on_the_way(spark):
    """word totals come without pairs; vectors are made after the shuffle; passes over blocks agree."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, None if i % 17 == 0 else " ".join(rng.choice(["aa", "bb", "cc", "dd", "eee"], rng.integers(0, 9)))) for i in range(80)], "id int, t string").repartition(3)
    near = meaning.near_counts(docs, "t", 3)
    want = {r["word"]: r["n"] for r in near.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    assert {r["word"]: r["n"] for r in meaning.near_totals(docs, "t", 3).collect()} == want
    pairs = meaning.mutual_information(near, 1).select("word", "m", "near")
    plan = meaning._sums(pairs, 8, lambda batch: None)._jdf.queryExecution().optimizedPlan().toString()
    first = plan.split("\n")
    assert "MapInArrow" in first[0] and "Sort" in first[1]
    x = {r["word"]: r["v"] for r in meaning.word_vectors(meaning.mutual_information(near, 1), 3, 4).collect()}
    y = {r["word"]: r["v"] for r in meaning.word_vectors(meaning.mutual_information(near, 1), 3, 4, block=1).collect()}
    assert x.keys() == y.keys() and all(np.allclose(x[w], y[w], atol=1e-8) for w in x)


def test_nearest_by_single_precision_and_exact_distances():
    """rows that differ by less than single precision tells, copies, names as text, far from the origin, batch by batch."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 6))
    x[100:] = x[:50] + rng.normal(size=(50, 6)) * 1e-8
    x[60:64] = x[3]
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    for metric, v in (("cosine", unit), ("euclidean", x), ("euclidean", x + 1000), ("euclidean", x * 1e20)):
        for ids in (rng.permutation(150), np.array([f"n{i}" for i in rng.permutation(150)], dtype=object)):
            whole = neighbours.distances(v, v, metric)
            at, names, d = neighbours._nearer(ids, v, 5, metric, ((ids[a : a + 40], v[a : a + 40]) for a in range(0, 150, 40)), tile=16)
            place = {n: i for i, n in enumerate(ids)}
            for i in range(150):
                mine = np.flatnonzero(at == i)
                want = np.sort(np.delete(whole[i], i))[:5]
                assert len(mine) == 5 and ids[i] not in names[mine]
                near = np.array([whole[i, place[n]] for n in names[mine]])
                scale = max(1.0, np.abs(v).max())
                assert np.allclose(d[mine], want, atol=2e-7 * scale) and np.allclose(near, want, atol=2e-7 * scale)
                assert sorted(zip(d[mine], names[mine])) == list(zip(d[mine], names[mine]))


def test_graph_is_made_once(spark):
    """what the reachability reads is a written graph, not the search over all pairs once for each use."""
    from plumbline.plans import vector_queries

    plan = vector_queries.mutual_reachability(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_window_shares_send_no_whole_vocabulary(spark, monkeypatch):
    """tasks get no more terms than `cells` allow, the rest comes by joins; shares are the same, for repeated rows and unknown words too."""
    rng = np.random.default_rng(11)
    vocabulary = np.array([a + b + c for a in "bdgkmp" for b in "aeiou" for c in ["ta", "no", "ri", "su", "lo", "xx"]])
    often = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(i % 50, "xyz"[i % 3], None if i == 7 else " ".join(rng.choice(vocabulary, rng.integers(0, 40), p=often / often.sum()))) for i in range(120)]
    docs = spark.createDataFrame(rows, "id int, topic string, t string").repartition(3).cache()
    weights = terms.topic_weights(terms.doc_terms(docs.filter("id < 40"), "id", "t", ["topic"]), "topic").cache()
    assert weights.select("term").distinct().count() > 100
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(value), broadcast(self, value))[1])
    found = {}
    for cells in (10**6, 60):
        for stride in (1, 3):
            got = terms.window_shares(docs, "id", "t", weights, "topic", stride=stride, cells=cells).collect()
            found.setdefault(stride, []).append(sorted((r["id"], r["topic"], round(r["share"], 9)) for r in got))
        few = [len(value[0]) if isinstance(value, tuple) else len(value) for value in sent]
        sent.clear()
    assert max(few) <= 60
    assert all(x == y and len(x) > 100 for x, y in found.values())


def test_strict_matches_without_loose_ones(spark, tmp_path):
    """candidates aren't set beside papers of the years around to find equal titles of one year; the matches are those that are strict among all."""
    titles = ["On the Way", "the way!", "Way", "way", "A way <b>", "Testing", "testing.", "...", None, ""]
    rows = [(i, titles[i * 7 % 10], 2000 + i % 4 if i % 9 else None, i % 3 if i % 5 else None) for i in range(200)]
    works = spark.createDataFrame(rows, "id int, title string, year int, position int").withColumn("work", F.concat(F.lit("w"), "id"))
    papers = works.selectExpr("id % 60 AS id", "title", "year")
    for own in (False, True):
        want = match.match_titles(papers, works, "id", "work", compose=False, own=own).filter("kind = 'strict'").collect()
        got = match.match_titles(papers, works, "id", "work", compose=False, own=own, strict_only=True).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 10
    plan = cleaning_queries.strict_title_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1
