"""Small cases worked out by hand, and properties."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.functions import text as T
from plumbline.operators import clean, graph, match, review, sample, temporal, terms, vectors
from plumbline.schemas import PAPERS, require_columns


def one(spark, column, *values, types="a string"):
    return [r[0] for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], types).select(column).collect()]


def test_text_functions(spark):
    a = F.col("a")
    assert one(spark, T.normalize(a), "  A $x^2$ <b>Bold</b>\tText ", None, "ﬁx") == ["a bold text", "", "fix"]
    assert one(spark, T.normalize_doi(a), "https://doi.org/10.1/ABC", "", None) == ["10.1/abc", None, None]
    assert one(spark, T.clean_author(a), "Michael Hicks 0001") == ["Michael Hicks"]
    assert one(spark, T.doi_of_url(a), "https://x/doi/10.1145/ABC?x=1", "https://x/doi/abs/10.1145/1", "https://x/") == ["10.1145/abc", "abs/10.1145/1", None]
    assert one(spark, T.loose_key(a), "On the Criteria: A Study!", "The A Team") == ["criteria a study", "team"]
    assert one(spark, T.clean_label(a), "testing & debugging of web apps", "MachineLearningModels", "in the loop") == ["Testing Debugging", "Machine Learning Models", "Loop"]
    assert one(spark, T.clean_label(a), '"Label: REST APIs."', "of the\nsecond line", "Code Review and Merge Queues") == ["Rest Apis", "", "Code Review Merge"]
    assert [T.lemma(w) for w in ("apis", "studies", "classes", "testing", "mapped", "analysis")] == ["api", "study", "class", "test", "map", "analysis"]
    assert one(spark, T.short_label(T.split_words(a)), "x, y", "a,b,c,d") == ["x · y", "a · b · c"]
    assert one(spark, T.text_color(a), "#000000", "#ffffff", "rgb(250, 250, 250)") == ["#ffffff", "#1a1a1a", "#1a1a1a"]
    assert one(spark, T.rgba(a, 0.5), "#0a10ff") == ["rgba(10,16,255,0.5)"]
    assert one(spark, T.escape_script(a), "</script>") == ["<\\/script>"]


def test_arrays_and_maps(spark):
    assert one(spark, T.inverted_index_text(F.col("a")), ({"the": [0, 2], "cat": [1]},), ({},), types="a map<string,array<int>>") == ["the cat the", None]
    concepts = [([("x", 0.3), ("y", 0.29), ("z", None)],), (None,)]
    assert one(spark, T.strong_concepts(F.col("a")), *concepts, types="a array<struct<display_name:string,score:double>>") == [["x"], []]
    assert one(spark, T.author_line(F.col("a")), (["a", "b", "c", "d", "e"],), (["a"],), types="a array<string>") == ["a, b, c, d, et al.", "a"]
    assert one(spark, T.doi_of_links(F.col("a")), (["https://x.org", "https://doi.org/10.1/A"],), (["x"],), types="a array<string>") == ["10.1/a", None]


def test_buckets(spark):
    y = F.col("a")
    assert one(spark, T.bucket(y), 1979, 1980, 2025, types="a int") == [1975, 1980, 2025]
    assert one(spark, T.decade(y), 1979, 2025, types="a int") == ["1970s", "2020s"]
    assert one(spark, T.window_label(y), 1975, 2000, types="a int") == ["1975–79", "2000–04"]
    assert one(spark, T.window_label(y, last_year=F.lit(2025)), 2025, types="a int") == ["2025"]


def test_main_track(spark):
    values = ["ICSE", "ICSE (1)", "icse 2", "ICSE-SEIP", "ICSE Companion", "ICSE-Workshops", "ICSEW", "AST@ICSE", "", None]
    assert one(spark, clean.main_track(F.col("a"), "ICSE"), *values) == [True] * 4 + [False] * 6


def test_acronym(spark):
    rows = [("ASE",)] * 3 + [("KBSE",)] * 2 + [("ASE Workshops",)] * 9
    assert clean.acronym(spark.createDataFrame(rows, "booktitle string")).collect()[0][0] == "ASE"
    assert clean.acronym(spark.createDataFrame([("X Workshop",)], "booktitle string")).count() == 0


def test_front_matter(spark):
    rows = [("Panel: X", None), ("2nd International Workshop on Y", None), ("A Workshop Approach", None), ("Z (Tutorial)", None), ("Testing Z", "10.1109/ICSE.2009.10234"), ("Testing Z", "10.1109/ICSE.2009.5070510"), (None, None)]
    assert [r[0] for r in spark.createDataFrame(rows, "title string, doi string").select(clean.front_matter(F.col("title"), F.col("doi"), "icse")).collect()] == [True] * 5 + [False] * 2


def test_dedup(spark):
    rows = [("k1", "T", 2000, None, list("abcde")), ("k2", "T", 2000, "d", ["a"]), ("k3", "T", 2000, "d", list("abc")), ("k3", "U", 2001, None, None)]
    df = spark.createDataFrame(rows, "dblp_key string, title string, year int, doi string, authors array<string>")
    once = clean.deduplicate(df)
    assert [r["dblp_key"] for r in once.collect()] == ["k3"]
    assert clean.deduplicate(once).count() == once.count()


def test_title_match(spark):
    papers = spark.createDataFrame([(1, "On the Way", 2000), (2, "Testing", 2000), (3, "...", 2000)], "id int, title string, year int")
    works = spark.createDataFrame([("s", "On the Way", 2000, 1), ("l", "the way!", 2001, 0), ("x", "Testing", 2002, 0), ("e", "", 2000, 0)], "work string, title string, year int, position int")
    assert {(r["id"], r["work"], r["kind"]) for r in match.match_titles(papers, works, "id", "work").collect()} == {(1, "s", "strict")}


def test_sample_plan(spark):
    rows = [("f",)] * 10 + [("a",)] * 20 + [("b",)] * 5 + [("c",)]
    plan = {r["conf"]: r["k"] for r in sample.stratum_plan(spark.createDataFrame(rows, "conf string"), "conf", ["f"], 20, 8).collect()}
    assert plan == {"f": 10, "a": 6, "b": 4, "c": 1}


def test_growth(spark):
    rows = [("t1", 1990, 50), ("t2", 1990, 50), ("t1", 2000, 52), ("t2", 2000, 20), ("t3", 2000, 28)]
    out = {(r["t"], r["d"]): r for r in temporal.growth(spark.createDataFrame(rows, "t string, d int, papers long"), "t", "d", 10).collect()}
    assert [out[k]["state"] for k in (("t1", 1990), ("t1", 2000), ("t2", 2000), ("t3", 2000))] == ["na", "flat", "down", "new"]
    assert out[("t2", 2000)]["growth_pct"] == pytest.approx(-60) and out[("t3", 2000)]["growth_pct"] is None


def test_turnover(spark):
    df = spark.createDataFrame([(1, 1, list("abcde")), (1, 5, list("abcxy"))], "t int, w int, words array<string>")
    r = terms.turnover(df, "t", "w").collect()[0]
    assert (r["since"], r["w"], r["turnover"], r["entered"], r["dropped"]) == (1, 5, 0.571429, "x,y", "d,e")


def test_migration(spark):
    main = [(f"p{i}", b, t, 1) for i in range(2) for b, t in ((1990, 1), (1995, 2))] + [("gap", 1990, 1, 1), ("gap", 2000, 2, 1), ("one", 1990, 3, 1), ("one", 1995, 4, 1)]
    flows = temporal.migration(spark.createDataFrame(main, "a string, b int, t int, n long"), "a", "b", "t", 5).collect()
    assert [(r["b"], r["src"], r["tgt"], r["people"]) for r in flows] == [(1990, 1, 2, 2)]
    tie = spark.createDataFrame([("a", 1, 2), ("a", 1, 1)], "a string, b int, t int")
    assert temporal.dominant(tie, "a", "b", "t").collect()[0]["t"] == 1


def test_ctfidf(spark):
    counts = spark.createDataFrame([("A", "x", 2), ("A", "y", 1), ("B", "x", 1), ("B", "z", 3)], "c string, term string, n long")
    w = {(r["c"], r["term"]): round(r["w"], 6) for r in terms.class_tfidf(counts, ["c"]).collect()}
    assert w == {("A", "x"): 0.515460, ("A", "y"): 0.501359, ("B", "z"): 0.579892, ("B", "x"): 0.193297}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2, 0.15), (2, 3, 0.2), (4, 5, 0.1)], "a int, b int, jaccard double")
    assert {(r[0], r[1]) for r in terms.merge_similar(edges).collect()} == {(1, 1), (2, 1), (3, 1)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    assert {r["root"] for r in graph.components(chain).collect()} == {0}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(8, 10), (10, 10), (0, 0)], "k long, n long")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = [(round(r[0], 6), round(r[1], 6)) for r in df.select(low, high).collect()]
    assert got == [(0.490157, 0.943319), (0.722460, 1.0), (0.0, 1.0)] or got == [(0.490157, 0.943319), (0.722467, 1.0), (0.0, 1.0)]
    r = review.agreement(spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0)], "a int, b int"), "a", "b").collect()[0]
    assert (r["kappa"], r["ac1"]) == (0.5, 0.529412)
    assert stats.sample_size(0.74, 0.05) == 296


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3)), min_size=1, max_size=30))
def test_shares_sum_to_one(spark, rows):
    df = spark.createDataFrame(rows, "g string, b int")
    out = temporal.shares(temporal.dense(temporal.counts(df, "g", "b"), "g", "b"), "b", digits=9).toPandas()
    assert (abs(out.groupby("b")["share"].sum() - 1) < 1e-6).all()
    assert out["papers"].sum() == len(rows)


def test_nearest_paths_agree(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    cents = vectors.centroids(v, "label", "embedding")
    near = vectors.nearest(v, "vec_id", "embedding", cents, "label").toPandas()
    cells = vectors.nearest(v, "vec_id", "embedding", cents, "label", block=3).toPandas()
    both = near.merge(cells, on="vec_id")
    assert len(both) == len(near) and (both.nearest_x == both.nearest_y).all() and (abs(both.sim_x - both.sim_y) < 1e-9).all()


def test_batches(spark):
    df = spark.createDataFrame([("a" * 10,), ("b" * 10,), ("c" * 10,), ("d" * 50,)], "v string")
    got = match.batches(df, "v", most=2, max_chars=30, part=F.lit(0)).toPandas().sort_values("v")
    assert got["batch"].tolist() == [0, 0, 1, 2]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="booktitle"):
        require_columns(spark.createDataFrame([("x",)], "conf string"), PAPERS, "papers")


def test_ecdf_of_one_value(spark):
    got = review.ecdf(spark.createDataFrame([(i, 2.0) for i in range(4)], "k int, v double"), "v", "k").toPandas()
    assert sorted(got["ecdf"]) == [0.25, 0.5, 0.75, 1.0]
    assert review.ecdf(spark.createDataFrame([], "k int, v double"), "v", "k").count() == 0


THEMES = {
    "Developer Tooling": ([14, 13, 12, 25, 37, 61, 106, 241, 385, 427, 73], [4, 4, 4, 4, 4, 4, 3, 1, 1, 1, 1]),
    "Program Correctness": ([51, 37, 33, 32, 58, 125, 137, 177, 321, 262, 48], [1, 1, 2, 3, 3, 2, 1, 3, 2, 3, 2]),
    "System Design": ([46, 37, 56, 44, 111, 183, 126, 188, 167, 60, 8], [2, 2, 1, 1, 1, 1, 2, 2, 4, 7, 7]),
    "Defect Management": ([4, 1, 2, 3, 10, 26, 47, 118, 214, 265, 29], [7, 8, 9, 7, 9, 6, 5, 4, 3, 2, 4]),
    "Software Testing": ([8, 10, 8, 12, 20, 24, 45, 77, 142, 160, 42], [5, 6, 6, 5, 6, 7, 6, 6, 5, 5, 3]),
    "Software Process": ([19, 21, 28, 36, 74, 74, 65, 81, 82, 53, 4], [3, 3, 3, 2, 2, 3, 4, 5, 7, 8, 8]),
    "Artificial Intelligence": ([2, 3, 3, 3, 17, 32, 21, 38, 89, 181, 23], [8, 7, 8, 8, 8, 5, 9, 8, 6, 4, 5]),
    "Human Factors in Software Engineering": ([0, 1, 9, 3, 22, 20, 22, 33, 81, 125, 12], [9, 9, 5, 9, 5, 9, 8, 9, 8, 6, 6]),
    "Requirements Engineering": ([8, 11, 8, 5, 18, 23, 27, 40, 62, 52, 4], [6, 5, 7, 6, 7, 8, 7, 7, 9, 9, 9]),
    "Emerging Platforms": ([0, 1, 0, 1, 5, 8, 6, 12, 32, 26, 2], [10] * 11),
}


def test_published_ranks(spark):
    """Counts of papers per theme and five-year window give the published ranks, ties and empty cells included."""
    windows = list(range(1975, 2030, 5))
    rows = [(t, w, n) for t, (ns, _) in THEMES.items() for w, n in zip(windows, ns, strict=True) if n]
    counted = spark.createDataFrame(rows, "theme string, bucket int, papers long")
    got = temporal.rank_per(temporal.shares(temporal.dense(counted, "theme", "bucket"), "bucket", digits=12), "bucket", "theme").toPandas()
    want = pd.DataFrame([(t, w, r) for t, (_, rs) in THEMES.items() for w, r in zip(windows, rs, strict=True)], columns=["theme", "bucket", "want"])
    both = got.merge(want, on=["theme", "bucket"])
    assert len(both) == 110 and (both["rnk"] == both["want"]).all()
