"""Repeated keys, skewed values, and the functions that no registered query runs."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline import storage
from plumbline.functions import text as T
from plumbline.operators import clean, match, review, sample, temporal
from plumbline.sources import io, responses
from plumbline.streaming import events


def values(spark, column, rows, types):
    return [r[0] for r in spark.createDataFrame(rows, types).select(column).collect()]


def test_upsert_with_repeated_keys(spark):
    rows = spark.createDataFrame([(1, 0, "a", True), (2, 5, None, False), (3, 7, "c", True)], "id long, n int, doi string, has_doi boolean")
    new = spark.createDataFrame([(1, 3, None), (1, 4, "x"), (2, None, "y"), (None, 9, "z")], "id long, n int, doi string")
    got = sorted(tuple(r) for r in match.upsert(rows, new, "id", ["n", "doi"]).collect())
    assert got == [(1, 4, "x", True), (2, None, "y", True), (3, 7, "c", True)]


def test_lookup_with_repeated_keys(spark):
    table = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", " "), ("l", ""), (None, "n")], "k string, v string")
    rows = spark.createDataFrame([("k",), ("l",), ("m",), (None,)], "k string")
    assert {r["k"]: r["v"] for r in match.lookup(rows, table, "k", "v", "-").collect()} == {"k": "a", "l": "-", "m": "-", None: "-"}


def test_reviews_with_repeated_keys(spark):
    log = spark.createDataFrame([("a", "n", "old"), ("b", "y", "kept")], "dblp_key string, correct string, notes string")
    changed = spark.createDataFrame([("a", "s", "x"), ("a", "y", "z"), ("a", "y", "y")], "dblp_key string, correct string, notes string")
    assert sorted(tuple(r) for r in io.update_reviews(log, changed).collect()) == [("a", "y", "z"), ("b", "y", "kept")]


def test_latest_of_a_stream(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "latest")
    write = lambda rows: spark.createDataFrame(rows, "k long, at long, v string").coalesce(1).write.mode("append").parquet(src)
    run = lambda: events.upsert_latest(events.read_stream(spark, src), target, "k", str(tmp_path / "cp"), ["at"], buckets=4)
    write([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x"), (None, 9, "n")])
    run()
    assert sorted(tuple(r) for r in events.read_latest(spark, target).collect()) == [(1, 3, "c"), (2, 1, "x")]
    write([(1, 2, "late"), (2, 5, "y"), (7, 0, "new")])
    run()
    assert sorted(tuple(r) for r in events.read_latest(spark, target).collect()) == [(1, 3, "c"), (2, 5, "y"), (7, 0, "new")]


def test_label_prefixes_in_turn(spark):
    got = values(spark, T.clean_label(F.col("a")), [("Label: Topic: web apps",), ("topic label: Label: x y",), ("Topic: Label: x",), ("Topic name: Search",)], "a string")
    assert got == ["Web Apps", "X Y", "Label: X", "Search"]


@pytest.mark.parametrize("parts", [None, 1])
def test_batches_against_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(match, "BATCHED", 60)
    rng = random.Random(8)
    words = ["x" * rng.randint(0, 40) + str(i) for i in range(500)]
    got = match.batches(spark.createDataFrame([(w,) for w in [*words, None]], "v string"), "v", 7, 120, F.lit(0) if parts else None).collect()
    assert sorted(r["v"] for r in got) == sorted(words) and len({r["part"] for r in got}) == (parts or 9)
    for part in {r["part"] for r in got}:
        batch, n, chars = 0, 0, 0
        for r in sorted((r for r in got if r["part"] == part), key=lambda r: r["v"]):
            size = len(r["v"]) + 1
            if n >= 7 or (n and chars + size > 120):
                batch, n, chars = batch + 1, 0, 0
            n, chars = n + 1, chars + size
            assert r["batch"] == batch


def test_budget_of_a_scan(spark):
    requests = spark.createDataFrame([(f"k{i}", [f"v{i}"]) for i in range(20)], "cache_key string, values array<string>").coalesce(1).sortWithinPartitions("cache_key")
    calls = spark.sparkContext.accumulator(0)

    def fetch(asked):
        calls.add(1)
        return (429, None, None) if asked[0] == "v1" else (200, "{}", None)

    done = responses.scan(requests, fetch, per_second=1e9, lanes=1, sleep=lambda s: None).collect()
    assert [r["status"] for r in done].count(429) == 1 and calls.value == len(done) and len(responses.pending(requests, spark.createDataFrame(done)).collect()) == 20 - len(done)


def test_stratified_against_brute_force(spark, monkeypatch):
    import hashlib

    for digits in (1, 4):
        monkeypatch.setattr(sample, "RANGE_DIGITS", digits)
        rows = [(i, "abcd"[i % 7 % 4], i) for i in range(700)] + [(1000, None, 0)]
        df = spark.createDataFrame(rows, "id long, s string, more long")
        got = sample.stratified(df, "s", "id", ["d"], 200, 120)
        assert got.columns == ["s", "id", "more", "in_fit"]
        plan = {r["s"]: r["k"] for r in sample.stratum_plan(df, "s", ["d"], 200, 120).collect()}
        taken = {r["id"] for r in got.collect() if r["in_fit"]}
        want = set()
        for s in "abcd":
            mine = sorted((hashlib.md5(f"{i}42".encode()).hexdigest(), i) for i, t, _ in rows if t == s)
            want |= {i for _, i in mine[: plan[s]]}
        assert taken == want and got.count() == 700
    assert sample.stratified(df.limit(0), "s", "id", [], 10, 5).count() == 0


def test_citations_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0, 0, 1, 2, 3, 5, 8, 40, None])) for g in "abc" for _ in range(rng.randint(1, 60))] + [("z", None)]
    for r in temporal.citation_panel(spark.createDataFrame(rows, "g string, c int"), ["g"], "c").collect():
        mine = sorted((c for g, c in rows if g == r["g"] and c is not None), reverse=True)
        assert r["n"] == sum(g == r["g"] for g, _ in rows)
        if not mine:
            assert (r["median_cites"], r["h_index"], r["mean_cites"]) == (None, None, None)
            continue
        h = max(min(i, c) for i, c in enumerate(mine, 1))
        assert (r["median_cites"], r["total_cites"], r["h_index"]) == (statistics.median(mine), sum(mine), h)
        assert abs(r["mean_cites"] - sum(mine) / len(mine)) < 1e-6 and abs(r["uncited"] - mine.count(0) / len(mine)) < 1e-6


def test_ecdf_of_heavy_values(spark):
    rows = [(i, 1.0 if i % 3 else float(i)) for i in range(300)] + [(300, 1e9), (301, None)]
    got = {r["k"]: r["ecdf"] for r in review.ecdf(spark.createDataFrame(rows, "k long, v double"), "v", "k").collect()}
    order = sorted((v, k) for k, v in rows if v is not None)
    assert got == {k: round((i + 1) / 301, 9) for i, (_, k) in enumerate(order)}
    assert review.ecdf(spark.createDataFrame([], "k long, v double"), "v", "k").count() == 0


def test_storage_asks_for_a_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert storage.shared_dir(Session, "x").startswith("file:/")
    storage._made.pop()


def test_column_functions(spark):
    assert values(spark, F.round(T.log_fold_change(F.col("a"), F.col("b")), 6), [(0.4, 0.2), (0.9, 0.1), (0.1, 0.9)], "a double, b double") == [1.0, 2.0, -2.0]
    assert values(spark, T.escape_html(F.col("a")), [('<a b="c">&amp;',), (None,)], "a string") == ["&lt;a b=&quot;c&quot;&gt;&amp;amp;", None]
    assert values(spark, T.percent(F.col("a")), [(0.1234,), (1.0,)], "a double") == ["12.3%", "100.0%"]
    assert T.wrapped("aaa bbb ccc", 3, 2) == "aaa\nbbb ..." and T.wrapped("", 3) == "" and T.wrapped("aaa bbb", 3, 2) == "aaa\nbbb"
    points = spark.range(1).select(T.smoothstep(4)).first()[0]
    assert [(p["t"], p["s"]) for p in points] == [(0.0, 0.0), (0.25, 0.15625), (0.5, 0.5), (0.75, 0.84375), (1.0, 1.0)]


def test_paper_tables(spark):
    papers = spark.createDataFrame([("a", 2001, "<b>T</b>", ["X Y 0001"], None, False, "https://dl.acm.org/1"), ("b", 2003, "U", [], "abs", True, "https://dl.acm.org/2"), ("c", 2002, "V", None, "", None, "https://x.org")], "dblp_key string, year int, title string, authors array<string>, abstract string, has_abstract boolean, ee string")
    assert [r["dblp_key"] for r in clean.publisher_targets(papers).collect()] == ["a"]
    assert clean.replace_column(papers, "year", F.lit(1)).columns[-1] == "year" and clean.replace_column(papers, "new", F.lit(1)).first()["new"] == 1
    shown = clean.preview(papers).collect()
    assert [r["year"] for r in shown] == [2003, 2002, 2001] and (shown[2]["title"], shown[2]["authors"]) == ("T", "X Y")
    order = spark.createDataFrame([("c", 1), ("a", 2)], "dblp_key string, ordinal int")
    assert [r["dblp_key"] for r in match.in_order(papers, order, "dblp_key").collect()] == ["c", "a"]
    assigned = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "dblp_key string, topic_id int")
    topics = spark.createDataFrame([(1, "one")], "topic_id int, llm_label string")
    assert [(r["dblp_key"], r["llm_label"]) for r in review.pool(assigned, papers, topics).collect()] == [("b", "one")]
    cache = spark.createDataFrame([("https://dl.acm.org/1", 200, "<p>"), ("https://x.org", 404, None)], "url string, status int, html string")
    assert {r["dblp_key"]: r["state"] for r in responses.cached_pages(papers, cache).collect()} == {"a": "found", "b": "unasked", "c": "missing"}
