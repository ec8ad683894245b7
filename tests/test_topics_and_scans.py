"""Outliers, themes, examples, resumable assignment and remote scans, by small tables and brute force."""

import json
import math
from collections import Counter

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import match, sample, terms, vectors
from plumbline.plans import pipelines
from plumbline.sources import responses

TEXTS = [(1, 0, "parser grammar syntax"), (2, 0, "grammar tokens parser"), (3, 1, "kernel driver memory"), (4, 1, "memory driver page"), (5, -1, "a memory page and a parser"), (6, -1, "zzz unknown"), (7, -1, None), (8, -1, "grammar grammar"), (9, None, "kernel")]


def test_outliers_against_brute_force(spark):
    rows = spark.createDataFrame(TEXTS, "id long, topic int, text string")
    got = {r["id"]: (r["topic"], r["share"]) for r in terms.reduce_outliers(rows.select("id", "topic"), terms.doc_terms(rows, "id", "text", ["topic"]), "id", "topic", -1).collect()}
    words = {i: Counter(w for w in (x or "").split() if len(w) > 1) for i, _, x in TEXTS}
    classes = {}
    for i, t, _ in TEXTS:
        classes.setdefault(t, Counter()).update(words[i])
    whole = sum(classes.values(), Counter())
    mean = sum(whole.values()) / len(classes)
    idf = {w: math.log(1 + mean / n) for w, n in whole.items()}
    for i, t, _ in TEXTS:
        if t != -1:
            assert got[i] == (t, None)
            continue
        scores = {}
        for c in (0, 1):
            weight = {w: n / sum(classes[c].values()) * idf[w] for w, n in classes[c].items()}
            dot = sum(n * idf[w] * weight.get(w, 0) for w, n in words[i].items())
            if dot:
                scores[c] = dot / math.sqrt(sum(x * x for x in weight.values()))
        if not scores:
            assert got[i] == (-1, None)
            continue
        best = min(scores, key=lambda c: (-scores[c], c))
        assert got[i][0] == best and abs(got[i][1] - scores[best] / sum(scores.values())) < 1e-6
    assert len(got) == len(TEXTS)


def test_no_outliers(spark):
    rows = spark.createDataFrame(TEXTS, "id long, topic int, text string").filter("topic >= 0")
    got = terms.reduce_outliers(rows.select("id", "topic"), terms.doc_terms(rows, "id", "text", ["topic"]), "id", "topic", -1)
    assert {r["topic"] for r in got.collect()} == {0, 1} and got.filter("share is not null").count() == 0
    empty = rows.limit(0)
    assert terms.reduce_outliers(empty.select("id", "topic"), terms.doc_terms(empty, "id", "text", ["topic"]), "id", "topic", -1).count() == 0


def test_coherence_of_one_theme(spark):
    cents = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "topic int, centroid array<double>")
    themes = spark.createDataFrame([(1, "x"), (2, "x")], "topic int, theme string")
    r = vectors.theme_coherence(cents, "topic", themes, "theme").first()
    assert (r["n_topics"], round(r["intra_sim"], 6), r["nearest_theme"], r["nearest_sim"], r["n_misfiled"]) == (2, round(math.sqrt(0.5), 6), None, None, 0)


def test_examples(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0], f"t{i}" + "x" * 100) for i in range(30)] + [(30, "c", None), (31, None, "t")], "id long, g string, t string")
    got = sample.examples(rows, "g", "id", "t", 8).collect()
    assert Counter(r["g"] for r in got) == {"a": 8, "b": 8} and {len(r["t"]) for r in got} == {90}
    assert sorted(r["place"] for r in got if r["g"] == "a") == list(range(1, 9))


def test_assignment_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "id long, v array<double>")
    cents = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "topic int, centroid array<double>")
    out = f"file://{tmp_path}/assigned"
    first = {r["id"]: r["topic"] for r in pipelines.assign_all(rows, "id", "v", cents, "topic", out, 4).collect()}
    assert first == {i: 1 if math.cos(i) > 0 else 2 for i in range(40)}
    # One part isn't marked as whole: it alone is made again, from rows that are others by now.
    (mark,) = tmp_path.glob("assigned/model=*/done-4-2/_SUCCESS")
    mark.unlink()
    flipped = rows.withColumn("v", F.transform("v", lambda x: -x))
    again = {r["id"]: r["topic"] for r in pipelines.assign_all(flipped, "id", "v", cents, "topic", out, 4).collect()}
    changed = {i for i in again if again[i] != first[i]}
    part = {r["id"] for r in rows.filter("pmod(xxhash64(id), 4) = 2").collect()}
    assert changed == part and again.keys() == first.keys()


def test_titles_found_match_their_own_paper(spark):
    papers = spark.createDataFrame([(1, 'On "Big" Parsers', 2001), (2, "Kernels!", 2005), (3, "Nothing Found", 2009), (4, None, 2001), (5, "Kernels!", 2005)], "id long, title string, year int")
    asked = responses.title_requests(papers, "id")
    assert {r["id"]: r["values"][0] for r in asked.collect()}[1] == 'title.search:"On \\"Big\\" Parsers",publication_year:2001'
    assert asked.count() == 4 and asked.select("cache_key").distinct().count() == 3
    found = {"Parsers": [("W1", "Something else", 2001), ("W2", 'On "Big" Parsers', 2001)], "Kernels": [("W3", "kernels", 2006), ("W4", 'On "Big" Parsers', 2001)], "Nothing": []}

    def fetch(values):
        return 200, json.dumps({"results": [{"id": i, "display_name": t, "publication_year": y} for k, ws in found.items() if k in values[0] for i, t, y in ws]}), None

    answers = responses.scan(asked.select("cache_key", "values").distinct(), fetch, per_second=1e9)
    c = responses.title_candidates(asked, answers, "id")
    got = {r["id"]: (r["openalex_id"], r["kind"]) for r in match.match_titles(papers, c, "id", "openalex_id", own=True).collect()}
    assert got == {1: ("W2", "strict"), 2: ("W3", "loose"), 5: ("W3", "loose")}


def test_rounds_of_a_scan(spark, tmp_path):
    requests = spark.createDataFrame([(f"k{i}", [f"10.1/{i}a", f"10.1/{i}b"]) for i in range(6)], "cache_key string, values array<string>")
    path = f"file://{tmp_path}/answers"
    body = lambda vs: json.dumps({"results": [{"doi": v, "abstract_inverted_index": {"w": [0]} if v.endswith("a") else None} for v in vs]})
    quiet = {"per_second": 1e9, "lanes": 1, "sleep": lambda s: None}
    # One request is refused whole, and the budget ends within one of its halves: none of it counts as answered.
    spent = lambda vs: (400, None, None) if len(vs) > 1 and "3a" in vs[0] else (429, None, None) if vs == ["10.1/3b"] else (200, body(vs), None)
    some = responses.scan_rounds(requests, path, spent, **quiet)
    left = responses.pending(requests, some)
    assert "k3" in {r["cache_key"] for r in left.collect()} and {r["status"] for r in some.collect()} <= {200}
    assert responses.scan_summary(requests, some, f"file://{tmp_path}/summary").count() == 2 * some.select("cache_key").distinct().count()
    assert not (tmp_path / "summary").exists()
    # Another call asks for the rest alone.
    calls = spark.sparkContext.accumulator(0)

    def answer(values):
        calls.add(1)
        return 200, body(values), None

    done = responses.scan_rounds(requests, path, answer, **quiet)
    assert calls.value == 6 - some.select("cache_key").distinct().count()
    assert responses.pending(requests, done).isEmpty()
    summary = responses.scan_summary(requests, done, f"file://{tmp_path}/summary")
    assert summary.count() == 12 and summary.filter("has_abstract").count() == 6
    # Kept under the numbers of requests and values: read again without the answers.
    assert responses.scan_summary(requests, done.limit(0), f"file://{tmp_path}/summary").count() == 12
    assert responses.scan_summary(requests.limit(5), done, f"file://{tmp_path}/summary").count() == 12


def test_growth_line(spark):
    rows = spark.createDataFrame([("na", None, None), ("new", None, "1990s"), ("up", 41.6, "1990s"), ("down", -12.0, "2000s")], "s string, p double, b string")
    got = [r[0] for r in rows.select(T.growth_line(F.col("s"), F.col("p"), F.col("b"))).collect()]
    assert got == ["growth: — (no earlier decade)", "new vs 1990s", "growth vs 1990s: +42% of share", "growth vs 2000s: -12% of share"]
