"""Files in, files out, responses, pages, streams and whole flows."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import schemas, storage
from plumbline.operators import clean, match
from plumbline.plans import pipelines
from plumbline.sources import html, io, responses
from plumbline.streaming import events

XML = """<?xml version="1.0"?><dblp>
<inproceedings key="conf/a/1"><author>Ann Lee 0001</author><author>Bo</author><title>On <i>Tests</i>.</title><year>2001</year><ee>https://x.org/1</ee><ee>https://doi.org/10.1/A</ee><booktitle>ICSE</booktitle></inproceedings>
<inproceedings key="conf/a/2" publtype="withdrawn"><title>Gone</title><year>2001</year></inproceedings>
<inproceedings key="journals/a/3"><title>No</title><year>2001</year></inproceedings>
</dblp>"""


def test_xml(spark, tmp_path):
    with gzip.open(tmp_path / "d.xml.gz", "wt") as f:
        f.write(XML)
    rows = clean.papers_of_records(io.read_records(spark, str(tmp_path / "d.xml.gz"))).collect()
    assert [(r["conf"], r["title"], r["year"], r["doi"], r["authors"]) for r in rows] == [("conf/a", "On Tests", 2001, "10.1/a", ["Ann Lee 0001", "Bo"])]


def test_responses_skip_broken_files(spark, tmp_path):
    work = {"id": "W1", "doi": "https://doi.org/10.1/A", "display_name": "T", "publication_year": 2001, "abstract_inverted_index": {"a": [0], "b": [1]}, "concepts": [], "cited_by_count": 3, "type": "article"}
    (tmp_path / "a.json").write_text(json.dumps({"results": [work]}))
    (tmp_path / "b.json").write_text("{broken")
    got = match.works(io.read_responses(spark, str(tmp_path))).collect()
    assert [(r["doi"], r["abstract"]) for r in got] == [("10.1/a", "a b")]
    papers = spark.createDataFrame([("k1", "10.1/a"), ("k2", None)], "dblp_key string, doi string")
    out = {r["dblp_key"]: r for r in match.enrich_by_doi(papers, match.works(io.read_responses(spark, str(tmp_path)))).collect()}
    assert out["k1"]["citation_count"] == 3 and out["k2"]["oa_concepts"] == []


def test_batched_source(spark):
    values = spark.createDataFrame([(f"10.1/{i}",) for i in range(7)], "doi string")
    plan = responses.plan(values, "doi", most=3)
    works = [{"id": f"W{i}", "doi": f"https://doi.org/10.1/{i}", "display_name": "T"} for i in range(7)]
    answers = responses.scan(plan, responses.stored(works), per_second=1e6)
    assert match.works(responses.parsed(answers)).count() == 7
    assert responses.pending(plan, answers).count() == 0


def test_ask_halves_and_waits():
    asked, waits = [], []

    def fetch(values):
        asked.append(len(values))
        if len(values) > 1:
            return 400, None, None
        return (503, None, 2.0) if len(asked) == 3 else (200, "x", None)

    assert [s for s, _ in responses.ask(fetch, ["a", "b", "c"], sleep=waits.append)] == [200, 200, 200]
    assert asked[0] == 3 and waits == [2.0] or waits == []
    assert responses.ask(lambda v: (429, None, None), ["a"]) == [(429, None)]


def test_words_yaml_npy_csv(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\nThe\n and # more\n\n")
    assert {r[0] for r in io.read_words(spark, str(tmp_path / "w.txt")).collect()} == {"the", "and"}
    (tmp_path / "g.yaml").write_text("groups:\n- {name: A, color: '#fff', topics: [x, y]}\n- {name: B, topics: [z]}\n")
    groups, topics = io.group_table(spark, io.read_yaml(spark, str(tmp_path / "g.yaml")))
    assert groups.count() == 2 and topics.count() == 3
    with pytest.raises(ValueError, match="x"):
        io.group_table(spark, {"groups": [{"name": "A", "topics": ["x"]}, {"name": "B", "topics": ["x"]}]})
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r["vec"] for r in io.read_npy(spark, str(tmp_path / "v.npy")).orderBy("id").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    df = spark.createDataFrame([("k", ["a", "b"])], "dblp_key string, names array<string>")
    io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), df.withColumn("names", F.lit("")).schema).collect()[0]["names"] == "a; b"
    assert "| k | a; b |" in io.markdown(df, ["dblp_key"])
    assert "topics:\n  - k" in io.propose_groups(df.withColumn("g", F.lit("G")), "dblp_key", "g")
    assert json.loads(io.payload(df, ["dblp_key"]).collect()[0][0]) == [{"dblp_key": "k", "names": ["a", "b"]}]


def test_reviews(spark, tmp_path):
    log = spark.createDataFrame([("k1", "t", "g", "l", "n", "g", ""), ("k2", "t", "g", "l", "y", "", "")], schemas.REVIEWS)
    io.append_reviews(log, str(tmp_path / "log"))
    back = io.read_csv(spark, str(tmp_path / "log"), schemas.REVIEWS)
    new = io.update_reviews(back, log.filter("dblp_key = 'k1'").withColumn("correct", F.lit("y")))
    assert {(r["dblp_key"], r["correct"]) for r in new.collect()} == {("k1", "y"), ("k2", "y")}


def test_overwrite_own_input(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.overwrite(spark.range(3), path)
    assert storage.backup_once(spark, path) and not storage.backup_once(spark, path)
    assert storage.overwrite(spark.read.parquet(path).withColumn("x", F.lit(1)), path).columns == ["id", "x"]
    assert storage.write_missing(spark.range(5).withColumn("x", F.lit(2)), path, "id").count() == 5
    assert [r["present"] for r in storage.status(spark, [path, path + "-no"]).collect()] == [True, False]


def test_clean_up(spark):
    path = storage.shared_dir(spark, "some")
    spark.range(2).write.parquet(path)
    assert storage.exists(spark, path) and storage.clean_up(spark) >= 1
    assert not storage.exists(spark, path)


def test_html(spark):
    pages = ['<meta property="og:title" content="A &amp; B | Site"><title>C</title><section id="abstract"><h2>Abstract</h2><div role="paragraph">One.</div><div role="paragraph">Two.</div></section>', "<title>C</title><section id='abstract'><h2>Abstract</h2> Text <b>x</b></section>", "<script>var a='<title>no</title>'</script><p>one<p>two</p>", None, '<div class="abstractSection abstractInFull"><p>Abstract</p><p>Full.</p></div>']
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    h = F.col("h")
    got = df.select(html.title(h), html.abstract(h), html.paragraphs(h)).collect()
    assert [r[0] for r in got][:2] == ["A & B", "C"]
    assert [r[1] for r in got] == ["One. Two.", "Text x", None, None, "Full."]
    assert got[2][2] == ["one", "two"] and got[3][2] == []


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(src / "events.parquet"))
    stream = events.read_stream(spark, str(src / "events.parquet"))
    events.run_available(events.distinct_events(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
    again = events.read_stream(spark, str(src / "events.parquet"))
    events.run_available(events.distinct_events(again), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
    q = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = e.groupBy("event_type", F.date_trunc("hour", "ts").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    assert spark.sql("select sum(n) from tumbling").collect()[0][0] == batch.agg(F.sum("n")).collect()[0][0]
    q = events.sessions(stream).writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination()
    events.upsert_latest(stream.select("user_id", "ts", "value"), str(tmp_path / "latest"), "user_id", str(tmp_path / "cp2"), ["ts"])
    assert events.read_latest(spark, str(tmp_path / "latest")).count() == e.select("user_id").distinct().count()


def test_flows(spark, tmp_path):
    rows = [(f"conf/{'ab'[i % 2]}", f"conf/x/{i}", f"Title number {i}", 1990 + i % 20, f"10.1/{i}" if i % 4 else None, ["A", f"B{i % 3}"], None, None, "A") for i in range(200)]
    papers = spark.createDataFrame(rows, schemas.PAPERS)
    sliced = pipelines.venue(papers, "conf/a", "a", str(tmp_path / "venue"))
    assert sliced.count() == 100 and "has_doi" in sliced.columns
    works = spark.createDataFrame([([(f"W{i}", f"10.1/{i}", "t", 1990, {"word": [0], f"w{i % 5}": [1]}, None, 1, "a") for i in range(150)],)], schemas.WORKS)
    overrides = spark.createDataFrame([("conf/x/160", "from the override")], schemas.OVERRIDES)
    corpus = pipelines.corpus(papers, works, overrides, str(tmp_path / "corpus"))
    assert corpus.filter("has_abstract").count() == 113
    sampled, report = pipelines.select_corpus(corpus, ["conf/a"], min_papers=10, min_rate=0.1, size=80, cap=30)
    assert report.count() == 2 and sampled.filter("in_fit").count() >= 57
    topics = spark.createDataFrame([(1, "X", ["x"], 3, None, None), (2, "Y", ["y"], 3, None, None)], schemas.TOPICS)
    assigned = corpus.select("dblp_key", "conf", "year", (F.length("title") % 2 + 1).cast("int").alias("topic_id"))
    groups, members = spark.createDataFrame([("G", 1, "#111111"), ("H", 2, "#222222")], "`group` string, `order` int, color string"), spark.createDataFrame([("X", "G"), ("Y", "H")], "llm_label string, `group` string")
    named, themed, registry = pipelines.apply_groups(topics, assigned, groups, members)
    assert registry.agg(F.sum("papers")).collect()[0][0] == 200
    tables = pipelines.figures(themed, named)
    assert all(t.count() > 0 for t in tables.values())
    flows, summary = pipelines.migrations(themed, papers)
    assert summary.count() > 0
    with pytest.raises(ValueError, match="Y"):
        pipelines.apply_groups(topics, assigned, groups, members.filter("llm_label = 'X'"))
