"""Payloads of scopes against plain Python, reports, and the command line from tables to figures."""

import json
from collections import Counter

import pytest
import yaml
from pyspark.sql import functions as F

from plumbline.plans import pipelines

PAPERS = [(f"p{i}", f"conf/{'abc'[i % 3]}", 1990 + i % 23, i % 5) for i in range(200)] + [("px", "conf/a", None, 1), ("py", "conf/a", 2001, None)]
LABELS = {0: "parsers", 1: "kernels", 2: "</script> tests", 3: "proofs", 4: "graphs"}
GROUPS = {0: "Languages", 1: "Systems", 2: "Quality", 3: "Quality", 4: "Unused of c"}


@pytest.fixture(scope="module")
def tables(spark):
    papers = spark.createDataFrame(PAPERS, "dblp_key string, conf string, year int, topic_id int")
    topics = spark.createDataFrame([(i, w) for i, w in LABELS.items()], "topic_id int, llm_label string")
    return papers, topics


def config():
    names = ["Quality", "Systems", "Languages", "Unused of c"]
    return {"groups": [{"name": g, "color": "#112233", "topics": [LABELS[t] for t in LABELS if GROUPS[t] == g]} for g in names]}


def test_scope_payloads_against_python(spark, tables):
    papers, topics = tables
    rows = papers.join(topics, "topic_id", "left").withColumn("group", F.create_map(*(F.lit(x) for t, g in GROUPS.items() for x in (t, g)))[F.col("topic_id")])
    order = {g["name"]: i for i, g in enumerate(config()["groups"])}
    groups = spark.createDataFrame(list(order.items()), "`group` string, `order` int")
    scopes = {"all": "all", "ab": ["conf/a", "conf/b"], "none": ["conf/z"]}
    got = {r["scope"]: r["payload"] for r in pipelines.scope_payloads(rows, groups, scopes).collect()}
    assert set(got) == {"all", "ab"} and "</script" not in got["all"]
    for name, confs in (("all", None), ("ab", {"conf/a", "conf/b"})):
        mine = [(GROUPS[t], y // 5 * 5, LABELS[t]) for _, c, y, t in PAPERS if t is not None and y is not None and (confs is None or c in confs)]
        data = json.loads(got[name])
        by, per, leaf = Counter((g, b) for g, b, _ in mine), Counter(b for _, b, _ in mine), Counter(mine)
        assert data["groups"] == sorted({g for g, _, _ in mine}, key=order.get) and data["buckets"] == sorted(per)
        for g in data["groups"]:
            assert data["freq"][g] == [by[g, b] for b in data["buckets"]]
            assert data["share"][g] == pytest.approx([by[g, b] / per[b] for b in data["buckets"]])
            for b in data["buckets"]:
                want = sorted(((-n, w) for (h, c, w), n in leaf.items() if (h, c) == (g, b)))
                if want:
                    assert data["topics"][g][str(b)] == [{"name": w, "papers": -n, "share": round(-n / by[g, b], 4)} for n, w in want]
                else:
                    assert str(b) not in data["topics"][g]
    assert pipelines.scope_payloads(rows.limit(0), groups, scopes).count() == 0


def test_command_line(spark, tables, tmp_path, capsys):
    papers, topics = tables
    papers.write.parquet(f"{tmp_path}/papers")
    topics.write.parquet(f"{tmp_path}/topics")
    (tmp_path / "groups.yaml").write_text(yaml.safe_dump(config()))
    (tmp_path / "scopes.yaml").write_text(yaml.safe_dump({"all": "all", "a": ["conf/a"]}))
    at = lambda name: f"file://{tmp_path}/{name}"
    pipelines.main(["groups", at("topics"), at("papers"), at("groups.yaml"), at("grouped")])
    shown = capsys.readouterr().out
    n = Counter(GROUPS[t] for *_, t in PAPERS if t is not None)
    assert f"| 0 | Quality | {n['Quality']} |" in shown and "Unused of c" in shown
    pipelines.main(["figures", at("grouped/papers"), at("grouped/topics"), at("groups.yaml"), at("figures"), "--scopes", at("scopes.yaml")])
    assert {r["scope"] for r in spark.read.parquet(at("figures/payloads")).collect()} == {"all", "a"}
    assert spark.read.parquet(at("figures/rank")).count() > 0
    corpus = papers.withColumns({"title": F.lit("t"), "doi": F.lit("10.1/x"), "abstract": F.lit("text"), "has_abstract": F.col("year") % 2 == 0, "text": F.lit("t text")})
    corpus.write.parquet(f"{tmp_path}/corpus")
    pipelines.main(["select", at("corpus"), at("selected"), "--min-papers", "10", "--min-rate", "0.1", "--size", "30", "--cap", "10"])
    universe = spark.read.parquet(at("selected/universe"))
    assert universe.filter("in_fit").count() == 30 and universe.count() == corpus.filter("has_abstract").count()
    (tmp_path / "log.csv").write_text("dblp_key,group,correct,error_type\np1,A,y,\np2,A,n,g\np3,B,y,\np4,B,s,\n")
    pipelines.main(["validate", at("log.csv"), at("validated")])
    rows = {r["group"]: (r["n"], r["k"]) for r in spark.read.option("header", True).csv(at("validated/accuracy")).collect()}
    assert rows == {"A": ("2", "1"), "B": ("1", "1")}
