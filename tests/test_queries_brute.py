"""Registered queries that SQL has no form for, over their whole tables, against plain Python."""

import hashlib
import html as H
import json
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.functions import text as T
from plumbline.operators import meaning, terms, vectors

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def words_of(text):
    return [w for w in re.findall(r"\w+", (text or "").lower()) if re.fullmatch("[a-z][a-z]+", w)]


def test_normalize_text_nfkc(spark, documents):
    def norm(t):
        t = unicodedata.normalize("NFKC", t or "")
        t = re.sub(r"<[^>]+>", " ", re.sub(r"\$[^$]*\$", " ", t)).lower()
        return re.sub(r"\s+", " ", t).strip(" ")

    want = sorted((d["doc_id"], hashlib.md5(norm(d["text"]).encode()).hexdigest()) for d in documents)
    assert sorted(map(tuple, run(spark, "normalize_text_nfkc"))) == want


def test_doi_batches(spark):
    rows = run(spark, "doi_batches")
    urls = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    assert sorted(r["url"] for r in rows) == sorted(u for u in urls if u is not None)
    batches = {}
    for r in rows:
        batches.setdefault((r["part"], r["batch"]), []).append(r["url"])
    for (part, batch), mine in batches.items():
        assert len(mine) <= 100 and sum(len(u) + 1 for u in mine) <= 4000 + 1
        after = batches.get((part, batch + 1))
        if after:  # packed greedily, in order: the next value didn't fit
            assert max(mine) <= min(after) and (len(mine) == 100 or sum(len(u) + 1 for u in mine) + len(min(after)) + 1 > 4000)


def test_html_text_extract(spark):
    for r in run(spark, "html_text_extract"):
        page = spark.read.parquet(f"{SF}/pages.parquet").filter(F.col("page_id") == r["page_id"]).first()["html"] if r["page_id"] % 10 == 0 else None
        if page is None:
            continue
        page = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ", page)
        parts, at = [], 0
        low = page.lower()
        for m in re.finditer(r"(?i)<p\b[^>]*>", page):
            if m.start() < at:
                continue
            ends = [e for e in (low.find("</p>", m.end()), low.find("</article>", m.end()), next((x.start() for x in re.finditer(r"(?i)<p\b", page[m.end() :])), -1)) if e >= 0]
            nxt = re.search(r"(?i)</p>|<p\b|</article>", page[m.end() :])
            end = m.end() + nxt.start() if nxt else len(page)
            assert ends or not nxt
            text = H.unescape(re.sub(r"<[^>]+>", " ", page[m.end() : end]))
            text = re.sub(r"[ \t\n\x0b\f\r]+", " ", text.replace("\xa0", " ")).strip(" ")
            if text:
                parts.append(text)
            at = end
        assert r["text"] == "\n".join(parts)


def test_lemma_terms(spark, documents):
    df, total = Counter(), Counter()
    for d in documents:
        mine = Counter(T.lemma(w) for w in words_of(d["text"]))
        total.update(mine)
        df.update(mine.keys())
    want = sorted((t, n, total[t]) for t, n in df.items() if n >= 3)
    want = sorted(want, key=lambda r: (-r[2], r[0]))[:20_000]
    assert sorted(map(tuple, run(spark, "lemma_terms"))) == sorted(want)


# Words and the base forms that a dictionary gives them; the rules have to agree on these.
LEMMAS = {"studies": "study", "classes": "class", "boxes": "box", "parsers": "parser", "bus": "bus", "analysis": "analysis", "apis": "api", "testing": "test", "stopped": "stop", "running": "run", "created": "create", "using": "use", "programming": "program", "software": "software", "found": "find", "data": "data", "matches": "match", "process": "process", "driven": "driven", "tools": "tool", "missing": "miss", "falling": "fall", "libraries": "library", "string": "string"}


def test_lemmas_of_a_list():
    assert {w: T.lemma(w) for w in LEMMAS} == LEMMAS


def test_topic_labels(spark):
    lists = {r["source"]: r["words"] for r in spark.createDataFrame([(r["source"], r["top"].split(",")) for r in _tops(spark)], "source string, words array<string>").collect()}
    for r in run(spark, "topic_labels"):
        words = lists[r["source"]]
        assert r["label"] == " ".join(w.capitalize() for w in words[:3])
        three = words[:3]
        while three and three[0] in T.JOINING_WORDS:
            three = three[1:]
        while three and three[-1] in T.JOINING_WORDS:
            three = three[:-1]
        assert r["clean"] == " ".join(w.capitalize() for w in three)


def _tops(spark):
    """The ten words of each source by class TF-IDF, in Python."""
    counts, df = {}, Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        mine = Counter(words_of(r["text"]))
        df.update(mine.keys())
        counts.setdefault(r["source"], Counter()).update(mine)
    counts = {s: Counter({w: n for w, n in c.items() if df[w] >= 3}) for s, c in counts.items()}
    whole = sum(counts.values(), Counter())
    mean = sum(whole.values()) / len(counts)
    for s, c in counts.items():
        w = {t: round(n / sum(c.values()) * math.log1p(mean / whole[t]), 9) for t, n in c.items()}
        yield {"source": s, "top": ",".join(sorted((t for t in w if w[t] > 0), key=lambda t: (-w[t], t))[:10])}


def test_term_embeddings(spark, documents):
    rows = {r["doc_id"]: np.array(r["vector"]) for r in run(spark, "term_embeddings")}
    bags = {d["doc_id"]: Counter(words_of(d["text"])) for d in documents}
    place = {w: None for b in bags.values() for w in b}
    some = spark.createDataFrame([(w,) for w in place], "t string")
    for r in vectors.embed_terms(some, "t").collect():
        place[r["t"]] = int(np.argmax(r["vector"]))
    for i, bag in bags.items():
        v = np.zeros(256)
        for w, n in bag.items():
            v[place[w]] += n
        length = np.linalg.norm(v)
        assert np.allclose(rows[i], v / length if length else v, atol=1e-6)


def test_reduced_vectors(spark):
    rows = run(spark, "reduced_vectors")
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(table)
    x = np.array([table[i] for i in ids], dtype=float)
    got = np.array([{r["vec_id"]: r["reduced"] for r in rows}[i] for i in ids])
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, np.argsort(-values)[:5]]
    for k in range(5):
        mine = x @ axes[:, k]
        assert min(np.abs(got[:, k] - mine).max(), np.abs(got[:, k] + mine).max()) < 1e-4


def test_kmeans_topics(spark):
    rows = run(spark, "kmeans_topics")
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert {r["vec_id"] for r in rows} == set(table) and {r["topic_id"] for r in rows} <= set(range(-1, 10))
    # Each row is nearer to the mean direction of its own cluster than rows are on average to others.
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in table.items()}
    own, other = [], []
    for t in range(10):
        members = [unit[r["vec_id"]] for r in rows if r["topic_id"] == t]
        if members:
            c = np.mean(members, axis=0)
            own += [c @ m for m in members]
            other += [c @ unit[r["vec_id"]] for r in rows if r["topic_id"] not in (t, -1)]
    assert np.mean(own) > np.mean(other) + 0.05


def test_kmeans_of_blobs(spark):
    rng = np.random.default_rng(3)
    angles = [0.2, 1.7, 3.3]
    rows = [(i, [float(x) for x in (math.cos(angles[i % 3]) + rng.normal(0, 0.02), math.sin(angles[i % 3]) + rng.normal(0, 0.02))]) for i in range(90)]
    got = {r["id"]: r["topic_id"] for r in vectors.cluster(spark.createDataFrame(rows, "id int, v array<double>"), "v", 3).collect()}
    assert len({got[i] for i in range(3)}) == 3 and all(got[i] == got[i % 3] for i in got)


def test_lda_topics(spark, documents):
    rows = run(spark, "lda_topics")
    by = {}
    for r in rows:
        by.setdefault(r["topic"], []).append((r["rank"], r["term"], r["weight"]))
    df = Counter(w for d in documents for w in set(words_of(d["text"])))
    assert set(by) == set(range(8))
    for mine in by.values():
        mine.sort()
        weights = [w for _, _, w in mine]
        assert [k for k, _, _ in mine] == list(range(1, 11)) and weights == sorted(weights, reverse=True) and 0 < sum(weights) <= 1 + 1e-9
        assert all(df[t] >= 3 for _, t, _ in mine)


def test_streamgraph_payload(spark):
    (row,) = run(spark, "streamgraph_payload")
    series = json.loads(row["payload"])
    orders = Counter((r[0], r[1]) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderpriority", F.year("o_orderdate")).collect())
    assert {(s["theme"], s["y"]): s["papers"] for s in series if s["papers"]} == dict(orders)
    assert [(s["theme"], s["y"]) for s in series] == sorted((s["theme"], s["y"]) for s in series)


# ---- meaning and windows, by small tables


TEXTS = [(1, "the cat sat near the dog"), (2, "a cat and a dog and a cat"), (3, None), (4, ""), (5, "word"), (5, "dog cat dog")]


@pytest.mark.parametrize("window,held", [(1, 1 << 20), (3, 1 << 20), (5, 4)])
def test_near_counts(spark, window, held):
    want = Counter()
    for _, t in TEXTS:
        ws = words_of(t)
        for i, a in enumerate(ws):
            for j, b in enumerate(ws):
                if i != j and abs(i - j) <= window:
                    want[a, b] += 1
    got = {(r["word"], r["near"]): r["n"] for r in meaning.near_counts(spark.createDataFrame(TEXTS, "id int, t string").repartition(3), "t", window, held=held).collect()}
    assert got == want


def test_words_of_like_company_are_near(spark):
    """Pets and tools never stand beside each other, but have company of their own kind."""
    rng = np.random.default_rng(6)
    kinds = [["cat", "dog", "hamster", "rabbit"], ["hammer", "saw", "drill", "wrench"]]
    around = [["fur", "feed", "paw", "vet", "sleep", "play"], ["steel", "workshop", "nail", "bolt", "repair", "wood"]]
    rows = []
    for i in range(600):
        k = i % 2
        ws = [str(rng.choice(around[k])) for _ in range(6)]
        ws.insert(3, str(rng.choice(kinds[k])))
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "id int, t string")
    near = meaning.near_counts(docs, "t", 4)
    words = meaning.word_vectors(meaning.mutual_information(near, 3), size=4, extra=6).cache()
    found = meaning.nearest_words(words, ["cat", "drill"], 3)
    got = {w: {r["near"] for r in found.collect() if r["word"] == w} for w in ("cat", "drill")}
    assert got["cat"] <= {*kinds[0], *around[0]} and got["drill"] <= {*kinds[1], *around[1]}
    texts = meaning.text_vectors(docs.unionByName(spark.createDataFrame([(9000, None), (9001, "zzz")], "id int, t string")), "id", "t", words, near.groupBy("word").agg(F.sum("n").alias("n")), block=5)
    v = {r["id"]: np.array(r["vector"]) for r in texts.collect()}
    assert len(v) == 602 and not v[9000].any() and not v[9001].any()
    assert np.mean([v[0] @ v[2 * i] for i in range(1, 100)]) > np.mean([v[0] @ v[2 * i + 1] for i in range(100)]) + 0.5


def test_decomposition_against_numpy(spark):
    """A matrix of low rank comes back whole: products of the left vectors are those of numpy's."""
    rng = np.random.default_rng(8)
    m = np.maximum(rng.normal(size=(30, 3)) @ rng.normal(size=(3, 30)), 0)
    u, s, _ = np.linalg.svd(m)
    rows = [(f"w{i:02d}", f"w{j:02d}", float(m[i, j])) for i in range(30) for j in range(30) if m[i, j] > 0]
    got = {r["word"]: r["v"] for r in meaning.word_vectors(spark.createDataFrame(rows, "word string, near string, m double").repartition(4), size=5, extra=25).collect()}
    x = np.array([got.get(f"w{i:02d}", [0.0] * 5) for i in range(30)])
    want = u[:, :5] * np.sqrt(s[:5])
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-3)


@pytest.mark.parametrize("cells", [10**6, 1])
@pytest.mark.parametrize("window,stride,least", [(4, 1, 0.1), (3, 2, 0.0), (50, 1, 0.3)])
def test_window_shares(spark, cells, window, stride, least):
    docs = [(1, "a", "parser grammar syntax parser tokens grammar"), (2, "b", "kernel driver memory page kernel"), (3, "c", "memory page and a parser grammar and kernel unknown words"), (4, "c", None), (5, "c", "zzz"), (6, "b", "page page page page page")]
    frame = spark.createDataFrame(docs, "id int, topic string, t string")
    weights = terms.topic_weights(terms.doc_terms(frame.filter("id < 5"), "id", "t", ["topic"]), "topic", outlier="c")
    table = {}
    for r in weights.collect():
        table.setdefault(r["topic"], {})[r["term"]] = r["w"]
    idf = {r["term"]: r["idf"] for r in weights.collect()}
    want = {}
    for i, _, text in docs:
        ws = words_of(text)
        if not ws:
            continue
        n = min(window, len(ws))
        sums = Counter()
        for at in range(0, len(ws) - n + 1, stride):
            x = {w: k * idf[w] for w, k in Counter(ws[at : at + n]).items() if w in idf}
            length = math.sqrt(sum(v * v for v in x.values()))
            for topic, w in table.items():
                cos = sum(v * w.get(t, 0) for t, v in x.items()) / (length * math.sqrt(sum(v * v for v in w.values()))) if length else 0
                if round(cos, 9) >= least and cos > 0:
                    sums[topic] += cos
        for topic, s in sums.items():
            want[i, topic] = s / sum(sums.values())
    got = {(r["id"], r["topic"]): r["share"] for r in terms.window_shares(frame, "id", "t", weights, "topic", window, stride, least, cells=cells).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want) and len(want) >= 4
