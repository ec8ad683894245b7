"""Queries over terms, labels, names and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import meaning, sample
from plumbline.operators import terms as O
from plumbline.plans.registry import query, table
from plumbline.sources import html
from plumbline.storage import shared_dir

_TERMS = r"""w AS (SELECT doc_id, lang, source, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z]+'))) AS term FROM documents),
t AS (SELECT doc_id, lang, source, term, count(*) AS tf FROM w GROUP BY 1, 2, 3, 4)"""


def _terms(spark, sf_dir):
    return O.doc_terms(table(spark, sf_dir, "documents"), "doc_id", "text", ["lang", "source"])


@query(f"WITH {_TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM t GROUP BY 1 HAVING count(*) >= 3")
def doc_tokens_df(spark, sf_dir):
    return O.vocabulary(_terms(spark, sf_dir), 3)


def _weights(classes: str, min_df: int) -> str:
    keys = [c.strip() for c in classes.split(",")]
    on = " AND ".join(f"n.{k} = c.{k}" for k in keys)
    return f"""df AS (SELECT term FROM t GROUP BY 1 HAVING count(*) >= {min_df}), n AS (SELECT {classes}, term, sum(tf) AS n FROM t WHERE term IN (SELECT term FROM df) GROUP BY {classes}, term),
c AS (SELECT {classes}, sum(n) AS c FROM n GROUP BY {classes}), f AS (SELECT term, sum(n) AS f FROM n GROUP BY 1), a AS (SELECT sum(c) / count(*) AS a FROM c),
x AS (SELECT {', '.join('n.' + k for k in keys)}, n.term, n.n, round(n.n / c.c * ln(1 + a.a / f.f), 9) AS w FROM n JOIN c ON {on} JOIN f ON f.term = n.term CROSS JOIN a),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {classes} ORDER BY w DESC, term) AS INTEGER) AS rank FROM x WHERE w > 0))"""


def _top(spark, sf_dir, classes: list[str], min_df: int, k: int):
    return O.top_terms(O.class_tfidf(O.class_counts(_terms(spark, sf_dir), classes, min_df), classes), classes, k)


@query(f"WITH {_TERMS}, {_weights('lang', 3)} SELECT lang, term, rank, round(w, 6) AS w FROM top WHERE rank <= 10")
def ctfidf_top_terms(spark, sf_dir):
    return _top(spark, sf_dir, ["lang"], 3, 10).select("lang", "term", "rank", F.round("w", 6).alias("w"))


@query(f"WITH {_TERMS}, {_weights('lang, source', 2)} SELECT lang, source, string_agg(term, ', ' ORDER BY rank) AS top_words FROM top WHERE rank <= 5 GROUP BY 1, 2")
def ctfidf_by_lang_source(spark, sf_dir):
    return O.word_lists(_top(spark, sf_dir, ["lang", "source"], 2, 5), ["lang", "source"], as_text=True)


_SOURCE_TOP = f"{_TERMS}, {_weights('source', 3)}, s AS (SELECT source, term, rank FROM top WHERE rank <= 10)"


def _source_top(spark, sf_dir):
    """The ten words of each source, written: a small table, which would else be made anew from all texts in each use."""
    folder = shared_dir(spark, "source-top")
    _top(spark, sf_dir, ["source"], 3, 10).write.parquet(folder)
    return spark.read.parquet(folder)


@query(f"WITH {_SOURCE_TOP} SELECT count(*) AS n_words, count(DISTINCT term) AS n_unique, round(count(DISTINCT term) / count(*), 6) AS diversity FROM s")
def topic_word_diversity(spark, sf_dir):
    return O.topic_diversity(_source_top(spark, sf_dir))


_PAIRS = "pr AS (SELECT a.source AS a, b.source AS b, count(*) AS shared, round(count(*) / (20 - count(*)), 6) AS jaccard FROM s a JOIN s b ON a.term = b.term AND a.source < b.source GROUP BY 1, 2)"


@query(f"WITH {_SOURCE_TOP}, {_PAIRS} SELECT * FROM pr")
def topic_jaccard_pairs(spark, sf_dir):
    return O.jaccard_pairs(_source_top(spark, sf_dir), "source")


@query(f"""WITH RECURSIVE {_SOURCE_TOP}, {_PAIRS}, e AS (SELECT a AS u, b AS v FROM pr WHERE jaccard >= 0.15 UNION SELECT b, a FROM pr WHERE jaccard >= 0.15),
reach(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v) SELECT u AS node, min(v) AS root FROM reach GROUP BY u""")
def duplicate_topic_groups(spark, sf_dir):
    return O.merge_similar(O.jaccard_pairs(_source_top(spark, sf_dir), "source"))


_COHERENCE = f"""{_SOURCE_TOP}, d AS (SELECT count(*) AS n FROM documents), dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM t WHERE term IN (SELECT term FROM s) GROUP BY 1),
u AS (SELECT DISTINCT doc_id, term FROM t WHERE term IN (SELECT term FROM s)), co AS (SELECT x.term AS t1, y.term AS t2, count(*) AS co FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.term <> y.term GROUP BY 1, 2),
q AS (SELECT a.source, a.term AS t1, b.term AS t2, f1.df AS d1, f2.df AS d2, coalesce(co.co, 0) AS co FROM s a JOIN s b ON a.source = b.source AND a.rank < b.rank JOIN dfs f1 ON f1.term = a.term JOIN dfs f2 ON f2.term = b.term LEFT JOIN co ON co.t1 = a.term AND co.t2 = b.term)"""


@query(f"""WITH {_COHERENCE} SELECT source, round(avg(CASE WHEN co = 0 THEN -1 WHEN co = n THEN 1 ELSE (log2(co / n) - log2(d1 / n) - log2(d2 / n)) / -log2(co / n) END), 6) AS npmi,
round(avg(ln((co + 1) / greatest(d1, 1))), 6) AS umass FROM q, d GROUP BY source""")
def cooccurrence_npmi_umass(spark, sf_dir):
    top = _source_top(spark, sf_dir)
    df, pairs = O.cooccurrence_in_texts(table(spark, sf_dir, "documents"), "text", top)
    n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    return O.coherence(top, "source", df, pairs, n_docs)


_OUTLIERS = f"""{_TERMS}, g AS (SELECT doc_id, CASE WHEN n_chars < 500 THEN '-1' ELSE lang END AS topic FROM documents),
n AS (SELECT topic, term, sum(tf) AS n FROM t JOIN g USING (doc_id) GROUP BY 1, 2), c AS (SELECT topic, sum(n) AS c FROM n GROUP BY 1), a AS (SELECT sum(c) / count(*) AS a FROM c),
i AS (SELECT term, ln(1 + any_value(a.a) / sum(n)) AS idf FROM n CROSS JOIN a GROUP BY 1), x AS (SELECT n.topic, n.term, n.n / c.c * idf AS w FROM n JOIN c ON c.topic = n.topic JOIN i ON i.term = n.term WHERE n.topic <> '-1'),
l AS (SELECT topic, sqrt(sum(w * w)) AS l FROM x GROUP BY 1), s AS (SELECT t.doc_id, x.topic, round(sum(tf * idf * w) / any_value(l), 9) AS s FROM t JOIN g ON g.doc_id = t.doc_id AND g.topic = '-1' JOIN i ON i.term = t.term JOIN x ON x.term = t.term JOIN l ON l.topic = x.topic GROUP BY 1, 2),
b AS (SELECT doc_id, topic, s / sum(s) OVER (PARTITION BY doc_id) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, topic) AS k FROM s)"""


@query(f"WITH {_OUTLIERS} SELECT g.doc_id, coalesce(b.topic, g.topic) AS topic, round(b.share, 6) AS share FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND b.k = 1")
def outlier_reduction(spark, sf_dir):
    """Topics are languages; texts under 500 characters are the outliers that go to the topic of most like terms."""
    d = table(spark, sf_dir, "documents").withColumn("topic", F.when(F.col("n_chars") < 500, "-1").otherwise(F.col("lang")))
    out = O.reduce_outliers(d.select("doc_id", "topic"), O.doc_terms(d, "doc_id", "text", ["topic"]), "doc_id", "topic", "-1")
    return out.select("doc_id", "topic", F.round("share", 6).alias("share"))


_WINDOW_SHARES = f"""{_TERMS}, n AS (SELECT lang, term, sum(tf) AS n FROM t GROUP BY 1, 2), c AS (SELECT lang, sum(n) AS c FROM n GROUP BY 1), a AS (SELECT sum(c) / count(*) AS a FROM c), i AS (SELECT term, ln(1 + any_value(a.a) / sum(n)) AS idf FROM n CROSS JOIN a GROUP BY 1),
x AS (SELECT n.lang, n.term, n.n / c.c * idf AS w FROM n JOIN c ON c.lang = n.lang JOIN i ON i.term = n.term), l AS (SELECT lang, sqrt(sum(w * w)) AS l FROM x GROUP BY 1), tw AS (SELECT x.lang, x.term, w / l AS w FROM x JOIN l ON l.lang = x.lang),
ws AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z]+')) AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS s FROM ws WHERE len(ws) > 0), p AS (SELECT doc_id, s, unnest(ws[s:s + 3]) AS term FROM s), f AS (SELECT doc_id, s, term, count(*) AS tf FROM p GROUP BY 1, 2, 3),
v AS (SELECT f.doc_id, s, f.term, tf * idf AS v FROM f JOIN i ON i.term = f.term), nv AS (SELECT doc_id, s, sqrt(sum(v * v)) AS n FROM v GROUP BY 1, 2), d AS (SELECT doc_id, s, lang, sum(v * w) AS d FROM v JOIN tw ON tw.term = v.term GROUP BY 1, 2, 3),
cs AS (SELECT d.doc_id, d.lang, round(d / n, 9) AS c FROM d JOIN nv ON nv.doc_id = d.doc_id AND nv.s = d.s), g AS (SELECT doc_id, lang, sum(c) AS c FROM cs WHERE c >= 0.1 GROUP BY 1, 2)"""


@query(f"WITH {_WINDOW_SHARES} SELECT doc_id, lang, round(c / sum(c) OVER (PARTITION BY doc_id), 6) AS share FROM g")
def topic_shares_by_window(spark, sf_dir):
    """Topics are languages; each text's share of each, from windows of four words."""
    d = table(spark, sf_dir, "documents")
    # Every word counts, however few texts have it, so words are summed by language without counts for each text.
    words = d.select("lang", F.explode(T.tokens(F.col("text"))).alias("term"), F.lit(1).alias("tf"))
    weights = O.topic_weights(words, "lang")
    return O.window_shares(d, "doc_id", "text", weights, "lang").withColumn("share", F.round("share", 6))


_NEAR = r"""ws AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z]+')) AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
near AS (SELECT word, near, count(*) AS n FROM (SELECT a.w AS word, unnest([b.w, c.w, d.w]) AS near FROM p a LEFT JOIN p b ON b.doc_id = a.doc_id AND b.i = a.i + 1 LEFT JOIN p c ON c.doc_id = a.doc_id AND c.i = a.i + 2 LEFT JOIN p d ON d.doc_id = a.doc_id AND d.i = a.i + 3) WHERE near IS NOT NULL GROUP BY 1, 2),
both_ AS (SELECT word, near, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM near UNION ALL SELECT near, word, n FROM near) GROUP BY 1, 2)"""


def _near(spark, sf_dir):
    folder = shared_dir(spark, "near")
    meaning.near_counts(table(spark, sf_dir, "documents"), "text", window=3).write.parquet(folder)
    return spark.read.parquet(folder)


@query(f"WITH {_NEAR} SELECT * FROM both_")
def word_cooccurrence(spark, sf_dir):
    return _near(spark, sf_dir)


@query(f"""WITH {_NEAR}, m AS (SELECT word, sum(n) AS n FROM both_ GROUP BY 1), a AS (SELECT sum(n) AS n, sum(pow(n, 0.75)) AS s FROM m),
v AS (SELECT b.word, b.near, ln(b.n * a.s / (x.n * pow(y.n, 0.75))) AS m FROM both_ b JOIN m x ON x.word = b.word JOIN m y ON y.word = b.near CROSS JOIN a WHERE b.n >= 3) SELECT word, near, round(m, 6) AS m FROM v WHERE m > 0""")
def word_information(spark, sf_dir):
    return meaning.mutual_information(_near(spark, sf_dir), 3).withColumn("m", F.round("m", 6))


@query()
def meaning_vectors(spark, sf_dir):
    return meaning.embed(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT source, place, text FROM (SELECT source, text, CAST(row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '42'), doc_id, text) AS INTEGER) AS place FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) WHERE place <= 8")
def topic_examples(spark, sf_dir):
    return sample.examples(table(spark, sf_dir, "documents"), "source", "doc_id", "text", chars=None)


_WINDOWS = f"""{_TERMS}, b AS (SELECT doc_id, lang, term, tf, CAST(2000 + doc_id % 35 // 5 * 5 AS INTEGER) AS win FROM t), n AS (SELECT lang, win, term, sum(tf) AS n FROM b GROUP BY 1, 2, 3),
l AS (SELECT lang, win, list(term ORDER BY n DESC, term)[1:8] AS words FROM n GROUP BY 1, 2), p AS (SELECT *, lag(words) OVER (PARTITION BY lang ORDER BY win) AS before, lag(win) OVER (PARTITION BY lang ORDER BY win) AS since FROM l),
to_ AS (SELECT lang, since, win, round(1 - len(list_intersect(words, before)) / len(list_distinct(list_concat(words, before))), 6) AS turnover,
array_to_string(list_filter(words, lambda x: NOT list_contains(before, x)), ',') AS entered, array_to_string(list_filter(before, lambda x: NOT list_contains(words, x)), ',') AS dropped FROM p WHERE before IS NOT NULL)"""


def _turnover(spark, sf_dir):
    t = _terms(spark, sf_dir).withColumn("win", (2000 + F.floor(F.col("doc_id") % 35 / 5) * 5).cast("int"))
    n = t.groupBy("lang", "win", "term").agg(F.sum("tf").alias("w"))
    lists = O.word_lists(O.top_terms(n, ["lang", "win"], 8), ["lang", "win"]).withColumnRenamed("top_words", "words")
    return O.turnover(lists, "lang", "win")


@query(f"WITH {_WINDOWS} SELECT * FROM to_")
def lexical_turnover(spark, sf_dir):
    return _turnover(spark, sf_dir).select("lang", "since", "win", "turnover", "entered", "dropped")


@query(f"WITH {_WINDOWS} SELECT win, round(avg(turnover), 6) AS mean_turnover, round(stddev_pop(turnover), 6) AS spread FROM to_ GROUP BY win")
def field_mean_turnover(spark, sf_dir):
    return _turnover(spark, sf_dir).groupBy("win").agg(F.round(F.avg("turnover"), 6).alias("mean_turnover"), F.round(F.stddev_pop("turnover"), 6).alias("spread"))


@query("SELECT page_id, trim(string_split(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), ' | ')[1]) AS title FROM pages")
def html_title_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query()
def html_text_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(html.paragraphs(F.col("html")), "\n").alias("text"))


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def props_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("SELECT doc_id, nullif(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' '), '') AS rebuilt FROM documents")
def inverted_index_reconstruct(spark, sf_dir):
    """Every word of every text, by way of its inverted index, which is built within the row."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    indexed = table(spark, sf_dir, "documents").select("doc_id", T.inverted_index(words).alias("index"))
    return indexed.select("doc_id", T.inverted_index_text(F.col("index")).alias("rebuilt"))


@query("""WITH c AS (SELECT doc_id, x.i, CASE x.i WHEN 0 THEN lang WHEN 1 THEN source ELSE 'none' END AS name, CASE x.i WHEN 0 THEN (n_chars % 100) / 100 WHEN 1 THEN (n_chars % 7) / 7 END AS score FROM documents, (VALUES (0), (1), (2)) x(i))
SELECT doc_id, coalesce(string_agg(name, '; ' ORDER BY i) FILTER (coalesce(score, 0) >= 0.3), '') AS concepts FROM c GROUP BY doc_id""")
def concept_filter(spark, sf_dir):
    """Each document's language and source as concepts, scored by its length."""
    scored = (("lang", F.col("n_chars") % 100 / 100), ("source", F.col("n_chars") % 7 / 7))
    concepts = F.array(*(F.struct(F.col(n).alias("display_name"), s.cast("double").alias("score")) for n, s in scored), F.struct(F.lit("none").alias("display_name"), F.lit(None).cast("double").alias("score")))
    return table(spark, sf_dir, "documents").select("doc_id", T.joined(T.strong_concepts(concepts)).alias("concepts"))


@query("""SELECT c_custkey, trim(regexp_replace(c_name || ' ' || lpad(CAST(c_custkey % 9999 AS VARCHAR), 4, '0'), '\\s+\\d{3,}$', '')) AS author, lower(replace('https://doi.org/10.1/AB' || c_custkey, 'https://doi.org/', '')) AS doi,
CAST(floor((1970 + c_custkey % 60) / 5) * 5 AS INTEGER) AS bucket, CAST(CAST(floor((1970 + c_custkey % 60) / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS decade, CAST(CAST(floor((1970 + c_custkey % 60) / 10) * 10 AS INTEGER) - 10 AS VARCHAR) || 's' AS prev_decade, sha1(c_name || c_mktsegment)[1:16] AS cache_key FROM customer""")
def name_doi_bucket_functions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    year = 1970 + F.col("c_custkey") % 60
    numbered = F.concat("c_name", F.lit(" "), F.lpad((F.col("c_custkey") % 9999).cast("string"), 4, "0"))
    doi = F.concat(F.lit("https://doi.org/10.1/AB"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", T.clean_author(numbered).alias("author"), T.normalize_doi(doi).alias("doi"), T.bucket(year).alias("bucket"), T.decade(year).alias("decade"), T.previous_decade(T.decade(year)).alias("prev_decade"), T.cache_key(F.col("c_name"), F.col("c_mktsegment"), length=16).alias("cache_key"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws, list_transform(range(p_size % 7), lambda i: 'A' || i) AS names FROM part)
SELECT p_partkey, array_to_string(ws[1:3], ' · ') AS label, CASE WHEN len(names) > 4 THEN array_to_string(names[1:4], ', ') || ', et al.' ELSE coalesce(array_to_string(names, ', '), '') END AS authors, sha1(array_to_string(list_sort(ws), '|')) AS set_key FROM w""")
def label_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("ws", F.split("p_name", " "))
    p = p.withColumn("names", F.when(F.col("p_size") % 7 > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("p_size") % 7 - 1, F.lit(0))), lambda i: F.concat(F.lit("A"), i.cast("string")))).otherwise(F.array().cast("array<string>")))
    return p.select("p_partkey", T.short_label(F.col("ws")).alias("label"), T.author_line(F.col("names")).alias("authors"), T.set_cache_key(F.col("ws")).alias("set_key"))


@query()
def lemma_terms(spark, sf_dir):
    return O.vocabulary(O.doc_terms(table(spark, sf_dir, "documents"), "doc_id", "text", lemmatize=True), 3, 20_000)


@query()
def topic_labels(spark, sf_dir):
    lists = O.word_lists(_source_top(spark, sf_dir), ["source"])
    return lists.select("source", O.fallback_label(F.col("top_words")).alias("label"), T.clean_label(F.array_join("top_words", " ")).alias("clean"))


_PAGE = r"""w AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g') AS html FROM pages),
s AS (SELECT page_id, regexp_extract(replace(replace(html, '<article>', '<section id="abstract"><h2>Abstract</h2>'), '</article>', '</section>'), '(?is)<section\b[^>]*\bid=["'']abstract["''][^>]*>(.*?)</section>', 1) AS t FROM w),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM s)"""


@query(f"WITH {_PAGE} SELECT page_id, nullif(trim(regexp_replace(trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '(?i)^abstract', '')), '') AS abstract FROM u")
def page_abstract_extract(spark, sf_dir):
    """The whole article of each page, marked as its abstract."""
    page = F.replace(F.replace("html", F.lit("<article>"), F.lit('<section id="abstract"><h2>Abstract</h2>')), F.lit("</article>"), F.lit("</section>"))
    return table(spark, sf_dir, "pages").select("page_id", html.abstract(page).alias("abstract"))
