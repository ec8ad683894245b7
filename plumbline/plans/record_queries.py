"""Queries over records, links, marks and colours, and over the order of rows in files."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import clean as C
from plumbline.operators import match as M
from plumbline.operators import review as R
from plumbline.plans.registry import query, table
from plumbline.sources import answers, io, responses
from plumbline.storage import shared_dir

#: White space as Unicode has it, for SQL.
_SPACE = r"[\s\x0B\x{85}\p{Z}]+"


@query(f"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_SPACE}', ' ', 'g'))) AS plain_md5,
md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html_md5, md5(replace(html, '</', '<\\/')) AS script_md5 FROM pages""")
def markup_functions(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_markup(h)).alias("plain_md5"), F.md5(T.escape_html(h)).alias("html_md5"), F.md5(T.escape_script(h)).alias("script_md5"))


@query("""WITH l AS (SELECT page_id, url, ['', url, 'https://doi.org/10.' || url, 'http://DX.doi.org/Last'] AS links FROM pages)
SELECT page_id, lower(regexp_extract(list_filter(links, lambda x: regexp_matches(x, 'doi\\.org/(.+)$'))[1], 'doi\\.org/(.+)$', 1)) AS doi, list_filter(links, lambda x: x <> '')[1] AS first,
nullif(lower(trim(regexp_extract(url || '/doi/' || upper(url) || '?x=1', '/doi/([^?]*)', 1), '/')), '') AS of_url FROM l""")
def link_functions(spark, sf_dir):
    u = F.col("url")
    links = F.array(F.lit(""), u, F.concat(F.lit("https://doi.org/10."), u), F.lit("http://DX.doi.org/Last"))
    deep = F.concat(u, F.lit("/doi/"), F.upper(u), F.lit("?x=1"))
    return table(spark, sf_dir, "pages").select("page_id", T.doi_of_links(links).alias("doi"), T.first_link(links).alias("first"), T.doi_of_url(deep).alias("of_url"))


@query("""WITH c AS (SELECT event_id, value, '#' || substr(md5(CAST(user_id AS VARCHAR)), 1, 6) AS color FROM events), p AS (SELECT *, CAST('0x' || substr(color, 2, 2) AS INTEGER) AS r, CAST('0x' || substr(color, 4, 2) AS INTEGER) AS g, CAST('0x' || substr(color, 6, 2) AS INTEGER) AS b FROM c)
SELECT event_id, CASE WHEN r * 0.299 + g * 0.587 + b * 0.114 > 140 THEN '#1a1a1a' ELSE '#ffffff' END AS ink, 'rgba(' || r || ',' || g || ',' || b || ',0.35)' AS ribbon FROM p""")
def color_functions(spark, sf_dir):
    color = F.concat(F.lit("#"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 6))
    return table(spark, sf_dir, "events").select("event_id", T.text_color(color).alias("ink"), T.rgba(color, 0.35).alias("ribbon"))


_PAPERS = """p AS (SELECT 'conf/' || lower(replace(p_brand, '#', '')) AS conf, 'conf/' || p_partkey AS dblp_key, CASE WHEN p_partkey % 11 = 0 THEN 'Message from the ' || p_name WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS title, CAST(1990 + p_size % 30 AS INTEGER) AS year,
CASE WHEN p_size % 3 > 0 THEN '10.1145/' || p_partkey END AS doi, string_split(p_name, ' ') AS authors, CASE WHEN p_size % 4 = 0 THEN 'BRAND1 (Companion)' WHEN p_size % 4 = 1 THEN 'BRAND1' WHEN p_size % 4 = 2 THEN 'BRAND1 (' || p_type || ')' ELSE p_type END AS booktitle FROM part)"""


def _papers(spark, sf_dir):
    """Parts as papers: brands are venues, names titles."""
    name, size, key = F.col("p_name"), F.col("p_size"), F.col("p_partkey").cast("string")
    title = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("Message from the "), name)).when(F.col("p_partkey") % 5 == 0, F.substring_index(name, " ", 1)).otherwise(name)
    book = F.when(size % 4 == 0, "BRAND1 (Companion)").when(size % 4 == 1, "BRAND1").when(size % 4 == 2, F.concat(F.lit("BRAND1 ("), F.col("p_type"), F.lit(")"))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("conf/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("conf"), F.concat(F.lit("conf/"), key).alias("dblp_key"), title.alias("title"), (1990 + size % 30).cast("int").alias("year"), F.when(size % 3 > 0, F.concat(F.lit("10.1145/"), key)).alias("doi"), F.split(name, " ").alias("authors"), book.alias("booktitle"))


@query(f"""WITH {_PAPERS}, m AS (SELECT * FROM p WHERE conf = 'conf/brand1' AND title IS NOT NULL AND trim(booktitle) <> '' AND (upper(trim(booktitle)) = 'BRAND1' OR ((starts_with(upper(trim(booktitle)), 'BRAND1 ') OR starts_with(upper(trim(booktitle)), 'BRAND1-') OR starts_with(upper(trim(booktitle)), 'BRAND1(')) AND NOT contains(lower(booktitle), 'companion') AND NOT contains(lower(booktitle), 'workshop')))),
f AS (SELECT * FROM m WHERE NOT starts_with(lower(title), 'message from')), d AS (SELECT *, row_number() OVER (PARTITION BY title, year ORDER BY doi IS NULL, len(authors) DESC, dblp_key) AS k FROM f)
SELECT dblp_key, title, year, doi, doi IS NOT NULL AS has_doi, 'BRAND1' AS venue FROM d WHERE k = 1""")
def venue_papers(spark, sf_dir):
    """One venue's main track, without front matter and duplicates."""
    return C.venue_slice(_papers(spark, sf_dir), "conf/brand1", "brand1").select("dblp_key", "title", "year", "doi", "has_doi", "venue")


@query(f"""WITH {_PAPERS}, d AS (SELECT *, row_number() OVER (PARTITION BY title, year ORDER BY doi IS NULL, len(authors) DESC, dblp_key) AS k FROM p WHERE title IS NOT NULL AND year IS NOT NULL)
SELECT d.dblp_key, o.n, coalesce(o.n, 0) > 0 AS used FROM d LEFT JOIN (SELECT 'conf/' || l_partkey AS dblp_key, count(*) AS n FROM lineitem GROUP BY 1) o ON o.dblp_key = d.dblp_key WHERE k = 1""")
def distinct_papers_joined(spark, sf_dir):
    """Papers without duplicates, joined with how often they are ordered."""
    orders = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("conf/"), F.col("l_partkey").cast("string")).alias("dblp_key")).agg(F.count(F.lit(1)).alias("n"))
    papers = C.deduplicate(_papers(spark, sf_dir).na.drop(subset=["title", "year"]))
    return papers.join(orders, "dblp_key", "left").select("dblp_key", "n", (F.coalesce("n", F.lit(0)) > 0).alias("used"))


@query(f"""WITH {_PAPERS} SELECT dblp_key, CASE WHEN title = t THEN 'strict' WHEN t = '' THEN 'missing' ELSE 'mismatch' END AS match_kind FROM (SELECT dblp_key, trim(lower(title)) AS title, CASE WHEN year % 3 = 0 THEN '' WHEN year % 3 = 1 THEN trim(lower(title)) ELSE booktitle || ' other' END AS t FROM p)""")
def verified_titles(spark, sf_dir):
    p = _papers(spark, sf_dir)
    seen = F.when(F.col("year") % 3 == 0, "").when(F.col("year") % 3 == 1, F.upper("title")).otherwise(F.concat("booktitle", F.lit(" other")))
    return M.verified_title(p.withColumn("page", seen), "title", "page").select("dblp_key", "match_kind")


@query("""WITH s AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY file_row_number) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY file_row_number DESC) AS b FROM (SELECT *, row_number() OVER () AS file_row_number FROM orders))
SELECT o_custkey, max(o_orderkey) FILTER (a = 1) AS first_order, max(o_orderkey) FILTER (b = 1) AS last_order FROM s GROUP BY 1""")
def first_and_last_in_file(spark, sf_dir):
    """Of each customer the first and the last order as they stand in the files."""
    placed = io.in_file_order(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "_metadata"))
    return placed.groupBy("o_custkey").agg(F.min_by("o_orderkey", "_place").alias("first_order"), F.max_by("o_orderkey", "_place").alias("last_order"))


@query("""WITH a AS (SELECT doc_id, quality AS rating FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS rating FROM labels WHERE doc_id % 4 > 0)
SELECT count(*) AS n, round(avg(CAST(a.rating = b.rating AS INT)), 6) AS agreement, CAST(count(*) FILTER (a.rating <> b.rating) AS BIGINT) AS differ FROM a JOIN b ON a.doc_id = b.doc_id WHERE a.rating IS NOT NULL AND b.rating IS NOT NULL""")
def two_raters(spark, sf_dir):
    """Two raters' tables of their own, joined by item; the second left out a quarter and turned a ninth."""
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("rating"))
    b = a.filter("doc_id % 4 > 0").withColumn("rating", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("rating")).otherwise(F.col("rating")))
    both = R.raters(a, b, "doc_id")
    return R.agreement(both, "rating_a", "rating_b").select("n", "agreement").crossJoin(F.broadcast(both.agg(F.count_if(F.col("rating_a") != F.col("rating_b")).alias("differ"))))


@query("""WITH t AS (SELECT doc_id, lang, source, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN (SELECT doc_id AS i, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.i = d.doc_id),
k AS (SELECT sha1(source || '|' || lang) AS cache_key, count(*) AS n, max(lang || ' in ' || source) AS value FROM t GROUP BY source, lang) SELECT cache_key, n, value FROM k""")
def generation_cache(spark, sf_dir):
    """A label for each source and language is made once, kept under its key and read again."""
    rows = table(spark, sf_dir, "documents").withColumn("cache_key", T.cache_key(F.col("source"), F.lit("|"), F.col("lang")))
    wanted = rows.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"), F.first("lang").alias("lang"))
    folder = shared_dir(spark, "generated")
    make = lambda df: df.select("cache_key", F.concat("lang", F.lit(" in "), "source").alias("value"))
    for part in (wanted.filter("n % 2 = 0"), wanted, wanted):
        kept = responses.generated(part, folder, make)
    return kept.join(wanted.select("cache_key", "n"), "cache_key").select("cache_key", "n", "value")


@query("""SELECT url, status, CASE WHEN html IS NULL THEN 0 ELSE length(html) END AS chars FROM (SELECT url, CASE WHEN page_id % 10 = 3 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 10 = 3 THEN NULL ELSE html END AS html FROM (SELECT url, max(page_id) AS page_id, arg_max(html, page_id) AS html FROM pages WHERE url IS NOT NULL GROUP BY 1))""")
def page_states(spark, sf_dir):
    """All pages' urls as targets against a cache in which each tenth is a miss."""
    pages = table(spark, sf_dir, "pages").filter("url is not null")
    one = M.latest(pages, "url", [F.desc("page_id")])
    miss = F.col("page_id") % 10 == 3
    cache = one.select("url", F.when(miss, 404).otherwise(200).alias("status"), F.when(~miss, F.col("html")).alias("html"))
    found = responses.cached_pages(pages.select(F.col("url").alias("ee")).distinct(), cache.unionByName(cache.filter("status = 404")))
    return found.filter("state in ('found', 'missing')").select(F.col("ee").alias("url"), "status", F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("chars"))


@query("""SELECT url AS value, 200 AS status, 1 AS parts FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)""")
def answers_source(spark, sf_dir):
    """Every page's url asked for through the data source, in batches, by a service at hand; each is answered once."""
    folder = shared_dir(spark, "answers-source")
    urls = table(spark, sf_dir, "pages").select("url")
    answers.write_requests(responses.plan(urls, "url", most=50), folder, lanes=2)
    answers.register(spark, responses.stored([]), "plumbline_stored")
    got = spark.read.format("plumbline_stored").option("persecond", 1_000_000).load(folder)
    lists = responses.plan(urls, "url", most=50).select("cache_key", F.explode("values").alias("value"))
    return lists.join(got, "cache_key").groupBy("value").agg(F.max("status").cast("int").alias("status"), F.count(F.lit(1)).cast("int").alias("parts"))
