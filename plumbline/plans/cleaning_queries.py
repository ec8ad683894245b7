"""Queries of cleaning, matching, sampling and review, on the test tables.

Venues are document sources; booktitles, titles and DOIs are derived from the
tables by plain rules, the same in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import clean as C
from plumbline.operators import match as M
from plumbline.operators import review as R
from plumbline.operators import sample as S
from plumbline.plans.registry import query, table

# ---- papers made of documents

_PAPERS = """p AS (SELECT doc_id, 'conf/' || source || '/' || doc_id AS dblp_key, source AS conf, substr(text, 1, 40) AS title, CAST(2000 + doc_id % 7 AS INTEGER) AS year,
CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id END AS doi, CAST(doc_id % 5 AS INTEGER) AS n_authors, text FROM documents)"""


def _papers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("conf/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("dblp_key"),
        F.col("source").alias("conf"),
        F.substring("text", 1, 40).alias("title"),
        (2000 + F.col("doc_id") % 7).cast("int").alias("year"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).alias("doi"),
        F.slice(F.array(*map(F.lit, "abcde")), 1, (F.col("doc_id") % 5).cast("int")).alias("authors"),
        "text",
    )


@query(f"""WITH {_PAPERS}, r AS (SELECT *, row_number() OVER (PARTITION BY title, year ORDER BY (doi IS NOT NULL) DESC, n_authors DESC, dblp_key) AS k FROM p)
SELECT dblp_key, title, year, doi FROM r WHERE k = 1""")
def doc_dedup_exact(spark, sf_dir):
    return C.deduplicate(_papers(spark, sf_dir)).select("dblp_key", "title", "year", "doi")


@query("SELECT doc_id, source, md5(text) AS text_md5, count(*) OVER (PARTITION BY text) AS copies FROM documents QUALIFY copies > 1")
def doc_duplicates_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("text_md5"))
    return C.duplicates(d, ["text_md5"]).select("doc_id", "source", "text_md5", "copies")


_BOOKTITLE = "CASE p_partkey % 9 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' (1)' WHEN 2 THEN lower(p_type) || ' 2' WHEN 3 THEN p_type || '-SEIP' WHEN 4 THEN p_type || ' Companion' WHEN 5 THEN p_type || '-Workshops' WHEN 6 THEN p_type || 'W' WHEN 7 THEN 'AST@' || p_type ELSE ' ' END"


def _volumes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", F.expr(_BOOKTITLE).alias("booktitle"))


@query(f"""WITH v AS (SELECT p_partkey, p_type, {_BOOKTITLE} AS booktitle FROM part)
SELECT p_partkey, p_type, booktitle FROM v WHERE trim(booktitle) <> '' AND (upper(trim(booktitle)) = upper(p_type) OR
((starts_with(upper(trim(booktitle)), upper(p_type) || ' ') OR starts_with(upper(trim(booktitle)), upper(p_type) || '-') OR starts_with(upper(trim(booktitle)), upper(p_type) || '('))
AND NOT contains(lower(booktitle), 'companion') AND NOT contains(lower(booktitle), 'workshop')))""")
def main_track_filter(spark, sf_dir):
    return _volumes(spark, sf_dir).filter(C.main_track(F.col("booktitle"), F.col("p_type")))


@query(f"""WITH v AS (SELECT {_BOOKTITLE} AS booktitle FROM part WHERE p_partkey % 9 <> 8),
t AS (SELECT booktitle, count(*) AS n FROM v WHERE NOT regexp_matches(booktitle, '(?i)@|companion|workshop') GROUP BY 1 ORDER BY n DESC, booktitle LIMIT 1)
SELECT upper(trim(string_split(regexp_replace(booktitle, '\\s*\\(.*$', ''), '-')[1])) AS acronym FROM t""")
def acronym_mode(spark, sf_dir):
    return C.acronym(_volumes(spark, sf_dir).filter(F.col("p_partkey") % 9 != 8))


_FRONT_TITLE = "CASE doc_id % 8 WHEN 0 THEN 'Panel: ' WHEN 1 THEN '2nd International Workshop on ' WHEN 2 THEN 'A Workshop Approach ' WHEN 3 THEN 'Message from ' WHEN 4 THEN 'Workshop on ' ELSE '' END || substr(text, 1, 20) || CASE doc_id % 8 WHEN 5 THEN ' (Tutorial)' ELSE '' END"
_FRONT_DOI = "CASE WHEN doc_id % 8 = 6 THEN '10.1109/ICSE.2009.10234' WHEN doc_id % 8 = 7 THEN '10.1109/ICSE.2009.5070510' END"


@query("WITH t AS (SELECT doc_id, " + _FRONT_TITLE + " AS title, " + _FRONT_DOI + " AS doi FROM documents) SELECT doc_id, title FROM t WHERE NOT (coalesce(doi, '') SIMILAR TO '.*ICSE\\.[0-9]{4}\\.10[0-9]{3}' OR regexp_matches(title, '" + C.FRONT_MATTER.replace("'", "''") + "'))")
def front_matter_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_FRONT_TITLE).alias("title"), F.expr(_FRONT_DOI).alias("doi"))
    return C.drop_front_matter(rows, "icse").select("doc_id", "title")


_NORM = "trim(regexp_replace(lower(regexp_replace(regexp_replace({x}, '\\$[^$]*\\$', ' ', 'g'), '<[^>]+>', ' ', 'g')), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format(x='text')}) AS norm_md5, length({_NORM.format(x='text')}) AS n_norm FROM documents")
def normalize_text(spark, sf_dir):
    n = T.normalize(F.col("text"), compose=False)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("n_norm"))


@query()
def normalize_text_nfkc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("norm_md5"))


@query(f"WITH t AS (SELECT doc_id, substr(text, 1, 30) AS title, CASE WHEN doc_id % 4 > 0 THEN substr(text, 31) END AS abstract FROM documents) SELECT doc_id, length(coalesce(abstract, '')) > 0 AS has_abstract, trim({_NORM.format(x='title')} || ' ' || {_NORM.format(x=chr(99) + 'oalesce(abstract, ' + chr(39) * 2 + ')')}) AS text FROM t")
def text_fields(spark, sf_dir):
    """The first 30 characters as the title, all that follows as the abstract."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.substring("text", 1, 30).alias("title"), F.when(F.col("doc_id") % 4 > 0, F.expr("substring(text, 31)")).alias("abstract"))
    return C.text_fields(rows, compose=False).select("doc_id", "has_abstract", "text")


_LINK = "CASE doc_id % 5 WHEN 0 THEN 'https://x.org/' || doc_id ELSE NULL END AS ee, CASE doc_id % 5 WHEN 1 THEN '10.1/' || doc_id ELSE NULL END AS doi, CASE doc_id % 5 WHEN 2 THEN 'http://y.org/' || doc_id WHEN 3 THEN 'db/conf/' || doc_id ELSE NULL END AS url"


@query(f"WITH t AS (SELECT doc_id, {_LINK} FROM documents) SELECT doc_id, coalesce(ee, 'https://doi.org/' || doi, CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://dblp.org/' || url END, '') AS link FROM t")
def paper_links(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", _LINK.split(", CASE")[0], *("CASE" + x for x in _LINK.split(", CASE")[1:]))
    return rows.select("doc_id", C.paper_link(F.col("ee"), F.col("doi"), F.col("url"), "https://dblp.org/").alias("link"))


# ---- matching

_WORKS = """w AS (SELECT doc_id AS work_id, CAST(doc_id % 3 AS INTEGER) AS position, CASE doc_id % 4 WHEN 0 THEN 'On the ' ELSE '' END || substr(text, 1, 40) || CASE doc_id % 4 WHEN 1 THEN '!' ELSE '' END AS title, CAST(2000 + doc_id % 7 + CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS year FROM documents)"""
_KEY = "regexp_replace(trim(regexp_replace(regexp_replace({x}, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '^(?:on\\s+(?:a\\s+|an\\s+|the\\s+)?|a\\s+|an\\s+|the\\s+)+', '')"


def _works(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS work_id", "CAST(doc_id % 3 AS INT) AS position", "CASE doc_id % 4 WHEN 0 THEN 'On the ' ELSE '' END || substr(text, 1, 40) || CASE doc_id % 4 WHEN 1 THEN '!' ELSE '' END AS title", "CAST(2000 + doc_id % 7 + CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS INT) AS year"
    )


_MATCHED = f"""{_PAPERS}, {_WORKS}, pk AS (SELECT dblp_key, year, {_NORM.format(x='title')} AS n, {_KEY.format(x=_NORM.format(x='title'))} AS k FROM p),
wk AS (SELECT work_id, position, year, {_NORM.format(x='title')} AS n, {_KEY.format(x=_NORM.format(x='title'))} AS k FROM w),
h AS (SELECT dblp_key, work_id, position, (pk.n = wk.n AND pk.year = wk.year) AS strict FROM pk JOIN wk ON pk.k = wk.k AND abs(pk.year - wk.year) <= 1 WHERE pk.k <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY dblp_key ORDER BY strict DESC, position, work_id) AS r FROM h)"""


@query(f"WITH {_MATCHED} SELECT dblp_key, work_id, CASE WHEN strict THEN 'strict' ELSE 'loose' END AS kind FROM b WHERE r = 1")
def loose_title_match(spark, sf_dir):
    return M.match_titles(_papers(spark, sf_dir), _works(spark, sf_dir), "dblp_key", "work_id", compose=False)


@query(f"WITH {_MATCHED} SELECT dblp_key, work_id FROM b WHERE r = 1 AND strict")
def strict_title_match(spark, sf_dir):
    return M.match_titles(_papers(spark, sf_dir), _works(spark, sf_dir), "dblp_key", "work_id", compose=False, strict_only=True).select("dblp_key", "work_id")


@query(f"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS a, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS b FROM pages)
SELECT page_id, CASE WHEN b = '' THEN 'missing' WHEN {_NORM.format(x='a')} = {_NORM.format(x='b')} THEN 'strict' WHEN {_KEY.format(x=_NORM.format(x='a'))} = {_KEY.format(x=_NORM.format(x='b'))} THEN 'loose' ELSE 'mismatch' END AS match_kind FROM t""")
def verify_page_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("a"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("b"))
    return M.verified_title(p, "a", "b", compose=False).select("page_id", "match_kind")


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 20) ELSE '' END AS v FROM documents WHERE doc_id % 5 < 3), b AS (SELECT lang, min(substr(text, 1, 10)) AS v FROM documents GROUP BY 1)
SELECT d.doc_id, coalesce(nullif(a.v, ''), b.v) AS abstract FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b ON b.lang = d.lang""")
def abstract_fallback_coalesce(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.filter("doc_id % 5 < 3").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 20)).otherwise("").alias("abstract"))
    b = d.groupBy("lang").agg(F.min(F.substring("text", 1, 10)).alias("abstract"))
    return M.with_fallback(d.select("doc_id", "lang"), a, b, "doc_id", "lang").select("doc_id", "abstract")


@query("""WITH o AS (SELECT doc_id - doc_id % 2 AS doc_id, substr(text, 1, 12) AS v, doc_id AS ord FROM documents WHERE doc_id % 7 < 2), l AS (SELECT doc_id, arg_max(v, ord) AS v FROM o GROUP BY 1)
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.v ELSE substr(d.text, 1, 5) END AS abstract FROM documents d LEFT JOIN l USING (doc_id)""")
def override_apply(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    o = d.filter("doc_id % 7 < 2").select((F.col("doc_id") - F.col("doc_id") % 2).alias("doc_id"), F.substring("text", 1, 12).alias("abstract"), F.col("doc_id").alias("ord"))
    return M.apply_overrides(d.select("doc_id", F.substring("text", 1, 5).alias("abstract")), o, "doc_id", "abstract", F.col("ord"))


@query("""WITH n AS (SELECT doc_id, n_chars AS c, CASE WHEN doc_id % 4 = 0 THEN '10.9/' || doc_id END AS doi FROM documents WHERE doc_id % 2 = 0)
SELECT d.doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.c ELSE 7 END AS citation_count, CASE WHEN n.doi IS NOT NULL THEN n.doi WHEN d.doc_id % 3 = 0 THEN '10.1/' || d.doc_id END AS doi,
(n.doi IS NOT NULL OR d.doc_id % 3 = 0) AS has_doi FROM documents d LEFT JOIN n USING (doc_id)""")
def recovered_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.select("doc_id", F.lit(7).cast("long").alias("citation_count"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).alias("doi"))
    new = d.filter("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("citation_count"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("10.9/"), F.col("doc_id").cast("string"))).alias("doi"))
    return M.upsert(C.flag_doi(old), new, "doc_id", ["citation_count", "doi"]).select("doc_id", "citation_count", "doi", "has_doi")


@query("SELECT o_orderkey, CASE WHEN c_mktsegment IS NULL OR trim(c_mktsegment) = '' THEN 'Other' ELSE c_mktsegment END AS c_mktsegment FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey")
def label_lookup_default(spark, sf_dir):
    names = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return M.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", "c_mktsegment", "Other").select("o_orderkey", "c_mktsegment")


@query("""WITH u AS (SELECT DISTINCT doc_id FROM labels), k AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 10 > 0)
SELECT doc_id, 'unknown' AS problem FROM u WHERE doc_id NOT IN (SELECT doc_id FROM k) UNION ALL SELECT doc_id, 'unused' FROM k WHERE doc_id NOT IN (SELECT doc_id FROM u)""")
def label_referential_check(spark, sf_dir):
    return M.check_references(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").filter("doc_id % 10 > 0"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def review_anti_join(spark, sf_dir):
    return R.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, text FROM documents WHERE source IN ('src1', 'src3')")
def scope_slice(spark, sf_dir):
    return C.scope_filter(table(spark, sf_dir, "documents"), ["src1", "src3"], "source").select("doc_id", "text")


@query()
def doi_batches(spark, sf_dir):
    keys = table(spark, sf_dir, "pages").select("url")
    return M.batches(keys, "url", most=100, max_chars=4000)


# ---- corpus reports and samples

_RATES = """r AS (SELECT source AS conf, count(*) AS n_total, count(*) FILTER (d.doc_id % 3 = 0) AS n_doi, count(*) FILTER (d.doc_id % 3 <> 0) AS n_doi_less, count(l.doc_id) AS n_matched, count(*) FILTER (l.quality = 1) AS n_abstract,
CAST(min(2000 + d.doc_id % 7) AS INTEGER) AS year_first, CAST(max(2000 + d.doc_id % 7) AS INTEGER) AS year_last FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1),
rates AS (SELECT *, round(n_abstract / n_total, 4) AS abstract_hit_rate, round(n_doi / n_total, 4) AS doi_coverage FROM r)"""


def _rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("conf"), (2000 + F.col("doc_id") % 7).cast("int").alias("year"))
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    rows = d.join(l, "doc_id", "left")
    return R.hit_rate(rows, "conf", F.col("doc_id") % 3 == 0, F.coalesce("hit", F.lit(False)), F.coalesce(F.col("quality") == 1, F.lit(False)), "year")


@query(f"WITH {_RATES} SELECT * FROM rates")
def venue_hit_rate(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(f"WITH {_RATES} SELECT conf, n_total, n_abstract, abstract_hit_rate, CASE WHEN conf IN ('src2', 'src7') THEN 'forced' ELSE 'qualified' END AS reason FROM rates WHERE (n_total >= 20 AND abstract_hit_rate >= 0.3) OR conf IN ('src2', 'src7')")
def venue_qualify(spark, sf_dir):
    return R.qualifying(_rates(spark, sf_dir), "conf", ["src2", "src7"], 20, 0.3)


@query(f"""WITH {_RATES} SELECT * FROM (SELECT conf, n_total, abstract_hit_rate, 'top' AS part FROM rates WHERE n_total >= 20 ORDER BY abstract_hit_rate DESC, n_total DESC, conf LIMIT 5)
UNION ALL SELECT * FROM (SELECT conf, n_total, abstract_hit_rate, 'bottom' AS part FROM rates WHERE n_total >= 20 ORDER BY abstract_hit_rate, n_total DESC, conf LIMIT 5)""")
def hit_rate_report(spark, sf_dir):
    return R.ends(_rates(spark, sf_dir), "conf", 5, 20).select("conf", "n_total", "abstract_hit_rate", "part")


_PLAN = """c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT coalesce(sum(least(n, {cap})) FILTER (lang <> 'es'), 0) AS planned, coalesce(sum(n) FILTER (lang = 'es'), 0) AS taken FROM c),
k AS (SELECT lang, n, CAST(CASE WHEN lang = 'es' THEN n WHEN planned > greatest(0, {size} - taken) THEN least(greatest(round_even(least(n, {cap}) * (greatest(0, {size} - taken) / planned), 0), 1), n) ELSE least(n, {cap}) END AS BIGINT) AS k FROM c, t)""".format(cap=200, size=300)


@query(f"WITH {_PLAN} SELECT lang, n, k FROM k")
def sample_plan(spark, sf_dir):
    return S.stratum_plan(table(spark, sf_dir, "documents"), "lang", ["es"], 300, 200)


@query(f"WITH {_PLAN}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS r FROM documents) SELECT doc_id, r.lang, r <= k AS in_fit FROM r JOIN k ON k.lang = r.lang")
def stratified_sample_budget(spark, sf_dir):
    return S.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", ["es"], 300, 200).select("doc_id", "lang", "in_fit")


@query("SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR) || '42s') AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS r FROM documents) WHERE r <= 10")
def equal_alloc_sample(spark, sf_dir):
    return S.equal_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 200, 20)


@query("SELECT vec_id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || '42'), vec_id LIMIT 120")
def subsample_by_hash(spark, sf_dir):
    return S.first_by_hash(table(spark, sf_dir, "embeddings"), "vec_id", 120).select("vec_id")


# ---- raters

@query("""WITH a AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INT)) AS o, avg(quality) AS pa, avg(toxic) AS pb FROM labels)
SELECT n, round(o, 6) AS agreement, round((o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa,
round((o - 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2)) / (1 - 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2)), 6) AS ac1 FROM a""")
def annotator_agreement(spark, sf_dir):
    return R.agreement(table(spark, sf_dir, "labels"), "quality", "toxic")


_WILSON = "(k / n + {s}1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n)"


@query(f"""WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, n, k, round(k / n, 6) AS accuracy, round(greatest(0, {_WILSON.format(s='-')}), 6) AS low, round(least(1, {_WILSON.format(s='')}), 6) AS high FROM g""")
def wilson_by_theme(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return R.accuracy(rows, "lang", F.col("quality") == 1)


_LOG = "SELECT doc_id, lang AS \"group\", CASE doc_id % 3 WHEN 0 THEN 'y' WHEN 1 THEN 'n' ELSE 's' END AS correct, CASE doc_id % 9 WHEN 1 THEN 'g' WHEN 4 THEN 't' WHEN 7 THEN 'b' ELSE '' END AS error_type, CASE doc_id % 6 WHEN 0 THEN 'should be ' || lang || ': clear' WHEN 1 THEN 'Should be an EN thing or other' ELSE 'fine' END AS notes, CASE WHEN doc_id % 4 = 0 THEN 'hit' ELSE 'miss' END AS status, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id END AS matched_topic_id, CASE WHEN doc_id % 6 = 0 THEN 'n/a' ELSE CAST(doc_id % 11 - 5 AS {t}) END AS delta_years FROM documents"


def _log(spark, sf_dir):
    return spark.sql(_LOG.format(t="STRING").replace('"group"', "`group`").replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents"))


_LOG_SQL = _LOG.format(t="VARCHAR")


@query(f"""WITH l AS ({_LOG_SQL}) SELECT "group", count(*) FILTER (correct = 'y') AS "right", count(*) FILTER (correct = 'n') AS wrong, count(*) FILTER (correct = 's') AS skipped,
count(*) FILTER (correct = 'n' AND error_type = 'g') AS wrong_group, count(*) FILTER (correct = 'n' AND error_type = 't') AS wrong_topic, count(*) FILTER (correct = 'n' AND error_type = 'b') AS both FROM l GROUP BY ROLLUP ("group")""")
def review_summary(spark, sf_dir):
    return R.summary(_log(spark, sf_dir))


@query(f"""WITH l AS ({_LOG_SQL}), s AS (SELECT doc_id, lower(trim(regexp_extract(notes, '[Ss]hould be\\s+([^:;]+?)(?:\\s+or\\s+|\\s*[:;]|$)', 1))) AS s FROM l),
g AS (SELECT * FROM (VALUES ('DE', 1), ('EN', 2), ('ES', 3), ('FR', 4)) v(g, o))
SELECT doc_id, arg_min(g, o) AS suggestion FROM s JOIN g ON s <> '' AND (contains(s, lower(g)) OR contains(lower(g), s)) GROUP BY doc_id""")
def suggested_theme(spark, sf_dir):
    groups = spark.createDataFrame([("DE", 1), ("EN", 2), ("ES", 3), ("FR", 4)], "`group` string, `order` int")
    return R.suggested_group(_log(spark, sf_dir), groups, "doc_id")


@query(f"WITH l AS ({_LOG_SQL}) SELECT count(*) AS n, round(avg(CAST(status = 'hit' AS INT)), 6) AS hit_rate, count(*) FILTER (matched_topic_id IS NULL) AS unmatched, round(avg(abs(try_cast(delta_years AS DOUBLE))), 6) AS mean_abs_delta FROM l")
def milestone_summary(spark, sf_dir):
    return R.milestones(_log(spark, sf_dir))


@query("""WITH g AS (SELECT * FROM (VALUES ('en', 1, '#112233'), ('xx', 2, '#ffeedd'), ('de', 3, '#808080')) v("group", "order", color)), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
j AS (SELECT "group", "order", color, coalesce(n, 0) AS papers FROM g LEFT JOIN c ON lang = "group")
SELECT "group", "order", color, papers, round(papers / sum(papers) OVER (), 6) AS share FROM j""")
def theme_registry(spark, sf_dir):
    groups = spark.createDataFrame([("en", 1, "#112233"), ("xx", 2, "#ffeedd"), ("de", 3, "#808080")], "`group` string, `order` int, color string")
    papers = table(spark, sf_dir, "documents").select(F.col("lang").alias("group"))
    return R.registry(papers, groups).select("group", "order", "color", "papers", "share")


@query("SELECT event_id, value, round(row_number() OVER (ORDER BY value, event_id) / count(*) OVER (), 9) AS ecdf FROM events WHERE value IS NOT NULL")
def ecdf_value(spark, sf_dir):
    return R.ecdf(table(spark, sf_dir, "events"), "value", "event_id")


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role FROM conversations")
def conversation_turns_prev_role(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev_role"))


@query("SELECT p_partkey, p_name, CASE WHEN k = 1 THEN p_name ELSE p_name || ' (' || k || ')' END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def label_dedupe_numbering(spark, sf_dir):
    from plumbline.operators.terms import number_repeats

    return number_repeats(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("SELECT conf, substr(text, 1, 40) AS title, year, dblp_key FROM (SELECT source AS conf, text, CAST(2000 + doc_id % 7 AS INTEGER) AS year, 'conf/' || source || '/' || doc_id AS dblp_key FROM documents) WHERE starts_with(dblp_key, 'conf/src4/') AND year BETWEEN 2001 AND 2004")
def venue_prefix_slice(spark, sf_dir):
    return _papers(spark, sf_dir).filter(F.col("dblp_key").startswith("conf/src4/") & F.col("year").between(2001, 2004)).select("conf", "title", "year", "dblp_key")
