"""Queries over time: themes are order priorities or part types, topics brands, authors customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import temporal as O
from plumbline.plans.registry import query, table

_ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS theme, CAST(year(o_orderdate) AS INTEGER) AS y, o_totalprice FROM orders)"
_PARTS = "lp AS (SELECT p_type AS theme, p_brand AS topic, CAST(year(l_shipdate) AS INTEGER) AS y, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("theme"), F.year("o_orderdate").alias("y"), "o_totalprice")


def _parts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("theme"), F.col("p_brand").alias("topic"))
    return line.join(part, "l_partkey").select("theme", "topic", "y")


_RANKED = f"""{_ORDERS}, c AS (SELECT theme, y, count(*) AS papers FROM o GROUP BY theme, y),
g AS (SELECT t.theme, b.y, coalesce(c.papers, 0) AS papers FROM (SELECT DISTINCT theme FROM c) t CROSS JOIN (SELECT DISTINCT y FROM c) b
      LEFT JOIN c ON c.theme = t.theme AND c.y = b.y),
s AS (SELECT *, round(papers / sum(papers) OVER (PARTITION BY y), 6) AS share, sum(papers) OVER (PARTITION BY theme) AS size FROM g),
r AS (SELECT theme, y, papers, share, CAST(row_number() OVER (PARTITION BY y ORDER BY share DESC, size DESC, theme) AS INTEGER) AS rnk FROM s)"""


def _ranked(spark, sf_dir):
    return O.rank_per(O.shares(O.dense(O.counts(_orders(spark, sf_dir), "theme", "y"), "theme", "y"), "y"), "y", "theme")


@query(f"WITH {_RANKED} SELECT * FROM r")
def theme_share_rank_by_year(spark, sf_dir):
    return _ranked(spark, sf_dir).select("theme", "y", "papers", "share", "rnk")


@query(f"WITH {_RANKED} SELECT theme, arg_min(rnk, y) AS first_rank, arg_max(rnk, y) AS last_rank, arg_min(rnk, y) - arg_max(rnk, y) AS climb FROM r GROUP BY theme")
def theme_rank_movement(spark, sf_dir):
    return O.rank_movement(_ranked(spark, sf_dir), "y", "theme")


@query(f"""WITH {_PARTS} SELECT theme, CAST(floor(y / 5) * 5 AS INTEGER) AS bucket, count(*) AS papers,
round(count(*) / sum(count(*)) OVER (PARTITION BY CAST(floor(y / 5) * 5 AS INTEGER)), 6) AS share FROM lp GROUP BY 1, 2""")
def theme_share_streamgraph(spark, sf_dir):
    rows = _parts(spark, sf_dir).withColumn("bucket", T.bucket(F.col("y")))
    return O.shares(O.dense(O.counts(rows, "theme", "bucket"), "theme", "bucket"), "bucket").select("theme", "bucket", "papers", "share")


@query(f"""WITH {_PARTS} SELECT theme, topic, y, count(*) AS papers, round(count(*) / sum(count(*)) OVER (PARTITION BY theme, y), 4) AS share FROM lp GROUP BY 1, 2, 3""")
def subtopic_share_of_theme(spark, sf_dir):
    return O.shares(O.counts(_parts(spark, sf_dir), "theme", "topic", "y"), "theme", "y", digits=4).select("theme", "topic", "y", "papers", "share")


@query(f"""WITH {_PARTS}, d AS (SELECT *, CAST(CAST(floor(y / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS decade FROM lp)
SELECT decade, theme, topic, count(*) AS papers, CAST((decade IS NOT NULL)::INT + (theme IS NOT NULL)::INT + (topic IS NOT NULL)::INT AS INTEGER) AS level
FROM d GROUP BY ROLLUP (decade, theme, topic)""")
def treemap_rollup(spark, sf_dir):
    return O.rollup(_parts(spark, sf_dir).withColumn("decade", T.decade(F.col("y"))), "decade", "theme", "topic").select("decade", "theme", "topic", "papers", "level")


_GROWTH = """s AS (SELECT *, round(papers / sum(papers) OVER (PARTITION BY p), 12) AS share FROM c),
b AS (SELECT s.*, e.share AS prev, EXISTS (SELECT 1 FROM c h WHERE h.p = s.p - {step}) AS had FROM s LEFT JOIN s e ON e.topic = s.topic AND e.p = s.p - {step})
SELECT topic, p, papers, round(share, 6) AS share,
CASE WHEN NOT had THEN 'na' WHEN coalesce(prev, 0) <= 0 THEN 'new' WHEN (share / prev - 1) * 100 > 5 THEN 'up' WHEN (share / prev - 1) * 100 < -5 THEN 'down' ELSE 'flat' END AS state,
CASE WHEN prev > 0 THEN round((share / prev - 1) * 100, 4) END AS growth_pct, CASE WHEN prev > 0 THEN round(log2(share / prev), 6) END AS l2fc FROM b"""


@query(f"WITH {_PARTS}, c AS (SELECT topic, CAST(floor(y / 10) * 10 AS INTEGER) AS p, count(*) AS papers FROM lp GROUP BY 1, 2), " + _GROWTH.format(step=10))
def treemap_growth(spark, sf_dir):
    rows = _parts(spark, sf_dir).withColumn("p", T.bucket(F.col("y"), 10))
    return O.growth(O.counts(rows, "topic", "p"), "topic", "p", 10).select("topic", "p", "papers", "share", "state", "growth_pct", "l2fc")


@query("WITH c AS (SELECT o_custkey AS topic, CAST(year(o_orderdate) AS INTEGER) AS p, count(*) AS papers FROM orders GROUP BY 1, 2), " + _GROWTH.format(step=1))
def author_growth_by_year(spark, sf_dir):
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("topic"), F.col("y").alias("p"))
    return O.growth(O.counts(rows, "topic", "p"), "topic", "p", 1).select("topic", "p", "papers", "share", "state", "growth_pct", "l2fc")


@query("""WITH h AS (SELECT DISTINCT o_custkey AS topic, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), p AS (SELECT DISTINCT y FROM h)
SELECT h.y, h.topic, 'emerging' AS change FROM h WHERE h.y - 1 IN (SELECT y FROM p) AND NOT EXISTS (SELECT 1 FROM h e WHERE e.topic = h.topic AND e.y = h.y - 1)
UNION ALL
SELECT CAST(h.y + 1 AS INTEGER), h.topic, 'faded' FROM h WHERE h.y + 1 IN (SELECT y FROM p) AND NOT EXISTS (SELECT 1 FROM h e WHERE e.topic = h.topic AND e.y = h.y + 1)""")
def emerging_faded_topics(spark, sf_dir):
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("topic"), "y")
    return O.came_and_went(O.counts(rows, "topic", "y"), "topic", "y", 1).select("y", "topic", "change")


@query(f"""WITH {_PARTS}, d AS (SELECT *, CAST(CAST(floor(y / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS decade FROM lp)
SELECT decade, theme, count(*) AS n_papers, count(DISTINCT topic) AS n_topics, round(count(*) / sum(count(*)) OVER (PARTITION BY decade) * 100, 1) AS pct_decade FROM d GROUP BY 1, 2""")
def theme_meta(spark, sf_dir):
    rows = _parts(spark, sf_dir).withColumn("decade", T.decade(F.col("y")))
    by = rows.groupBy("decade", "theme").agg(F.count(F.lit(1)).alias("n_papers"), F.countDistinct("topic").alias("n_topics"))
    return O.shares(by, "decade", value="n_papers", digits=12).withColumn("pct_decade", F.round(F.col("share") * 100, 1)).drop("share")


@query(f"""WITH {_ORDERS} SELECT theme, o_orderkey, o_totalprice, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY theme ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM o) WHERE place <= 3""")
def top_papers_per_topic(spark, sf_dir):
    return O.top_n(_orders(spark, sf_dir), ["theme"], 3, F.desc("o_totalprice"), "o_orderkey").select("theme", "o_orderkey", "o_totalprice", "place")


@query(f"""WITH {_ORDERS}, d AS (SELECT *, CAST(CAST(floor(y / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS decade FROM o)
SELECT decade, theme, o_orderkey, y, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY decade, theme ORDER BY y DESC, o_orderkey) AS INTEGER) AS place FROM d) WHERE place <= 200""")
def recent_n_per_topic(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("decade", T.decade(F.col("y")))
    return O.top_n(rows, ["decade", "theme"], 200, F.desc("y"), "o_orderkey").select("decade", "theme", "o_orderkey", "y", "place")


@query(f"""WITH {_ORDERS}, d AS (SELECT *, CAST(CAST(floor(y / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS decade FROM o)
SELECT decade, theme, count(*) AS n, min(y) AS first_year, max(y) AS last_year, greatest(count(*) - 200, 0) AS more FROM d GROUP BY 1, 2""")
def tile_stats(spark, sf_dir):
    return O.more_than(_orders(spark, sf_dir).withColumn("decade", T.decade(F.col("y"))), ["decade", "theme"], 200, "y")


@query(f"""WITH {_RANKED} SELECT theme, y AS peak, share AS peak_share FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY share DESC, y) AS n FROM r) WHERE n = 1""")
def theme_peak_bucket(spark, sf_dir):
    return O.peak(_ranked(spark, sf_dir), "theme", "y")


_RISE = """d AS (SELECT *, share - lag(share) OVER (PARTITION BY theme ORDER BY y) AS rise, lag(share) OVER (PARTITION BY theme ORDER BY y) AS prev FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY round(rise, 9) DESC, y) AS n FROM d WHERE rise IS NOT NULL)"""


@query(f"""WITH {_ORDERS}, c AS (SELECT theme, y, count(*) AS papers FROM o GROUP BY 1, 2),
s AS (SELECT * FROM (SELECT *, round(papers / sum(papers) OVER (PARTITION BY y), 9) AS share FROM c) WHERE y >= 1996), {_RISE}
SELECT n.theme, n.y AS period, round(n.rise, 6) AS rise, n.share AS after, s.share AS before FROM n LEFT JOIN s ON s.theme = n.theme AND s.y = n.y - 2 WHERE n.n = 1""")
def theme_onset(spark, sf_dir):
    return O.onset(O.counts(_orders(spark, sf_dir), "theme", "y"), "theme", "y", from_year=1996, step=2).select("theme", "period", "rise", "after", "before")


@query(f"""WITH {_ORDERS}, c AS (SELECT theme, y, count(*) AS papers FROM o GROUP BY 1, 2), big AS (SELECT y FROM c GROUP BY y HAVING sum(papers) >= 2000),
s AS (SELECT *, round(papers / sum(papers) OVER (PARTITION BY y), 9) AS share FROM c WHERE y IN (SELECT y FROM big)), {_RISE}
SELECT theme, y AS period, round(rise, 6) AS rise, prev AS before, share AS after FROM n WHERE n = 1""")
def theme_inflection(spark, sf_dir):
    return O.inflection(O.counts(_orders(spark, sf_dir), "theme", "y"), "theme", "y", least=2000).select("theme", "period", "rise", "before", "after")


@query(f"""WITH {_RANKED} SELECT theme, y, share, round(coalesce(sum(share) OVER (PARTITION BY y ORDER BY theme ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS base FROM r""")
def theme_stack_baseline(spark, sf_dir):
    return O.stack(_ranked(spark, sf_dir), "y", "theme").select("theme", "y", "share", "base")


@query(f"""WITH {_ORDERS} SELECT theme, {', '.join(f'count(*) FILTER (y = {y}) AS y{y}' for y in range(1995, 2002))} FROM o GROUP BY theme""")
def theme_period_pivot(spark, sf_dir):
    years = list(range(1995, 2002))
    wide = _orders(spark, sf_dir).groupBy("theme").pivot("y", years).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select("theme", *(F.col(str(y)).alias(f"y{y}") for y in years))


_MAIN = f"""{_ORDERS}, n AS (SELECT o_custkey, y, theme, count(*) AS n FROM o GROUP BY 1, 2, 3),
m AS (SELECT o_custkey, y, theme, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY n DESC, theme) AS k FROM n) WHERE k = 1)"""


def _main(spark, sf_dir):
    return O.dominant(_orders(spark, sf_dir), "o_custkey", "y", "theme")


@query(f"WITH {_MAIN} SELECT * FROM m")
def researcher_dominant_topic(spark, sf_dir):
    return _main(spark, sf_dir)


_FLOWS = f"{_MAIN}, f AS (SELECT a.y, a.theme AS src, b.theme AS tgt, count(*) AS people FROM m a JOIN m b ON b.o_custkey = a.o_custkey AND b.y = a.y + 1 GROUP BY 1, 2, 3 HAVING count(*) >= 2)"


@query(f"WITH {_FLOWS} SELECT * FROM f")
def researcher_migration(spark, sf_dir):
    return O.migration(_main(spark, sf_dir), "o_custkey", "y", "theme", step=1)


@query(f"""WITH {_FLOWS}, a AS (SELECT y, src AS topic, coalesce(sum(people) FILTER (src <> tgt), 0) AS outflow, coalesce(sum(people) FILTER (src = tgt), 0) AS stayed FROM f GROUP BY 1, 2),
b AS (SELECT y, tgt AS topic, coalesce(sum(people) FILTER (src <> tgt), 0) AS inflow, sum(people) AS i FROM f GROUP BY 1, 2),
j AS (SELECT coalesce(a.y, b.y) AS y, coalesce(a.topic, b.topic) AS topic, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, coalesce(stayed, 0) AS stayed, coalesce(i, 0) AS i FROM a FULL JOIN b ON a.y = b.y AND a.topic = b.topic)
SELECT y, topic, CAST(inflow AS BIGINT) AS inflow, CAST(outflow AS BIGINT) AS outflow, CAST(stayed AS BIGINT) AS stayed, CAST(inflow - outflow AS BIGINT) AS net, CAST(greatest(outflow + stayed, i) AS BIGINT) AS node,
CASE WHEN outflow + stayed >= 5 THEN round(stayed / (outflow + stayed), 6) END AS loyalty FROM j""")
def migration_net_flow(spark, sf_dir):
    return O.net_flow(O.migration(_main(spark, sf_dir), "o_custkey", "y", "theme", step=1), "y")


@query(f"""WITH {_PARTS}, a AS (SELECT topic, count(*) AS papers, median(y) AS median_year FROM lp GROUP BY 1), t AS (SELECT * FROM a ORDER BY papers DESC, topic LIMIT 10)
SELECT topic, papers, CAST(median_year AS DOUBLE) AS median_year FROM t""")
def median_year_per_topic(spark, sf_dir):
    by = _parts(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("papers"), F.median("y").alias("median_year"))
    return by.orderBy(F.desc("papers"), "topic").limit(10).orderBy("median_year", "topic")


@query("""WITH c AS (SELECT p_brand AS brand, p_size AS cites FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY cites DESC) AS k FROM c)
SELECT brand, count(*) AS n, round(CAST(median(cites) AS DOUBLE), 6) AS median_cites, round(avg(cites), 6) AS mean_cites, CAST(sum(cites) AS BIGINT) AS total_cites, round(avg(CAST(cites = 0 AS INT)), 6) AS uncited, max(least(k, cites)) AS h_index FROM r GROUP BY brand""")
def citation_panel(spark, sf_dir):
    return O.citation_panel(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("cites")), ["brand"], "cites")


@query("""WITH r AS (SELECT CAST(floor(year(l_shipdate) / 5) * 5 AS INTEGER) AS bucket, p_type AS theme, p_brand AS topic, CAST(l_quantity AS INTEGER) AS c, 'S' || (l_suppkey % 37) AS a FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT CASE grouping(bucket, theme, topic) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level, bucket, theme, topic, c, count(*) AS n FROM r GROUP BY GROUPING SETS ((c), (bucket, c), (bucket, theme, c), (bucket, theme, topic, c))),
m AS (SELECT *, sum(n) OVER (PARTITION BY level, bucket, theme, topic ORDER BY c DESC) AS above FROM g), h AS (SELECT level, bucket, theme, topic, max(least(above, c)) AS h_index FROM m GROUP BY 1, 2, 3, 4),
s AS (SELECT CASE grouping(bucket, theme, topic) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level, bucket, theme, topic, count(*) AS n, median(c) AS med, avg(c) AS mean, sum(c) AS total FROM r GROUP BY GROUPING SETS ((), (bucket), (bucket, theme), (bucket, theme, topic))),
an AS (SELECT CASE grouping(bucket, theme, topic) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level, bucket, theme, topic, a, count(*) AS n FROM r GROUP BY GROUPING SETS ((a), (bucket, a), (bucket, theme, a), (bucket, theme, topic, a))),
ak AS (SELECT *, row_number() OVER (PARTITION BY level, bucket, theme, topic ORDER BY n DESC, a) AS k FROM an), t AS (SELECT level, bucket, theme, topic, string_agg(a, ',' ORDER BY k) AS top FROM ak WHERE k <= 3 GROUP BY 1, 2, 3, 4)
SELECT CAST(s.level AS INTEGER) AS level, s.bucket, s.theme, s.topic, s.n, round(CAST(med AS DOUBLE), 6) AS median_cites, round(mean, 6) AS mean_cites, CAST(total AS BIGINT) AS total_cites, CAST(h_index AS BIGINT) AS h_index, top
FROM s JOIN h ON s.level = h.level AND s.bucket IS NOT DISTINCT FROM h.bucket AND s.theme IS NOT DISTINCT FROM h.theme AND s.topic IS NOT DISTINCT FROM h.topic
JOIN t ON s.level = t.level AND s.bucket IS NOT DISTINCT FROM t.bucket AND s.theme IS NOT DISTINCT FROM t.theme AND s.topic IS NOT DISTINCT FROM t.topic""")
def impact_panel(spark, sf_dir):
    """Quantities stand for citations, suppliers for authors; periods of five years, types, brands."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", T.bucket(F.year("l_shipdate")).alias("bucket"), F.col("l_quantity").cast("int").alias("cites"), F.array(F.concat(F.lit("S"), (F.col("l_suppkey") % 37).cast("string"))).alias("authors"))
    rows = line.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("theme"), F.col("p_brand").alias("topic")), "l_partkey")
    out = O.impact_panel(rows, ["bucket", "theme", "topic"], "cites", "authors", 3)
    return out.drop("uncited").withColumn("top", F.array_join("top_authors", ",")).drop("top_authors")


@query("""SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM s GROUP BY 1, 2""")
def events_sessions(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("_p", F.lag("ts").over(order))
    near = F.col("ts") - F.col("_p") <= F.expr("INTERVAL 30 MINUTES")
    e = e.withColumn("_f", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("session", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), *(F.date_format(f("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(n) for f, n in ((F.min, "first_ts"), (F.max, "last_ts"))))


@query(f"""WITH {_ORDERS}, c AS (SELECT theme, count(*) AS n FROM o GROUP BY 1) SELECT theme, n, CAST(row_number() OVER (ORDER BY n DESC, theme) - 1 AS INTEGER) AS topic_id FROM c""")
def theme_numbering(spark, sf_dir):
    return O.number_by_size(O.counts(_orders(spark, sf_dir), "theme", name="n"), "theme", "n")


@query(f"""WITH {_RANKED}, z AS (SELECT theme, y, share, row_number() OVER (PARTITION BY theme ORDER BY share DESC, y) AS n FROM r)
SELECT theme, string_agg(y || ':' || CAST(round(share * 1000000) AS BIGINT), ',' ORDER BY y) AS series, max(y) FILTER (n = 1) AS peak FROM z GROUP BY theme""")
def drift_series(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    point = F.concat_ws(":", F.col("y").cast("string"), F.round(F.col("share") * 1000000).cast("long").cast("string"))
    series = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", point.alias("p")))), lambda s: s["p"]), ",")
    return r.groupBy("theme").agg(series.alias("series")).join(O.peak(r, "theme", "y").select("theme", "peak"), "theme")


@query(f"WITH {_RANKED} SELECT CAST(to_json(list({{'theme': theme, 'y': y, 'papers': papers, 'share': share}} ORDER BY theme, y)) AS VARCHAR) AS payload FROM r")
def streamgraph_payload(spark, sf_dir):
    from plumbline.sources.io import payload

    return payload(_ranked(spark, sf_dir).select("theme", "y", "papers", "share"), ["theme", "y"])


@query(f"""WITH {_PARTS}, n AS (SELECT y, count(*) AS n, count(*) FILTER (theme = 'PROMO') AS a, count(*) FILTER (topic IN ('Brand#1', 'Brand#7', 'Brand#20')) AS b FROM lp GROUP BY 1),
c AS (SELECT 'promo' AS theme, y, round(a / n, 9) AS share FROM n UNION ALL SELECT 'brands', y, round(b / n, 9) FROM n), s AS (SELECT * FROM c WHERE y >= 1996), {_RISE}
SELECT n.theme AS name, n.y AS period, round(n.rise, 6) AS rise, n.share AS after, s.share AS before FROM n_ n LEFT JOIN s ON s.theme = n.theme AND s.y = n.y - 1 WHERE n.n = 1""".replace("\nn AS (SELECT *, row_number()", "\nn_ AS (SELECT *, row_number()"))
def milestone_onsets(spark, sf_dir):
    named = {"promo": F.col("theme") == "PROMO", "brands": F.col("topic").isin("Brand#1", "Brand#7", "Brand#20")}
    return O.milestones(_parts(spark, sf_dir), "y", named, 1996, 1).select("name", "period", "rise", "after", "before")


@query("SELECT DISTINCT event_id, user_id, event_type, value FROM events")
def events_stream_distinct(spark, sf_dir):
    """The events read as a stream, without repeats, written by a run over all files at hand."""
    from plumbline.storage import shared_dir
    from plumbline.streaming import events

    folder = shared_dir(spark, "events")
    stream = events.distinct_events(events.read_stream(spark, f"{sf_dir}/events.parquet"), late=None)
    events.run_available(stream.select("event_id", "user_id", "event_type", "value"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@query("""WITH r AS (SELECT l_returnflag AS conf, p_type AS g, p_brand AS label, CAST(floor(year(l_shipdate) / 5) * 5 AS INTEGER) AS b FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT 'all' AS scope, * FROM r UNION ALL SELECT 'some', * FROM r WHERE conf IN ('A', 'N')),
t AS (SELECT scope, g, b, label, count(*) AS n FROM s GROUP BY 1, 2, 3, 4), f AS (SELECT scope, g, b, sum(n) AS freq FROM t GROUP BY 1, 2, 3), a AS (SELECT scope, b, sum(freq) AS all_ FROM f GROUP BY 1, 2),
d AS (SELECT x.scope, x.g, a.b, a.all_ FROM (SELECT DISTINCT scope, g FROM f) x JOIN a ON a.scope = x.scope), l AS (SELECT scope, g, b, string_agg(label || ':' || n, ',' ORDER BY n DESC, label) AS topics FROM t GROUP BY 1, 2, 3)
SELECT d.scope, d.g AS "group", d.b AS bucket, CAST(coalesce(f.freq, 0) AS BIGINT) AS freq, round(coalesce(f.freq, 0) / all_, 6) AS share, coalesce(l.topics, '') AS topics FROM d LEFT JOIN f ON f.scope = d.scope AND f.g = d.g AND f.b = d.b LEFT JOIN l ON l.scope = d.scope AND l.g = d.g AND l.b = d.b""")
def scope_payloads(spark, sf_dir):
    """Payloads of two scopes, read back: types are groups, brands topics, return flags venues."""
    from plumbline.plans import pipelines

    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("conf"), F.year("l_shipdate").alias("year"))
    rows = line.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("group"), F.col("p_brand").alias("llm_label")), "l_partkey")
    groups = table(spark, sf_dir, "part").select(F.col("p_type").alias("group")).distinct().withColumn("order", F.length("group"))
    kind = "struct<groups:array<string>,buckets:array<int>,share:map<string,array<double>>,freq:map<string,array<bigint>>,topics:map<string,map<string,array<struct<name:string,papers:bigint,share:double>>>>>"
    made = pipelines.scope_payloads(rows, groups, {"all": "all", "some": ["A", "N"]}).select("scope", F.from_json("payload", kind).alias("d"))
    one = made.select("scope", "d", F.explode("d.groups").alias("group")).select("scope", "d", "group", F.posexplode("d.buckets").alias("i", "bucket"))
    names = F.coalesce(F.try_element_at(F.try_element_at("d.topics", F.col("group")), F.col("bucket").cast("string")), F.array().cast("array<struct<name:string,papers:bigint,share:double>>"))
    shown = F.array_join(F.transform(names, lambda t: F.concat(t["name"], F.lit(":"), t["papers"].cast("string"))), ",")
    at = lambda c: F.get(F.try_element_at(f"d.{c}", F.col("group")), F.col("i"))
    return one.select("scope", "group", "bucket", at("freq").alias("freq"), F.round(at("share"), 6).alias("share"), shown.alias("topics"))
