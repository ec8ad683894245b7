"""Queries over embeddings: topics are their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import density, neighbours
from plumbline.operators import vectors as O
from plumbline.plans.registry import query, table
from plumbline.storage import shared_dir

_CENTROIDS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1), c AS (SELECT label, list(m / n ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY label)"""


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _centroids(spark, sf_dir):
    """Written, as most queries use the table several times."""
    folder = shared_dir(spark, "label-centroids")
    O.centroids(_embeddings(spark, sf_dir), "label", "embedding").write.parquet(folder)
    return spark.read.parquet(folder)


@query(f"WITH {_CENTROIDS} SELECT label, i AS place, round(m / n, 6) AS component FROM (SELECT label, CAST(i - 1 AS INTEGER) AS i, m, n FROM m JOIN n USING (label))")
def topic_centroids(spark, sf_dir):
    return _centroids(spark, sf_dir).select("label", F.posexplode("centroid").alias("place", "c")).select("label", "place", F.round("c", 6).alias("component"))


_NEAREST = f"{_CENTROIDS}, s AS (SELECT vec_id, c.label AS nearest, round(list_inner_product(v, c), 12) AS sim FROM e CROSS JOIN c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, nearest) AS k FROM s)"


@query(f"WITH {_NEAREST} SELECT vec_id, nearest, round(sim, 6) AS sim FROM b WHERE k = 1")
def nearest_centroid_assign(spark, sf_dir):
    return O.nearest(_embeddings(spark, sf_dir), "vec_id", "embedding", _centroids(spark, sf_dir), "label").withColumn("sim", F.round("sim", 6))


@query(f"""WITH {_NEAREST}, t AS (SELECT sim FROM b WHERE k = 1)
SELECT count(*) AS n, {', '.join(f'round(quantile_cont(sim, {p / 100}), 6) AS p{p}' for p in (10, 25, 50, 75, 90))}, {', '.join(f'round(avg(CAST(sim < {t / 100} AS INT)), 6) AS below_{t}' for t in (20, 30, 40))} FROM t""")
def assign_coverage_percentiles(spark, sf_dir):
    return O.coverage(O.nearest(_embeddings(spark, sf_dir), "vec_id", "embedding", _centroids(spark, sf_dir), "label"))


@query(f"""WITH {_CENTROIDS}, own AS (SELECT e.label, list_inner_product(v, c) / sqrt(list_inner_product(v, v)) AS s FROM e JOIN c ON c.label = e.label),
o AS (SELECT a.label, b.label AS nearest_topic, round(list_inner_product(a.c, b.c), 12) AS sim FROM c a JOIN c b ON a.label <> b.label),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, nearest_topic) AS k FROM o)
SELECT own.label, count(*) AS n, round(avg(s), 6) AS cohesion, any_value(nearest_topic) AS nearest_topic, round(any_value(sim), 6) AS nearest_sim, round(avg(s) - any_value(sim), 6) AS margin
FROM own JOIN k ON k.label = own.label AND k.k = 1 GROUP BY own.label""")
def topic_cohesion_margin(spark, sf_dir):
    out = O.cohesion(_embeddings(spark, sf_dir), "label", "embedding", _centroids(spark, sf_dir))
    return out.select("label", "n", F.round("cohesion", 6).alias("cohesion"), "nearest_topic", F.round("nearest_sim", 6).alias("nearest_sim"), F.round(F.col("cohesion") - F.col("nearest_sim"), 6).alias("margin"))


_THEMES = f"""{_CENTROIDS}, t AS (SELECT label, c, CAST(label % 3 AS INTEGER) AS theme FROM c), tu AS (SELECT theme, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM t), tm AS (SELECT theme, i, avg(x) AS m FROM tu GROUP BY 1, 2),
tn AS (SELECT theme, sqrt(sum(m * m)) AS n FROM tm GROUP BY 1), p AS (SELECT theme, list(m / n ORDER BY i) AS p FROM tm JOIN tn USING (theme) GROUP BY theme),
s AS (SELECT label, t.theme, p.theme AS nearest_theme, round(list_inner_product(c, p.p), 12) AS sim FROM t CROSS JOIN p), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, nearest_theme) AS k FROM s)"""


def _themes(cents):
    return cents.select("label", (F.col("label") % 3).cast("int").alias("theme"))


@query(f"""WITH {_THEMES} SELECT label, theme, nearest_theme, round(sim, 6) AS sim, theme <> nearest_theme AS misfiled FROM k WHERE k = 1""")
def misfiled_topics(spark, sf_dir):
    cents = _centroids(spark, sf_dir)
    return O.misfiled(cents, "label", _themes(cents), "theme").withColumn("sim", F.round("sim", 6))


@query(f"""WITH {_THEMES}, own AS (SELECT t.theme, count(*) AS n_topics, round(avg(list_inner_product(t.c, p.p)), 6) AS intra_sim FROM t JOIN p ON p.theme = t.theme GROUP BY 1),
o AS (SELECT a.theme, b.theme AS nearest_theme, round(list_inner_product(a.p, b.p), 12) AS sim FROM p a JOIN p b ON a.theme <> b.theme), ko AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY sim DESC, nearest_theme) AS k FROM o),
w AS (SELECT theme, count(*) FILTER (theme <> nearest_theme) AS n_misfiled FROM k WHERE k = 1 GROUP BY 1)
SELECT own.theme, n_topics, intra_sim, ko.nearest_theme, round(ko.sim, 6) AS nearest_sim, n_misfiled FROM own LEFT JOIN ko ON ko.theme = own.theme AND ko.k = 1 LEFT JOIN w ON w.theme = own.theme""")
def theme_coherence(spark, sf_dir):
    cents = _centroids(spark, sf_dir)
    out = O.theme_coherence(cents, "label", _themes(cents), "theme")
    return out.select("theme", "n_topics", F.round("intra_sim", 6).alias("intra_sim"), "nearest_theme", F.round("nearest_sim", 6).alias("nearest_sim"), "n_misfiled")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS r FROM embeddings), l AS (SELECT vec_id, label, r, sqrt(list_inner_product(r, r)) AS n FROM e),
u AS (SELECT vec_id, label, list_transform(r, lambda x: x / n) AS v FROM l), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_inner_product(a.v, b.v)) AS s, count(*) AS n FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, label, max(s / n) FILTER (other = label) AS a, min(s / n) FILTER (other <> label) AS b FROM d GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM ab GROUP BY label""")
def silhouette_cosine(spark, sf_dir):
    return O.silhouette(_embeddings(spark, sf_dir), "label", "embedding").withColumn("silhouette", F.round("silhouette", 5))


@query("""SELECT vec_id, round(sqrt(list_inner_product(e, e)) / (sqrt(list_inner_product(e, e)) + 1e-9), 6) AS length, round(e[1] / (sqrt(list_inner_product(e, e)) + 1e-9), 6) AS head FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""")
def unit_vectors(spark, sf_dir):
    u = _embeddings(spark, sf_dir).select("vec_id", T.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(O.norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 6).alias("head"))


@query(f"""WITH {_CENTROIDS}, a AS (SELECT c.label AS anchor, c.c AS a FROM c WHERE c.label % 3 = 0), s AS (SELECT c.label AS topic_id, anchor, round(list_inner_product(c.c, a), 12) AS sim FROM c CROSS JOIN a),
k AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY sim DESC, anchor) AS k FROM s) SELECT topic_id, anchor, round(sim, 6) AS sim FROM k WHERE k = 1""")
def seed_theme_mapping(spark, sf_dir):
    """Each topic's nearest theme anchor; here every third topic's centroid is an anchor."""
    cents = _centroids(spark, sf_dir)
    near = O.nearest(cents.withColumnRenamed("label", "topic_id"), "topic_id", "centroid", cents.filter("label % 3 = 0"), "label")
    return near.select("topic_id", F.col("nearest").alias("anchor"), F.round("sim", 6).alias("sim"))


@query()
def kmeans_topics(spark, sf_dir):
    return O.cluster(_embeddings(spark, sf_dir), "embedding", k=10, outlier_below=0.05).select("vec_id", "label", "topic_id")


@query()
def reduced_vectors(spark, sf_dir):
    return O.reduce(_embeddings(spark, sf_dir), "embedding").select("vec_id", "label", "reduced")


@query()
def lda_topics(spark, sf_dir):
    return O.lda_topics(table(spark, sf_dir, "documents"), "doc_id", "text", k=8)


@query()
def term_embeddings(spark, sf_dir):
    return O.embed_terms(table(spark, sf_dir, "documents"), "text").select("doc_id", "vector")


_GRAPH = """u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM u),
d AS (SELECT a.id, b.id AS near, round(greatest(1 - list_inner_product(a.v, b.v), 0), 12) AS distance FROM n a JOIN n b ON a.id <> b.id),
g AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, near) AS INTEGER) AS rank FROM d) WHERE rank <= 10)"""


def _graph(spark, sf_dir):
    """The ten nearest rows of every row: all rows are the queries, block by block."""
    rows = neighbours.prepared(_embeddings(spark, sf_dir), "vec_id", "embedding")
    return neighbours.nearest_of(rows, rows, 10)


@query(f"WITH {_GRAPH} SELECT id AS vec_id, near, round(distance, 6) AS distance, rank FROM g")
def nearest_rows(spark, sf_dir):
    return _graph(spark, sf_dir).select(F.col("id").alias("vec_id"), "near", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH {_GRAPH}, c AS (SELECT id, max(distance) AS core FROM g WHERE rank <= 5 GROUP BY 1), p AS (SELECT least(id, near) AS a, greatest(id, near) AS b, min(distance) AS d FROM g GROUP BY 1, 2)
SELECT a, b, round(greatest(d, x.core, y.core), 6) AS w FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b""")
def mutual_reachability(spark, sf_dir):
    """The graph is written, as its cores and its pairs both read it."""
    folder = shared_dir(spark, "graph")
    _graph(spark, sf_dir).write.parquet(folder)
    return density.mutual_reachability(spark.read.parquet(folder), 5).withColumn("w", F.round("w", 6))


@query()
def density_topics(spark, sf_dir):
    """Topics of the whole chain: neighbour graph, layout, clusters by density in it."""
    table_ = _embeddings(spark, sf_dir)
    reduced = neighbours.reduce(table_, "vec_id", "embedding")
    graph = neighbours.descend(reduced, "vec_id", "reduced", 15, "euclidean")
    return density.cluster(graph, reduced.select(F.col("vec_id").alias("id")), 15).withColumnRenamed("id", "vec_id")


@query()
def neighbour_layout(spark, sf_dir):
    return neighbours.reduce(_embeddings(spark, sf_dir), "vec_id", "embedding")


@query()
def neighbour_descent(spark, sf_dir):
    return neighbours.descend(_embeddings(spark, sf_dir), "vec_id", "embedding", 15).withColumnRenamed("id", "vec_id")
