"""Vectors: centroids, nearest centroid, cohesion and margins, coverage, clustering.

Tables of topics are sent to tasks in blocks of a fixed size, one after the
other, so rows are never moved to meet them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.operators import ranks
from plumbline.storage import shared_dir

#: Topics that are sent to every task at a time (64 dimensions: 5 MB).
MAX_BROADCAST = 10_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of vectors of one length, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def usable(vectors: DataFrame, vector: str, size: int | None = None) -> DataFrame:
    """Rows whose vector is there, of `size` components, none of them null, infinite or not a number.

    Without `size` the commonest length counts (of equally common ones the greatest).
    """
    if size is None:
        common = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
        size = common["s"] if common else 0
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vectors.filter((F.size(vector) == size) & F.forall(vector, finite))


def sums_by(vectors: DataFrame, topic: str, vector: str, most: int = 4096) -> DataFrame:
    """(topic, n, s): how many vectors of one length each topic has, and their sum.

    A task adds up its own rows, holding `most` topics at most, and passes on
    one sum for each; so neither a topic's rows nor its components meet.
    """
    kind = vectors.schema[topic].dataType.simpleString()
    out = StructType.fromDDL(f"topic {kind}, n long, s array<double>")

    def add(batches):
        schema = to_arrow_schema(out)
        held: dict = {}

        def passed():
            names = list(held)
            return pa.RecordBatch.from_arrays([pa.array(names, schema.field(0).type), pa.array([held[t][0] for t in names], pa.int64()), pa.array([held[t][1] for t in names], schema.field(2).type)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            x, names = matrix(batch.column(1)), batch.column(0).dictionary_encode()
            own, at = names.dictionary.to_pylist(), names.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(len(own)))
            for t, n, total in zip(own, np.diff(np.r_[first, len(at)]).tolist(), np.add.reduceat(x[order], first, axis=0), strict=True):
                before = held.get(t)
                held[t] = (n, total) if before is None else (before[0] + n, before[1] + total)
            if len(held) > most:
                yield passed()
                held.clear()
        if held:
            yield passed()

    parts = vectors.filter(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(add, out)
    by_place = parts.select("topic", "n", F.posexplode("s").alias("i", "x")).groupBy("topic", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    whole = by_place.groupBy("topic").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))
    return whole.withColumnRenamed("topic", topic)


def centroids(vectors: DataFrame, topic: str, vector: str, size: int | None = None) -> DataFrame:
    """(topic, centroid): mean of each topic's usable vectors (see `usable`), scaled to length 1 (a zero mean stays)."""
    sums = sums_by(usable(vectors, vector, size), topic, vector)
    mean = sums.select(topic, F.transform("s", lambda x: x / F.col("n")).alias("_v"))
    length = norm(F.col("_v"))
    return mean.select(topic, F.when(length > 0, F.transform("_v", lambda x: x / length)).otherwise(F.col("_v")).alias("centroid"))


def _blocks(cents: DataFrame, topic: str, columns: list[str], block: int) -> list:
    """A table of topics as broadcast blocks (topics, columns ...), in the order of the topic; the driver holds one block at a time."""
    spark = cents.sparkSession
    folder = shared_dir(spark, "centroids")
    cents.filter(F.col(topic).isNotNull()).select(topic, *columns).write.parquet(folder)
    rows = spark.read.parquet(folder)
    n = rows.count()
    numbered = rows
    if n > block:
        place = F.row_number().over(Window.partitionBy("_r").orderBy(topic))
        ranged = rows.repartitionByRange(-(-n // block), topic).withColumn("_r", F.spark_partition_id())
        ranged.write.parquet(f"{folder}-ranges")
        numbered = spark.read.parquet(f"{folder}-ranges").withColumn("_c", F.floor((place - 1) / block))
    keys = numbered.select("_r", "_c").distinct().orderBy("_r", "_c").collect() if n > block else [None]
    out = []
    for k in keys:
        mine = numbered if k is None else numbered.filter((F.col("_r") == k["_r"]) & (F.col("_c") == k["_c"]))
        got = mine.orderBy(topic).select(topic, *columns).toArrow().combine_chunks()
        if got.num_rows:
            values = [matrix(got.column(c)) if pa.types.is_list(got.schema.field(c).type) else got.column(c).to_numpy() for c in columns]
            out.append(spark.sparkContext.broadcast((got.column(topic).to_pylist(), *values)))
    return out


def nearest(vectors: DataFrame, id_column: str, vector: str, cents: DataFrame, topic: str, exclude: str | None = None, block: int = MAX_BROADCAST) -> DataFrame:
    """(id, exclude, nearest, sim): the centroid of greatest inner product, to 12 places; ties to the least topic.

    Centroids go to every task in blocks of `block` topics (64 dimensions and
    10,000 topics: 5 MB), and rows stream past each block in Arrow batches, one
    matrix product each, without being moved.  `exclude` names a column whose
    topic is passed over.  Each row counts for itself, ids may repeat or be
    null; rows without a vector of the centroids' length, or with a null or
    non-finite component, are left out, as are centroids that aren't usable.
    Where no topic is left for a row, `nearest` and `sim` are null.
    """
    kept = usable(cents, "centroid")
    blocks = _blocks(kept, topic, ["centroid"], block)
    size = blocks[0].value[1].shape[1] if blocks else 0
    extra = [exclude] if exclude else []
    kind = cents.schema[topic].dataType.simpleString()
    frame = usable(vectors, vector, size).select(F.col(id_column), *extra, F.col(vector).alias("_vector"), F.lit(None).cast(kind).alias("nearest"), F.lit(None).cast("double").alias("sim"))
    names = [id_column, *extra, "nearest", "sim"]
    if not blocks:
        return frame.drop("_vector").limit(0)
    schema = frame.schema

    def pass_of(table):
        def run(batches):
            topics, rows = table.value
            place = {t: i for i, t in enumerate(topics)}
            arrow = to_arrow_schema(schema)
            at = len(schema) - 3
            for batch in batches:
                if not batch.num_rows:
                    continue
                sims = np.round(matrix(batch.column(at)) @ rows.T, 12)
                if exclude:
                    own = [(i, place[t]) for i, t in enumerate(batch.column(1).to_pylist()) if t in place]
                    if own:
                        sims[tuple(np.array(own).T)] = -np.inf
                best = sims.argmax(axis=1)
                found = sims[np.arange(len(best)), best]
                before = batch.column(at + 2).to_numpy(zero_copy_only=False).astype(np.float64)
                better = np.isfinite(found) & ~(found <= before)  # a topic of an earlier block wins ties
                chosen = pa.array([topics[i] for i in best.tolist()], arrow.field(at + 1).type)
                yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], pc.if_else(pa.array(better), chosen, batch.column(at + 1)), pc.if_else(pa.array(better), pa.array(found), batch.column(at + 2))], schema=arrow)

        return run

    for table in blocks:
        frame = frame.mapInArrow(pass_of(table), schema)
    return frame.select(*names)


def cohesion(vectors: DataFrame, topic: str, vector: str, cents: DataFrame) -> DataFrame:
    """Per topic: mean cosine of its usable rows to its centroid, that of the nearest other centroid, and the margin of rows.

    The mean of x.c over unit vectors x is their mean times c, so topic sums do.
    """
    length = norm(F.col(vector))
    unit = usable(vectors, vector).select(topic, F.transform(vector, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0)).alias("_u"))
    mean = sums_by(unit, topic, "_u").join(cents, topic).select(topic, "n", (dot(F.col("s"), F.col("centroid")) / F.col("n")).alias("cohesion"))
    other = nearest(cents.withColumnRenamed("centroid", "v").withColumn("_self", F.col(topic)), "_self", "v", cents, topic, exclude=topic)
    return mean.join(other.select(F.col(topic), F.col("nearest").alias("nearest_topic"), F.col("sim").alias("nearest_sim")), topic)


def _prototypes(named: DataFrame, theme: str) -> DataFrame:
    """Mean of the centroids of each theme's topics, numbered (one row per theme)."""
    return centroids(named, theme, "centroid").withColumn("_t", F.row_number().over(Window.orderBy(theme)))


def theme_coherence(cents: DataFrame, topic: str, themes: DataFrame, theme: str) -> DataFrame:
    """Per theme: its topics, their mean similarity to its prototype, the nearest other theme (null if there is none) and how many topics are misfiled."""
    named = cents.join(themes, topic)
    numbered = _prototypes(named, theme)
    own = named.join(numbered.select(theme, F.col("centroid").alias("_p")), theme)
    intra = own.groupBy(theme).agg(F.count(F.lit(1)).alias("n_topics"), F.avg(dot(F.col("centroid"), F.col("_p"))).alias("intra_sim"))
    near = nearest(numbered.select("_t", F.col("_t").alias("_self"), "centroid"), "_self", "centroid", numbered.select("_t", "centroid"), "_t", exclude="_t").filter("nearest <> _self")
    other = near.join(numbered.select(F.col("_t").alias("_self"), theme), "_self").join(numbered.select(F.col("_t").alias("nearest"), F.col(theme).alias("nearest_theme")), "nearest").select(theme, "nearest_theme", F.col("sim").alias("nearest_sim"))
    wrong = misfiled(cents, topic, themes, theme).groupBy(theme).agg(F.count_if("misfiled").alias("n_misfiled"))
    return intra.join(other, theme, "left").join(wrong, theme, "left")


def misfiled(cents: DataFrame, topic: str, themes: DataFrame, theme: str) -> DataFrame:
    """Per topic: the theme whose prototype (mean of its topics' centroids) is nearest, and whether that is another than its own.

    Themes join on the topic's id, never on row order.
    """
    named = cents.join(themes, topic)
    numbered = _prototypes(named, theme)
    near = nearest(named, topic, "centroid", numbered.select("_t", "centroid"), "_t")
    return near.join(numbered.select(F.col("_t").alias("nearest"), F.col(theme).alias("nearest_theme")), "nearest").join(themes, topic).select(topic, theme, "nearest_theme", F.col("sim"), (F.col(theme) != F.col("nearest_theme")).alias("misfiled"))


def silhouette(vectors: DataFrame, topic: str, vector: str, block: int = MAX_BROADCAST, size: int | None = None) -> DataFrame:
    """(topic, n, silhouette): mean cosine silhouette of each topic's usable rows, from topic sums.

    The mean cosine distance of a row to a topic is 1 - x.S/n with S the sum
    of the topic's unit vectors, so no pairs are made.  Sums go out in blocks
    of `block` topics; rows stream past each and keep the least distance to
    another topic.  A row that is alone in its topic, or has no other, counts 0.
    """
    length = norm(F.col(vector))
    kind = vectors.schema[topic].dataType.simpleString()
    rows = usable(vectors, vector, size).filter(F.col(topic).isNotNull()).select(topic, F.transform(vector, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0)).alias("_u"))
    blocks = _blocks(sums_by(rows, topic, "_u"), topic, ["n", "s"], block)
    frame = rows.select(topic, "_u", *(F.lit(None).cast("double").alias(c) for c in ("own", "other")))
    schema = StructType.fromDDL(f"topic {kind}, u array<double>, own double, other double")
    frame = frame.toDF("topic", "u", "own", "other")

    def pass_of(table):
        def run(batches):
            topics, n, sums = table.value
            place = {t: i for i, t in enumerate(topics)}
            arrow = to_arrow_schema(schema)
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = matrix(batch.column(1)) @ sums.T
                rest = 1 - near / n
                own = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64).copy()
                mine = [(i, place[t]) for i, t in enumerate(batch.column(0).to_pylist()) if t in place]
                if mine:
                    i, j = np.array(mine).T
                    own[i] = np.where(n[j] > 1, (n[j] - near[i, j]) / np.maximum(n[j] - 1, 1), -1)  # -1: alone
                    rest[i, j] = np.inf
                other = np.fmin(batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64), rest.min(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(other)], schema=arrow)

        return run

    for table in blocks:
        frame = frame.mapInArrow(pass_of(table), schema)
    a, b = F.col("own"), F.col("other")
    top = F.greatest(a, b)
    value = F.when((a == -1) | ~(b < float("inf")) | (top == 0), 0.0).otherwise((b - a) / top)
    return frame.select(F.col("topic").alias(topic), value.alias("value")).groupBy(topic).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("silhouette"))


def coverage(sims: DataFrame, sim: str = "sim", below: tuple[float, ...] = (0.2, 0.3, 0.4)) -> DataFrame:
    """Percentiles of similarity to the nearest centroid and the shares below some values; null and NaN don't count."""
    rows = sims.filter(F.col(sim).isNotNull() & ~F.isnan(sim))
    names = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    found = ranks.percentiles(rows, sim, list(names.values()))
    out = rows.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg((F.col(sim) < t).cast("double")), 6).alias(f"below_{int(t * 100):02d}") for t in below))
    return out.select("n", *(F.round(F.lit(found[p]).cast("double"), 6).alias(n) for n, p in names.items()), *(f"below_{int(t * 100):02d}" for t in below))


def embed_terms(docs: DataFrame, text: str, size: int = 256) -> DataFrame:
    """A unit vector of hashed term counts: stands in where no sentence model is at hand."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from plumbline.functions.text import tokens

    words = docs.withColumn("_w", tokens(F.col(text)))
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=size).transform(words)
    return Normalizer(inputCol="_tf", outputCol="_n").transform(tf).withColumn("vector", vector_to_array("_n", "float32")).drop("_w", "_tf", "_n")


def reduce(vectors: DataFrame, vector: str, k: int = 5) -> DataFrame:
    """k principal components; stands in for a neighbour-graph reduction."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    frame = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(frame).transform(frame).withColumn("reduced", vector_to_array("_p")).drop("_v", "_p")


def cluster(vectors: DataFrame, vector: str, k: int, seed: int = 42, outlier_below: float | None = None) -> DataFrame:
    """topic_id by k-means on cosine distance; rows further than a threshold from their centre are outliers (-1).

    Stands in for a density clustering, which Spark doesn't have.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    frame = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_v", predictionCol="topic_id").fit(frame)
    out = model.transform(frame)
    if outlier_below is not None:
        centers = [c.tolist() for c in model.clusterCenters()]
        c = F.get(F.array(*(F.array(*map(F.lit, c)) for c in centers)), F.col("topic_id"))
        v = vector_to_array("_v")
        out = out.withColumn("topic_id", F.when(dot(v, c) / (norm(v) * norm(c)) < outlier_below, -1).otherwise(F.col("topic_id")))
    return out.drop("_v")


def lda_topics(docs: DataFrame, id_column: str, text: str, k: int, words: int = 10, vocabulary: int = 20_000, min_df: int = 3, stop: list[str] | None = None, seed: int = 42, iterations: int = 10) -> DataFrame:
    """(topic, term, weight, rank) of an LDA baseline."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    from plumbline.functions.text import tokens

    w = tokens(F.col(text))
    rows = docs.select(id_column, (F.filter(w, lambda t: ~t.isin(*stop)) if stop else w).alias("_w"))
    cv = CountVectorizer(inputCol="_w", outputCol="_tf", vocabSize=vocabulary, minDF=min_df).fit(rows)
    model = LDA(k=k, seed=seed, maxIter=iterations, optimizer="online", featuresCol="_tf").fit(cv.transform(rows))
    names = docs.sparkSession.createDataFrame(pd.DataFrame({"i": range(len(cv.vocabulary)), "term": cv.vocabulary}), "i int, term string")
    top = model.describeTopics(words).select("topic", F.posexplode(F.arrays_zip(F.col("termIndices").alias("i"), F.col("termWeights").alias("weight"))).alias("rank", "s"))
    return top.select("topic", (F.col("rank") + 1).alias("rank"), F.col("s.i").alias("i"), F.col("s.weight").alias("weight")).join(names, "i").select("topic", "term", "weight", "rank")
