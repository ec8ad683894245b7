"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.storage import shared_dir


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge: root is the least node of its component.  A node that has no edge but to itself, or to null, is its own root.

    Each round links every larger neighbour, then every smaller one, of a node
    to the least of them (large star, small star).  Least neighbours come from
    a pre-aggregated minimum and an equi-join, so a node with very many
    neighbours is no single group anywhere.  Rounds are cut from each other by
    a written table in the shared folder.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark, "components")
    kind = edges.schema[a].dataType.simpleString()
    # The edges are used several times a round: they are made once.
    edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct().write.parquet(f"{folder}/edges")
    now = spark.read.schema(f"u {kind}, v {kind}").parquet(f"{folder}/edges")
    before = None
    for k in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        star = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        star.write.parquet(f"{folder}/{k}")
        now = spark.read.schema(f"u {kind}, v {kind}").parquet(f"{folder}/{k}")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle within {rounds} rounds")
    joined = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    ends = edges.filter((F.col(a) == F.col(b)) | F.col(a).isNull() | F.col(b).isNull()).select(F.coalesce(a, b).alias("node")).filter("node is not null").distinct()
    return joined.unionByName(ends.join(joined.select("node"), "node", "left_anti").withColumn("root", F.col("node")))
