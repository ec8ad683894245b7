"""Raters' tables, generated values and requests on odd tables."""

from pyspark.sql import functions as F

from plumbline.operators import review
from plumbline.sources import responses


def test_raters_of_odd_tables(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 0, "z"), (2, None, "y"), (None, 1, "n"), (3, 1, "q")], "k int, rating int, note string")
    b = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (4, 1), (None, 1)], "k int, rating int")
    got = sorted(map(tuple, review.raters(a, b, "k").collect()))
    assert got == [(1, 1, "x", 0), (2, None, "y", 1)] and review.raters(a, b, "k").columns == ["k", "rating_a", "note_a", "rating_b"]
    assert review.raters(a.limit(0), b, "k").count() == 0


def test_values_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def value(k):
        made.add(1)
        return k.upper()

    path = f"file://{tmp_path}/cache"
    wanted = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "cache_key string, n int")
    make = lambda df: df.select("cache_key", value("cache_key").alias("value"))
    read = lambda *ks: sorted(map(tuple, responses.generated(wanted(*ks), path, make).collect()))
    assert read("a", "b", "a") == [("a", "A"), ("b", "B")] and made.value == 2
    assert read("b", "c", None) == [("b", "B"), ("c", "C")] and made.value == 3
    assert read("a", "c") == [("a", "A"), ("c", "C")] and made.value == 3
