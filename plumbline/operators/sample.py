"""Exact samples by hash order: stratified with a budget, equal per group, first n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def stratum_plan(rows: DataFrame, stratum: str, forced: list[str], size: int, cap: int) -> DataFrame:
    """(stratum, n, k): how many rows each stratum gives.

    Forced strata give all.  The others share what is left of `size`: at most
    `cap` each, scaled down together where that is too much, rounded half to
    even, at least one each.
    """
    counts = rows.filter(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    is_forced = F.col(stratum).isin(*forced) if forced else F.lit(False)
    tail = F.when(~is_forced, F.least(F.col("n"), F.lit(cap)))
    totals = counts.agg(F.coalesce(F.sum(tail), F.lit(0)).alias("planned"), F.coalesce(F.sum(F.when(is_forced, F.col("n"))), F.lit(0)).alias("taken"))
    budget = F.greatest(F.lit(0), F.lit(size) - F.col("taken"))
    scaled = F.greatest(F.bround(F.least(F.col("n"), F.lit(cap)) * (budget / F.col("planned"))), F.lit(1.0)).cast("long")
    k = F.when(is_forced, F.col("n")).when(F.col("planned") > budget, F.least(scaled, F.col("n"))).otherwise(F.least(F.col("n"), F.lit(cap)))
    return counts.crossJoin(F.broadcast(totals)).select(stratum, "n", k.cast("long").alias("k"))  # totals is one row


#: Hexadecimal digits of the hash that deal a stratum's rows to ranges.
RANGE_DIGITS = 4


def stratified(rows: DataFrame, stratum: str, key: str, forced: list[str], size: int, cap: int, seed: int = 42) -> DataFrame:
    """All rows with in_fit: is the row among the first k of its stratum in hash order?  Rows that repeat a key go together.

    No stratum is sorted whole: counts by ranges of the hash tell in which
    range the k-th row is, the rows of that range alone are ranked, and each
    row is compared with the last one taken.
    """
    k = stratum_plan(rows, stratum, forced, size, cap).select(stratum, "k")
    hashed = rows.filter(F.col(stratum).isNotNull()).withColumn("_h", F.struct(hash_order(F.col(key), seed).alias("h"), F.col(key).alias("key")))
    spread = F.substring("_h.h", 1, RANGE_DIGITS)
    counts = hashed.groupBy(stratum, spread.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(stratum).orderBy("_p"))).join(k, stratum)
    edge = upto.filter((F.col("_upto") - F.col("_n") < F.col("k")) & (F.col("k") <= F.col("_upto"))).select(stratum, "_p", (F.col("k") - F.col("_upto") + F.col("_n")).alias("_need"))
    near = hashed.select(stratum, "_h", spread.alias("_p")).join(edge, [stratum, "_p"])
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_h"))).filter("_rank <= _need")
    last = ranked.groupBy(stratum).agg(F.max("_h").alias("_last"))  # one row per stratum
    return hashed.join(last, stratum, "left").withColumn("in_fit", F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False))).drop("_h", "_last").select(stratum, *(c for c in rows.columns if c != stratum), "in_fit")


def equal_per_group(rows: DataFrame, group: str, key: str, n: int, groups: int, seed: int = 42) -> DataFrame:
    """max(1, n // groups) rows of each group, with `place` as their shuffled order."""
    order = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)
    taken = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(1, n // groups)).drop("_n")
    return taken.withColumn("place", hash_order(F.col(key), f"{seed}s"))


def examples(rows: DataFrame, group: str, key: str, value: str, k: int = 8, chars: int | None = 90, seed: int = 42) -> DataFrame:
    """(group, place, value): k values of each group in hash order, cut to `chars` characters, as a prompt shows them.

    Tasks keep their own first k of a group, so no group meets in one task.
    """
    order = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key, value)
    taken = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return taken.select(group, "place", (F.substring(value, 1, chars) if chars else F.col(value)).alias(value))


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)
