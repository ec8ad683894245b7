"""Corpus reports and checks by raters: hit rates, agreement, accuracy, milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.functions import stats
from plumbline.operators import match
from plumbline.storage import shared_dir


def hit_rate(papers: DataFrame, venue: str, doi: Column, matched: Column, abstract: Column, year: str) -> DataFrame:
    """Per venue: counts with and without DOI, matched, with abstract; rates; first and last year."""
    out = papers.filter(F.col(venue).isNotNull()).groupBy(venue).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(doi).alias("n_doi"),
        F.count_if(~doi).alias("n_doi_less"),
        F.count_if(matched).alias("n_matched"),
        F.count_if(abstract).alias("n_abstract"),
        F.min(year).alias("year_first"),
        F.max(year).alias("year_last"),
    )
    return out.withColumns({"abstract_hit_rate": F.round(F.col("n_abstract") / F.col("n_total"), 4), "doi_coverage": F.round(F.col("n_doi") / F.col("n_total"), 4)})


def qualifying(rates: DataFrame, venue: str, forced: list[str], least: int, least_rate: float) -> DataFrame:
    """Venues with enough papers and abstracts, and the forced ones, with the reason."""
    ok = (F.col("n_total") >= least) & (F.col("abstract_hit_rate") >= least_rate)
    is_forced = F.col(venue).isin(*forced) if forced else F.lit(False)
    return rates.filter(ok | is_forced).select(venue, "n_total", "n_abstract", "abstract_hit_rate", F.when(is_forced, "forced").otherwise("qualified").alias("reason"))


def ends(rates: DataFrame, venue: str, n: int, least: int) -> DataFrame:
    """The n best and n worst venues of at least `least` papers."""
    big = rates.filter(F.col("n_total") >= least)
    best = big.orderBy(F.desc("abstract_hit_rate"), F.desc("n_total"), venue).limit(n).withColumn("part", F.lit("top"))
    worst = big.orderBy("abstract_hit_rate", F.desc("n_total"), venue).limit(n).withColumn("part", F.lit("bottom"))
    return best.unionByName(worst)


def raters(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two raters' tables as one row per item that both rated, with their columns under suffixes.

    Of several rows of an item the one with the highest values, column by
    column, counts; items without key go.
    """

    def one(t: DataFrame, suffix: str) -> DataFrame:
        columns = [c for c in t.columns if c != key]
        kept = match.latest(t, key, [F.col(c).desc_nulls_last() for c in columns])
        return kept.select(key, *(F.col(c).alias(c + suffix) for c in columns))

    return one(a, suffixes[0]).join(one(b, suffixes[1]), key)


def agreement(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, Cohen's kappa and Gwet's AC1 of two 0/1 ratings of the same items."""
    r = ratings.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = r.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agree"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    agree, pa, pb = F.col("agree"), F.col("pa"), F.col("pb")
    return out.select("n", F.round(agree, 6).alias("agreement"), F.round(stats.cohen_kappa(agree, pa, pb), 6).alias("kappa"), F.round(stats.gwet_ac1(agree, pa, pb), 6).alias("ac1"))


def accuracy(ratings: DataFrame, group: str, right: Column) -> DataFrame:
    """Share of right items per group with its Wilson interval."""
    out = ratings.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return out.select(group, "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def pool(assigned: DataFrame, papers: DataFrame, topics: DataFrame) -> DataFrame:
    """Papers with an abstract, with their topic's label and words: what raters draw from."""
    joined = assigned.join(papers, "dblp_key").join(topics, "topic_id", "left")
    return joined.filter(F.trim(F.coalesce("abstract", F.lit(""))) != "")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def summary(log: DataFrame, group: str = "group") -> DataFrame:
    """Verdicts and kinds of error per group and in all (null group)."""
    return log.rollup(group).agg(*(F.count_if(F.col("correct") == v).alias(n) for v, n in (("y", "right"), ("n", "wrong"), ("s", "skipped"))), *(F.count_if((F.col("correct") == "n") & (F.col("error_type") == e)).alias(n) for e, n in (("g", "wrong_group"), ("t", "wrong_topic"), ("b", "both"))))


# Fixed value: how a note names the group that a row should be in.
NOTE = r"[Ss]hould be\s+([^:;]+?)(?:\s+or\s+|\s*[:;]|$)"
def suggested_group(log: DataFrame, registry: DataFrame, key: str, notes: str = "notes") -> DataFrame:
    """(key, suggestion): the first group in registry order that a note's "should be X" names, or that names it.

    Different notes meet the registry once each: they are few beside the log,
    and stream past the names, which go to every task in blocks of NAMES.
    """
    spark = log.sparkSession
    said = log.select(key, F.lower(F.trim(F.regexp_extract(notes, NOTE, 1))).alias("_s")).filter("_s <> ''")
    names = registry.select(F.col("group").alias("g"), "order").filter("g is not null")
    count = names.count()
    found = said.select("_s").distinct().withColumn("_best", F.lit(None).cast("struct<o:bigint,g:string>"))
    for k in range(-(-count // NAMES)):
        some = names.filter(F.pmod(F.xxhash64("g", "order"), F.lit(-(-count // NAMES))) == k).select(F.col("order").cast("long").alias("o"), "g", F.lower("g").alias("l"))
        block = spark.createDataFrame([([tuple(r) for r in some.orderBy("o", "g").collect()],)], "_names array<struct<o:bigint,g:string,l:string>>")  # one row
        fits = F.filter("_names", lambda n: F.col("_s").contains(n["l"]) | n["l"].contains(F.col("_s")))
        first = F.transform(F.slice(fits, 1, 1), lambda n: F.struct(n["o"].alias("o"), n["g"].alias("g")))
        found = found.crossJoin(F.broadcast(block)).select("_s", F.array_min(F.concat(first, F.filter(F.array("_best"), lambda b: b.isNotNull()))).alias("_best"))
    named = found.filter("_best is not null")
    return said.join(named, "_s").groupBy(key).agg(F.min("_best").alias("_best")).select(key, F.col("_best.g").alias("suggestion"))


#: Names of groups that go to every task at a time.
NAMES = 1000


def milestones(log: DataFrame) -> DataFrame:
    """Share of hits, unmatched ones, and the mean distance in years; texts that are no numbers don't count."""
    delta = F.expr("try_cast(delta_years AS double)")
    return log.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("status") == "hit").cast("double")), 6).alias("hit_rate"), F.count_if(F.col("matched_topic_id").isNull()).alias("unmatched"), F.round(F.avg(F.abs(delta)), 6).alias("mean_abs_delta"))


def registry(papers: DataFrame, groups: DataFrame, group: str = "group") -> DataFrame:
    """Every group in order with its papers and share (0 where it has none)."""
    n = papers.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("papers"))
    out = groups.join(n, group, "left").withColumn("papers", F.coalesce("papers", F.lit(0)))
    total = F.sum("papers").over(Window.partitionBy())  # one row per group
    return out.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("papers"), total), F.lit(0.0)), 6))


def ecdf(rows: DataFrame, value: str, key: str) -> DataFrame:
    """(key, value, ecdf): place over number, ties by key; null values have none.

    Rows are dealt to ranges of (value, key) and written, so that the running
    place is a window within a range plus the sizes of the ranges below.
    Neither an outlier nor a value that most rows share fills one range.
    """
    spark = rows.sparkSession
    folder = shared_dir(spark, "ecdf")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = rows.filter(F.col(value).isNotNull()).select(F.col(key), F.col(value))
    r.repartitionByRange(n, value, key).withColumn("_r", F.spark_partition_id()).write.parquet(folder)
    dealt = spark.read.schema(StructType([*r.schema.fields, StructField("_r", IntegerType())])).parquet(folder)
    sizes = dealt.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    below = sizes.select("_r", F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(value, key))
    return dealt.withColumn("_place", place).join(below, "_r").select(key, value, F.round((F.coalesce("_below", F.lit(0)) + F.col("_place")) / F.col("_all"), 9).alias("ecdf"))
