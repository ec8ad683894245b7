"""Whole flows over tables: corpus, fit sample, topics, themes, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import clean, match, review, sample, temporal, terms, vectors
from plumbline import schemas
from plumbline.schemas import PAPERS, require_columns
from plumbline.sources import io
from plumbline.storage import exists, overwrite, shared_dir


def venue(papers: DataFrame, conf: str, slug: str, out: str, include_companion: bool = False) -> DataFrame:
    """One venue's cleaned slice, written."""
    return overwrite(clean.venue_slice(require_columns(papers, PAPERS, "papers"), conf, slug, include_companion), out)


def corpus(papers: DataFrame, works: DataFrame, overrides: DataFrame, out: str, compose: bool = True) -> DataFrame:
    """All papers with the abstract of their DOI or, failing that, of their own key, and the text of both."""
    found = match.works(works).select("doi", "abstract")
    rows = match.with_fallback(papers.select("conf", "dblp_key", "title", "year", "doi"), found, overrides, "doi", "dblp_key")
    return overwrite(clean.text_fields(rows, compose).select("conf", "dblp_key", "title", "year", "doi", "abstract", "has_abstract", "text"), out)


def select_corpus(rows: DataFrame, forced: list[str], min_papers: int = 50, min_rate: float = 0.5, size: int = 120_000, cap: int = 3_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The universe (papers with abstract in kept venues) with its fit sample, and the report of venues."""
    rates = review.hit_rate(rows, "conf", F.col("doi").isNotNull(), F.col("has_abstract"), F.col("has_abstract"), "year")
    kept = review.qualifying(rates, "conf", forced, min_papers, min_rate).select("conf")
    universe = rows.filter("has_abstract").join(kept, "conf", "left_semi").select("dblp_key", "conf", "year")
    sampled = sample.stratified(universe, "conf", "dblp_key", forced, size, cap, seed)
    fit = sampled.groupBy("conf").agg(F.count(F.lit(1)).alias("n_universe"), F.count_if("in_fit").alias("n_fit"))
    report = rates.select("conf", "n_total", "n_abstract", "abstract_hit_rate").join(fit, "conf", "left").na.fill(0, ["n_universe", "n_fit"]).withColumn("kept", F.col("n_universe") > 0)
    return sampled, report


def topics(fit: DataFrame, everything: DataFrame, k: int, words: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Topics of a fit sample (id, vector, text) and the nearest one of each row of `everything` (id, vector)."""
    clustered = vectors.cluster(fit, "vector", k, seed)
    cents = vectors.centroids(clustered.filter("topic_id <> -1"), "topic_id", "vector")
    counted = terms.class_counts(terms.doc_terms(clustered, "id", "text", ["topic_id"]), ["topic_id"], 2)
    lists = terms.word_lists(terms.top_terms(terms.class_tfidf(counted, ["topic_id"]), ["topic_id"], words), ["topic_id"])
    sizes = clustered.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
    table = lists.join(sizes, "topic_id").withColumn("llm_label", terms.fallback_label(F.col("top_words")))
    return table, vectors.nearest(everything, "id", "vector", cents, "topic_id").withColumnRenamed("nearest", "topic_id")


def assign_all(rows: DataFrame, id_column: str, vector: str, cents: DataFrame, topic: str, out: str, parts: int = 16) -> DataFrame:
    """(id, topic, sim) of every row's nearest centroid, written by hash of the id in `parts` parts.

    All parts that aren't whole yet are written in one pass over the rows; a
    part counts as whole when its mark is there, which is set after the pass.
    A run that was cut off leaves none of its own parts marked, but those of
    runs before.  What lies there of another table of centroids is made anew.
    """
    spark = rows.sparkSession
    state = cents.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(topic, "centroid"))).first()
    model = f"{out}/model={state[0]}-{(state[1] or 0) & ((1 << 64) - 1):016x}"
    missing = [i for i in range(parts) if not exists(spark, f"{model}/done-{parts}-{i}/_SUCCESS")]
    part = F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int")
    if missing:
        mine = rows if len(missing) == parts else rows.filter(part.isin(*missing))
        found = vectors.nearest(mine, id_column, vector, cents, topic).withColumnRenamed("nearest", topic).withColumn("part", part)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{model}/parts-{parts}")
        for i in missing:
            spark.range(0).write.mode("overwrite").parquet(f"{model}/done-{parts}-{i}")
    kinds = f"{id_column} {rows.schema[id_column].dataType.simpleString()}, {topic} {cents.schema[topic].dataType.simpleString()}, sim double, part int"
    return spark.read.schema(kinds).parquet(f"{model}/parts-{parts}").drop("part")


def apply_groups(topic_table: DataFrame, paper_topics: DataFrame, groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics and papers with their theme, and the theme registry; every label must be in the grouping and the other way round."""
    match.assert_references(topic_table, members, "llm_label")
    named = topic_table.drop("group", "group_color").join(members, "llm_label", "left").join(groups.select("group", F.col("color").alias("group_color")), "group", "left")
    papers = paper_topics.drop("group").join(named.select("topic_id", "group"), "topic_id", "left")
    return named, papers, review.registry(papers, groups)


def figures(papers: DataFrame, named: DataFrame, width: int = 5) -> dict[str, DataFrame]:
    """The tables behind the figures, from papers (key, year, topic_id, group)."""
    rows = papers.filter("`group` is not null").withColumns({"bucket": T.bucket(F.col("year"), width), "decade": T.decade(F.col("year"))})
    counted = temporal.dense(temporal.counts(rows, "group", "bucket"), "group", "bucket")
    shared = temporal.shares(counted, "bucket")
    labelled = rows.join(named.select("topic_id", "llm_label"), "topic_id", "left")
    start = labelled.withColumn("start", T.bucket(F.col("year"), 10))
    return {
        "streamgraph": shared,
        "rank": temporal.rank_per(shared, "bucket", "group"),
        "topics": temporal.shares(temporal.counts(rows, "group", "topic_id", "bucket"), "group", "bucket", digits=4),
        "treemap": temporal.rollup(labelled, "decade", "group", "topic_id"),
        "growth": temporal.growth(temporal.counts(start, "topic_id", "start"), "topic_id", "start", 10),
        "peaks": temporal.peak(shared, "group", "bucket"),
        "onset": temporal.onset(counted, "group", "bucket", from_year=0, step=width),
    }


def migrations(papers: DataFrame, authors: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Flows of authors between themes of adjoining windows, and their summary."""
    people = papers.join(authors.select("dblp_key", F.explode("authors").alias("author")), "dblp_key").withColumn("author", T.clean_author(F.col("author")))
    main = temporal.dominant(people.withColumn("bucket", T.bucket(F.col("year"), width)), "author", "bucket", "topic_id")
    flows = temporal.migration(main, "author", "bucket", "topic_id", width)
    return flows, temporal.net_flow(flows, "bucket")


def scope_payloads(rows: DataFrame, groups: DataFrame, scopes: dict[str, list[str] | str], width: int = 5) -> DataFrame:
    """(scope, payload): what a figure of a scope shows, as JSON that can stand in a script element.

    `rows` are papers (conf, year, group, llm_label), `groups` the registry
    (group, order); a scope is a list of venues, or a word for all.  The JSON
    has groups (those with papers, in order), buckets, share and freq (by
    group, one number for each bucket) and topics (by group and bucket: name,
    papers, share of the group; most papers first, ties by name).  Rows
    without group or year don't count; a scope without rows has no payload.
    All comes from one count by scope, group, bucket and label.
    """
    spark = rows.sparkSession
    kept = rows.filter("`group` is not null and year is not null").withColumn("bucket", T.bucket(F.col("year"), width))
    parts = [clean.scope_filter(kept, scope).withColumn("scope", F.lit(name)).groupBy("scope", "group", "bucket", "llm_label").agg(F.count(F.lit(1)).alias("papers")) for name, scope in scopes.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    folder = shared_dir(spark, "scope-counts")
    whole.join(groups.select("group", "order"), "group").write.parquet(folder)
    counted = spark.read.parquet(folder)  # groups x buckets x topics, however many papers there are
    by_group = counted.groupBy("scope", "group", "order", "bucket").agg(F.sum("papers").alias("freq"))
    by_bucket = by_group.groupBy("scope", "bucket").agg(F.sum("freq").alias("all_"))
    buckets = by_bucket.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("bucket", "all_"))).alias("bs"))
    lists = by_group.groupBy("scope", "group", "order").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "freq"))).alias("m")).join(buckets, "scope")
    at = lambda b: F.coalesce(F.try_element_at("m", b["bucket"]), F.lit(0))
    series = lists.select("scope", "group", "order", F.transform("bs", at).alias("freq"), F.transform("bs", lambda b: at(b) / b["all_"]).alias("share"))
    named = counted.join(by_group, ["scope", "group", "order", "bucket"])
    entry = F.struct((-F.col("papers")).alias("o"), F.coalesce("llm_label", F.lit("")).alias("name"), "papers", F.round(F.col("papers") / F.col("freq"), 4).alias("share"))
    topics = named.groupBy("scope", "group", "bucket").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.dropFields("o")).alias("l"))
    topics = topics.groupBy("scope", "group").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "l"))), lambda e: F.struct(e["bucket"].cast("string"), e["l"]))).alias("topics"))
    rows_ = series.join(topics, ["scope", "group"]).groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("order", "group", "freq", "share"))).alias("g"), F.collect_list(F.struct("group", "topics")).alias("t")).join(buckets, "scope")
    by = lambda name: F.map_from_entries(F.transform("g", lambda x: F.struct(x["group"], x[name]))).alias(name)
    body = F.struct(F.transform("g", lambda x: x["group"]).alias("groups"), F.transform("bs", lambda b: b["bucket"]).alias("buckets"), by("share"), by("freq"), F.map_from_entries("t").alias("topics"))
    return rows_.select("scope", T.escape_script(F.to_json(body)).alias("payload"))


def registry_report(papers: DataFrame, groups: DataFrame, out: str) -> str:
    """The registry of groups with their papers and shares: a CSV below `out`, and the Markdown that is returned."""
    table = review.registry(papers, groups)
    io.write_csv(table, f"{out}/registry")
    return io.markdown(table.select("order", "group", "papers", "share"), ["order", "group"])


def validation_report(ratings: DataFrame, group: str, out: str, by: str = "correct") -> dict[str, DataFrame]:
    """Verdicts per group, and accuracy with its interval: CSV tables below `out`."""
    tables = {"summary": review.summary(ratings, group), "accuracy": review.accuracy(ratings.filter(F.col(by).isin("y", "n")), group, F.col(by) == "y")}
    for name, table in tables.items():
        io.write_csv(table, f"{out}/{name}")
    return tables


def main(argv: list[str] | None = None) -> None:
    """Command line: venue, corpus, select, groups, figures, validate."""
    import argparse

    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="what", required=True)

    def command(name: str, about: str, *names: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for n in names:
            c.add_argument(n)
        return c

    v = command("venue", "clean one venue's slice", "papers", "out")
    v.add_argument("--conf", required=True)
    v.add_argument("--slug", required=True)
    v.add_argument("--include-companion", action="store_true")
    command("corpus", "pool papers with abstracts", "papers", "works", "overrides", "out")
    c = command("select", "choose venues and draw the fit sample", "corpus", "out")
    c.add_argument("--forced", nargs="*", default=[])
    for name, default in (("--min-papers", 50), ("--size", 120_000), ("--cap", 3_000), ("--seed", 42)):
        c.add_argument(name, type=int, default=default)
    c.add_argument("--min-rate", type=float, default=0.5)
    command("groups", "give topics and papers their groups", "topics", "papers", "grouping", "out")
    f = command("figures", "write the tables and payloads of the figures", "papers", "topics", "grouping", "out")
    f.add_argument("--scopes", help="a YAML file of scopes: name to list of venues, or to all")
    r = command("validate", "report on a log of reviews", "log", "out")
    r.add_argument("--group", default="group")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    read = spark.read.parquet
    if a.what == "venue":
        venue(read(a.papers), a.conf, a.slug, a.out, a.include_companion)
    elif a.what == "corpus":
        corpus(read(a.papers), io.read_responses(spark, a.works), io.read_csv(spark, a.overrides, schemas.OVERRIDES), a.out)
    elif a.what == "select":
        rows, report = select_corpus(read(a.corpus), a.forced, a.min_papers, a.min_rate, a.size, a.cap, a.seed)
        overwrite(rows, f"{a.out}/universe")
        io.write_csv(report, f"{a.out}/venues")
    elif a.what == "groups":
        groups, members = io.group_table(spark, io.read_yaml(spark, a.grouping))
        named, papers, _ = apply_groups(read(a.topics), read(a.papers), groups, members)
        overwrite(named, f"{a.out}/topics")
        print(registry_report(overwrite(papers, f"{a.out}/papers"), groups, a.out))
    elif a.what == "figures":
        groups, _ = io.group_table(spark, io.read_yaml(spark, a.grouping))
        papers, named = read(a.papers), read(a.topics)
        for name, table in figures(papers, named).items():
            overwrite(table, f"{a.out}/{name}")
        labelled = papers.join(named.select("topic_id", "llm_label"), "topic_id", "left")
        overwrite(scope_payloads(labelled, groups, io.read_yaml(spark, a.scopes) if a.scopes else {"all": "all"}), f"{a.out}/payloads")
    else:
        validation_report(spark.read.option("header", True).csv(a.log), a.group, a.out)


if __name__ == "__main__":
    main()
