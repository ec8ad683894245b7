"""Time-bucketed analytics: shares, ranks, growth, onset, migration, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, *keys: str, name: str = "papers") -> DataFrame:
    """Group sizes; rows with a null key don't count."""
    return rows.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def labels(counted: DataFrame, label: str, value: str = "papers") -> DataFrame:
    """Distinct labels of a counted table.

    The sum is asked for so that the counts stay in the plan: its shuffle is
    then the one that the other uses of the table have, and rows are read
    once.
    """
    return counted.groupBy(label).agg(F.sum(value).alias("_t")).filter("_t >= 0").select(label)


def dense(counted: DataFrame, row: str, column: str, value: str = "papers") -> DataFrame:
    """Every pair of a row's and a column's distinct values, 0 where there was none.

    Both sides of the product are distinct labels of an already counted table.
    """
    grid = labels(counted, row, value).crossJoin(labels(counted, column, value))
    return grid.join(counted, [row, column], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def shares(counted: DataFrame, *per: str, value: str = "papers", name: str = "share", digits: int = 6) -> DataFrame:
    """Each count over the total of its `per` group (0 for an empty group)."""
    total = F.sum(value).over(Window.partitionBy(*per))
    return counted.withColumn(name, F.round(F.coalesce(F.try_divide(F.col(value), total), F.lit(0.0)), digits))


def rank_per(shared: DataFrame, bucket: str, item: str, value: str = "papers", share: str = "share") -> DataFrame:
    """Rank of items within each bucket by share; ties to the larger item overall, then by name."""
    size = F.sum(value).over(Window.partitionBy(item))
    sized = shared.withColumn("_size", size)
    order = Window.partitionBy(bucket).orderBy(F.desc(share), F.desc("_size"), item)
    return sized.withColumn("rnk", F.row_number().over(order)).drop("_size")


def rank_movement(ranked: DataFrame, bucket: str, item: str) -> DataFrame:
    """First and last rank of each item and the places it climbed."""
    out = ranked.groupBy(item).agg(F.min_by("rnk", bucket).alias("first_rank"), F.max_by("rnk", bucket).alias("last_rank"))
    return out.withColumn("climb", F.col("first_rank") - F.col("last_rank"))


def peak(shared: DataFrame, item: str, bucket: str, share: str = "share") -> DataFrame:
    """The first bucket in which each item's share is greatest."""
    best = Window.partitionBy(item).orderBy(F.desc(share), bucket)
    return shared.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(item, F.col(bucket).alias("peak"), F.col(share).alias("peak_share"))


def top_n(rows: DataFrame, per: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each group, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("place") <= n)


def more_than(rows: DataFrame, per: list[str], n: int, year: str) -> DataFrame:
    """Per group: rows, first and last year, and how many a list of n leaves out."""
    return rows.groupBy(*per).agg(F.count(F.lit(1)).alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year")).withColumn("more", F.greatest(F.col("n") - n, F.lit(0)))


def rollup(rows: DataFrame, *levels: str) -> DataFrame:
    """Totals at every level of a hierarchy, and that of all: level 0 is the root."""
    total = len(levels)
    depth = F.lit(total) - F.bit_count(F.grouping_id())
    return rows.rollup(*levels).agg(F.count(F.lit(1)).alias("papers"), depth.cast("int").alias("level"))


def growth(counted: DataFrame, item: str, start: str, step: int, value: str = "papers", flat: float = 5.0) -> DataFrame:
    """Change of each item's share against exactly `step` years before.

    State: na where the data has no such period, new where the item had no
    share then, else up, down or flat (within `flat` percent).
    """
    shared = shares(counted, start, value=value, digits=12)
    had = labels(counted, start, value).select((F.col(start) + step).alias(start), F.lit(True).alias("_had"))
    before = shared.select(item, (F.col(start) + step).alias(start), F.col("share").alias("_before"))
    out = shared.join(had, start, "left").join(before, [item, start], "left")
    pct = (F.col("share") / F.col("_before") - 1) * 100
    known = F.coalesce(F.col("_before"), F.lit(0.0)) > 0
    state = F.when(F.col("_had").isNull(), "na").when(~known, "new").when(pct > flat, "up").when(pct < -flat, "down").otherwise("flat")
    out = out.withColumns({"state": state, "growth_pct": F.when(known, F.round(pct, 4)), "l2fc": F.when(known, F.round(F.log2(F.col("share") / F.col("_before")), 6))})
    return out.withColumn("share", F.round("share", 6)).drop("_had", "_before")


def came_and_went(counted: DataFrame, item: str, start: str, step: int, value: str = "papers") -> DataFrame:
    """(period, item, change): items without rows in the period before, and items that the period lost."""
    order = Window.partitionBy(item).orderBy(start)
    near = counted.withColumns({"_prev": F.lag(start).over(order), "_next": F.lead(start).over(order)})
    now, following = F.col(start), (F.col(start) + step).cast(counted.schema[start].dataType)
    change = lambda name, at, needs, hit: F.when(hit, F.struct(at.alias("at"), needs.alias("needs"), F.lit(name).alias("change")))
    came = change("emerging", now, now - step, F.coalesce(F.col("_prev") != now - step, F.lit(True)))
    went = change("faded", following, following, F.coalesce(F.col("_next") != following, F.lit(True)))
    both = near.select(item, F.explode(F.filter(F.array(came, went), lambda x: x.isNotNull())).alias("x")).select(item, "x.*")
    return both.join(labels(counted, start, value).withColumnRenamed(start, "needs"), "needs", "left_semi").select(F.col("at").alias(start), item, "change")


def steepest(shared: DataFrame, item: str, period: str, share: str = "share", step: int | None = None) -> DataFrame:
    """Per item the first period of greatest rise against the one present before.

    `before` is that period's share or, with `step`, the share exactly so many
    years earlier (null where there is none).
    """
    order = Window.partitionBy(item).orderBy(period)
    rise = shared.withColumns({"_rise": F.col(share) - F.lag(share).over(order), "_prev": F.lag(share).over(order)}).filter("_rise is not null")
    best = Window.partitionBy(item).orderBy(F.desc(F.round("_rise", 9)), period)
    out = rise.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(item, F.col(period).alias("period"), F.round("_rise", 6).alias("rise"), F.col("_prev").alias("before"), F.col(share).alias("after"))
    if step is None:
        return out
    then = shared.select(item, (F.col(period) + step).alias("period"), F.col(share).alias("_then"))
    return out.drop("before").join(then, [item, "period"], "left").withColumnRenamed("_then", "before")


def onset(counted: DataFrame, item: str, period: str, from_year: int, step: int, value: str = "papers") -> DataFrame:
    """When each item (or list of topics under one name) rose most, from a year on."""
    return steepest(shares(counted, period, value=value, digits=9).filter(F.col(period) >= from_year), item, period, step=step)


def inflection(counted: DataFrame, item: str, period: str, least: int, value: str = "papers") -> DataFrame:
    """As steepest, over periods of at least `least` rows in all."""
    big = counted.groupBy(period).agg(F.sum(value).alias("_n")).filter(F.col("_n") >= least)
    return steepest(shares(counted.join(big, period, "left_semi"), period, value=value, digits=9), item, period)


def selector_shares(rows: DataFrame, period: str, selectors: dict[str, object], digits: int = 9) -> DataFrame:
    """(name, period, papers, share) of each selector (a condition) over all rows of each period, in one pass; 0 where none match."""
    names = list(selectors)
    total = rows.filter(F.col(period).isNotNull()).groupBy(period).agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, c in enumerate(selectors.values())))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("papers")) for i, n in enumerate(names)))).alias("s")
    return total.select(period, "_n", each).select("s.name", period, "s.papers", F.round(F.col("s.papers") / F.col("_n"), digits).alias("share"), F.col("_n").alias("total"))


def milestones(rows: DataFrame, period: str, selectors: dict[str, object], from_year: int, step: int) -> DataFrame:
    """When each selector (a theme, or a list of topics) rose most, among all rows of a period."""
    shared = selector_shares(rows, period, selectors).filter(F.col(period) >= from_year)
    return steepest(shared, "name", period, step=step)


def stack(shared: DataFrame, bucket: str, order: str, share: str = "share") -> DataFrame:
    """Where each item's band begins when shares are stacked."""
    below = Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return shared.withColumn("base", F.round(F.coalesce(F.sum(share).over(below), F.lit(0.0)), 6))


def dominant(rows: DataFrame, who: str, bucket: str, topic: str, least: int = 1) -> DataFrame:
    """Each person's commonest topic per window; ties to the least topic."""
    n = counts(rows, who, bucket, topic, name="n").filter(F.col("n") >= least)
    best = Window.partitionBy(who, bucket).orderBy(F.desc("n"), topic)
    return n.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(who, bucket, topic, "n")


def migration(main: DataFrame, who: str, bucket: str, topic: str, step: int, least: int = 2) -> DataFrame:
    """(bucket, src, tgt, people) of those with a topic in a window and in the one right after; flows of fewer than `least` go."""
    after = main.select(who, (F.col(bucket) - step).alias(bucket), F.col(topic).alias("tgt"))
    flows = main.select(who, bucket, F.col(topic).alias("src")).join(after, [who, bucket])
    return flows.groupBy(bucket, "src", "tgt").agg(F.count(F.lit(1)).alias("people")).filter(F.col("people") >= least)


def net_flow(flows: DataFrame, bucket: str, least: int = 5) -> DataFrame:
    """Per window and topic: people who came, left and stayed, the net, the node's size, and loyalty where enough began there."""
    moved = F.col("src") != F.col("tgt")
    out = flows.groupBy(bucket, F.col("src").alias("topic")).agg(F.sum(F.when(moved, F.col("people")).otherwise(0)).alias("outflow"), F.sum(F.when(~moved, F.col("people")).otherwise(0)).alias("stayed"))
    into = flows.groupBy(bucket, F.col("tgt").alias("topic")).agg(F.sum(F.when(moved, F.col("people")).otherwise(0)).alias("inflow"), F.sum("people").alias("_in"))
    both = out.join(into, [bucket, "topic"], "full").na.fill(0, ["outflow", "stayed", "inflow", "_in"])
    began = F.col("outflow") + F.col("stayed")
    return both.select(bucket, "topic", "inflow", "outflow", "stayed", (F.col("inflow") - F.col("outflow")).alias("net"), F.greatest(began, F.col("_in")).alias("node"), F.when(began >= least, F.round(F.col("stayed") / began, 6)).alias("loyalty"))


def citation_panel(rows: DataFrame, per: list[str], cites: str) -> DataFrame:
    """Median, mean, total, share uncited and h-index of a group's citations; nulls count in n alone.

    All come from the counts of rows by group and number of citations, so no
    group's rows meet in one task.
    """
    return _panel(rows.groupBy(*per, F.col(cites).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), per)


def _panel(counted: DataFrame, per: list[str]) -> DataFrame:
    """citation_panel from rows (per, _v citations, _n rows)."""
    known = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    up = Window.partitionBy(*per).orderBy(F.col("_v").asc_nulls_first())
    placed = counted.withColumns({"_upto": F.sum(known).over(up), "_all": F.sum(known).over(Window.partitionBy(*per))})
    at = lambda place: F.max(F.when((F.col("_upto") - known <= place) & (place < F.col("_upto")), F.col("_v")))
    middle = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
    total = F.sum(F.col("_v") * F.col("_n"))
    return placed.groupBy(*per).agg(
        F.sum("_n").alias("n"),
        F.round(middle.cast("double"), 6).alias("median_cites"),
        F.round(F.try_divide(total, F.sum(known)), 6).alias("mean_cites"),
        total.alias("total_cites"),
        F.round(F.try_divide(F.sum(F.when(F.col("_v") == 0, F.col("_n")).otherwise(0)), F.sum(known)), 6).alias("uncited"),
        F.max(F.when(F.col("_v").isNotNull(), F.least(F.col("_all") - F.col("_upto") + known, F.col("_v").cast("long")))).alias("h_index"),
    )


def _at_every_level(counted: DataFrame, levels: list[str], keep: list[str]) -> DataFrame:
    """Counts (levels, keep, _n) summed for the whole (_level 0), the first level, the first two, and so on; levels below are null."""
    sets = [[*levels[:i], *keep] for i in range(len(levels) + 1)]
    # One bit for each grouping column, the first the highest: set where it is summed over.
    gid = F.grouping_id(*levels, *keep)
    summed = counted.groupingSets([[F.col(c) for c in s] for s in sets], *levels, *keep).agg(F.sum("_n").alias("_n"), gid.alias("_g"))
    level = F.lit(0)
    for i in range(len(levels) + 1):
        open_bits = sum(1 << (len(levels) + len(keep) - 1 - j) for j in range(i, len(levels)))
        level = F.when(F.col("_g") == open_bits, i).otherwise(level)
    return summed.withColumn("_level", level.cast("int")).drop("_g")


def impact_panel(rows: DataFrame, levels: list[str], cites: str, authors: str | None = None, k: int = 5) -> DataFrame:
    """citation_panel of the whole, and of each group at every level: (level, levels ..., statistics), levels below null.

    `rows` are counted once by all levels and citations; one pass of grouping
    sets over these counts gives all levels.  With `authors`, a column of
    lists, top_authors has the `k` names of most rows of each group (ties: by
    name; a row counts once for a name), also from counts; each task passes on
    `k` names of a group at most.
    """
    per = ["_level", *levels]
    counted = rows.groupBy(*levels, F.col(cites).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    panel = _panel(_at_every_level(counted, levels, ["_v"]), per)
    if authors:
        names = rows.select(*levels, F.explode(F.array_distinct(authors)).alias("_a")).filter("_a is not null")
        by = _at_every_level(names.groupBy(*levels, "_a").agg(F.count(F.lit(1)).alias("_n")), levels, ["_a"])
        best = by.withColumn("_k", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("_n"), "_a"))).filter(F.col("_k") <= k)
        lists = best.groupBy(*per).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_a"))), lambda s: s["_a"]).alias("top_authors"))
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in per]  # a level's own null is a group too
        joined = panel.alias("p").join(lists.alias("l"), same, "left")
        panel = joined.select("p.*", F.coalesce("l.top_authors", F.array().cast("array<string>")).alias("top_authors"))
    return panel.withColumnRenamed("_level", "level")


def number_by_size(counted: DataFrame, item: str, value: str) -> DataFrame:
    """Items numbered from 0, the largest first; ties by name.  One row per item comes in."""
    return counted.withColumn("topic_id", F.row_number().over(Window.orderBy(F.desc(value), item)) - 1)
