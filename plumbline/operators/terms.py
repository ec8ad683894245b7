"""Term tables: counts, class-based TF-IDF, word overlap, coherence, turnover."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions import text as T
from plumbline.storage import shared_dir


def doc_terms(docs: DataFrame, id_column: str, text: str, keep: list[str] | None = None, pattern: str = T.ALPHA_WORD, stop: list[str] | None = None, lemmatize: bool = False) -> DataFrame:
    """(id, kept columns, term, tf): how often each term is in each document."""
    words = T.tokens(F.col(text), pattern)
    words = T.lemmas(words) if lemmatize else words
    rows = docs.select(id_column, *(keep or []), F.explode(words).alias("term"))
    if stop:
        rows = rows.filter(~F.col("term").isin(*stop))
    return rows.groupBy(id_column, *(keep or []), "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(terms: DataFrame, min_df: int, max_features: int | None = None) -> DataFrame:
    """(term, df, total) of terms in at least min_df documents; of these the most frequent."""
    v = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    return v.orderBy(F.desc("total"), "term").limit(max_features) if max_features else v


def class_counts(terms: DataFrame, cls: list[str], min_df: int) -> DataFrame:
    """(class, term, n) over terms in at least min_df documents.

    Terms are summed by class first; the document frequency is then a window
    over a term's few classes, and both share one shuffle with what follows.
    """
    by = terms.groupBy(*cls, "term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("_df"))
    kept = by.withColumn("df", F.sum("_df").over(Window.partitionBy("term"))).filter(F.col("df") >= min_df)
    return kept.select(*cls, "term", "n")


def _weighted(counts: DataFrame, cls: list[str]) -> DataFrame:
    per_class = counts.groupBy(*cls).agg(F.sum("n").alias("_c"))
    whole = per_class.agg((F.sum("_c") / F.count(F.lit(1))).alias("_a"))  # one row
    idf = F.log1p(F.col("_a") / F.col("_f"))
    # A class may hold a third of all terms: its total comes by a join, not by a window over it.
    by_term = counts.withColumn("_f", F.sum("n").over(Window.partitionBy("term")))
    return by_term.join(per_class, cls).crossJoin(F.broadcast(whole)).select(*cls, "term", "n", idf.alias("idf"), (F.col("n") / F.col("_c") * idf).alias("w"))


def class_tfidf(counts: DataFrame, cls: list[str]) -> DataFrame:
    """(class, term, n, w): share within the class times ln(1 + mean tokens per class / tokens of the term)."""
    return _weighted(counts, cls).drop("idf")


def topic_scores(terms: DataFrame, id_column: str, topic: str, outlier) -> DataFrame:
    """(id, topic, score) of each outlier document and each topic that shares a term with it.

    The score is the cosine of the document's weights (tf times the term's
    factor of class_tfidf) and the topic's, but for the document's own length,
    which is the same for all topics; it counts to 9 places.  The weights of a
    term come as one list, of at most as many entries as there are topics, so
    a document's terms join it once.
    """
    weights = _weighted(class_counts(terms, [topic], 1), [topic]).filter(F.col(topic) != outlier)
    lengths = weights.filter(F.col(topic).isNotNull()).groupBy(topic).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    packed = weights.groupBy("term").agg(F.max("idf").alias("idf"), F.collect_list(F.struct(topic, "w")).alias("_ws"))
    met = terms.filter(F.col(topic) == outlier).select(id_column, "term", "tf").join(packed, "term")
    parts = met.select(id_column, (F.col("tf") * F.col("idf")).alias("_x"), F.explode("_ws").alias("_s"))
    dots = parts.groupBy(id_column, F.col(f"_s.{topic}").alias(topic)).agg(F.sum(F.col("_x") * F.col("_s.w")).alias("_d"))
    return dots.join(lengths, topic).select(id_column, topic, F.round(F.col("_d") / F.col("_l"), 9).alias("score"))


def reduce_outliers(rows: DataFrame, terms: DataFrame, id_column: str, topic: str, outlier) -> DataFrame:
    """`rows` (id, topic) with outliers moved to the topic of greatest score, ties to the least; `share` is its part of the document's scores.

    An outlier that shares no term with any topic stays one.  Other rows keep
    their topic, and have no share.
    """
    scores = topic_scores(terms, id_column, topic, outlier)
    whole = Window.partitionBy(id_column)
    ranked = scores.withColumns({"share": F.try_divide("score", F.sum("score").over(whole)), "_n": F.row_number().over(whole.orderBy(F.desc("score"), topic))})
    best = ranked.filter("_n = 1").select(id_column, F.col(topic).alias("_best"), "share")
    moved = F.when(F.col(topic) == outlier, F.coalesce("_best", F.col(topic))).otherwise(F.col(topic))
    return rows.drop("share").join(best, id_column, "left").withColumn(topic, moved).drop("_best")


#: Numbers of a table of terms by topics that a task holds at a time (8 bytes each).
TOPIC_CELLS = 4_000_000
#: Terms that go to every task, the most frequent ones; and words that a group of texts brings to the others, at most.
COMMON_TERMS, GROUP_WORDS = 200_000, 200_000


def _window_sums(ids: np.ndarray, idf: np.ndarray, table: np.ndarray, starts: np.ndarray, size: int, least: float) -> np.ndarray:
    """Sum over the windows of `size` words that begin at `starts` of each topic's cosine; running sums over the words give all windows at once."""
    total = np.zeros(table.shape[1])
    for a in range(0, len(starts), 8192):  # bounded numbers of windows at a time
        some = starts[a : a + 8192]
        mine = ids[some[0] : some[-1] + size]
        at = some - some[0]
        w = np.where(mine >= 0, idf[mine], 0.0)
        dots = np.vstack([np.zeros(table.shape[1]), np.cumsum(np.where(mine[:, None] >= 0, w[:, None] * table[mine], 0.0), axis=0)])
        square = np.r_[0.0, np.cumsum(w * w)]
        norm = square[at + size] - square[at]
        for gap in range(1, size):  # a word that is in a window more than once
            twice = np.r_[0.0, np.cumsum(np.where(mine[:-gap] == mine[gap:], w[gap:] ** 2, 0.0))]
            norm += 2 * (twice[at + size - gap] - twice[at])
        some_known = norm > 1e-18
        cos = (dots[at + size] - dots[at])[some_known] / np.sqrt(norm[some_known])[:, None]
        cos = np.round(cos, 9)
        total += np.where(cos >= least, cos, 0.0).sum(axis=0)
    return total


def _frequent(terms: DataFrame, most: int) -> DataFrame:
    """The terms of least idf, at most so many and all that have the same one to 2 places, by counts for each of these."""
    step = F.floor(F.col("idf") * 100)
    counts = sorted(map(tuple, terms.groupBy(step.alias("step")).count().collect()))
    n, last = 0, None
    for at, count in counts:
        n += count
        if n > most:
            break
        last = at
    return terms.filter(step <= last) if last is not None else terms.limit(0)


def _place_terms(lists: pa.Array, rows: np.ndarray, table: np.ndarray) -> None:
    """Lists of (topic number, weight) into rows of a table."""
    flat = lists.flatten()
    table[np.repeat(rows, pc.list_value_length(lists).to_numpy(zero_copy_only=False)), flat.field("t").to_numpy()] = flat.field("x").to_numpy()


def window_shares(docs: DataFrame, id_column: str, text: str, weights: DataFrame, topic: str, window: int = 4, stride: int = 1, least: float = 0.1, pattern: str = T.ALPHA_WORD, cells: int = TOPIC_CELLS, common: int = COMMON_TERMS) -> DataFrame:
    """(id, topic, share): how far each topic is what a text is about, window by window; the shares of a text sum to 1.

    `weights` is (topic, term, idf, w), as topic_weights makes it.  A window of
    `window` words (the whole text, if it has fewer) has the cosine of its own
    counts times idf and each topic's weights; cosines below `least` are
    nothing, the others are summed over all windows, `stride` words apart.
    Texts of which no window is like any topic have no rows; repeated rows have
    their own.

    The most frequent terms, at most `common` and as few as keep to `cells`
    numbers, go to every task, which sums the windows that have no others.
    The words of the other windows are written, texts in groups of bounded
    size; the rest of the vocabulary comes to these by joins on the term, so
    no task and not the driver holds more of it than one group's words.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "window-shares")
    weights.write.parquet(f"{folder}/weights")
    weights = spark.read.parquet(f"{folder}/weights")
    lengths = weights.filter(F.col(topic).isNotNull()).groupBy(topic).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l")).filter("_l > 0").orderBy(topic).toArrow()
    names = lengths.column(topic).to_pylist()
    n_topics = len(names)
    place = F.array_position(F.array(*map(F.lit, names)), F.col(topic)).cast("int") - 1 if names else F.lit(-1)
    length = F.get(F.array(*map(F.lit, lengths.column("_l").to_pylist())), F.col("t")) if names else F.lit(1.0)
    numbered = weights.withColumn("t", place)
    on = F.collect_list(F.when(F.col("t") >= 0, F.struct("t", (F.col("w") / length).alias("x"))))
    numbered.groupBy("term").agg(F.max("idf").alias("idf"), on.alias("xs")).write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    most = min(common, cells // max(1, n_topics))
    first = _frequent(terms, most).toArrow().combine_chunks()
    known_table = np.zeros((first.num_rows + 1, n_topics))  # the last row is that of unknown words
    if first.num_rows:
        _place_terms(first.column("xs").combine_chunks(), np.arange(first.num_rows), known_table)
    known = spark.sparkContext.broadcast((first.column("term").combine_chunks(), np.r_[first.column("idf").to_numpy(), 0.0], known_table))
    per_group = max(1, min(GROUP_WORDS, cells // max(1, n_topics)))

    words = docs.select(F.col(id_column), T.tokens(F.col(text), pattern).alias("_words"))
    half = words.select(id_column).withColumns({"_sums": F.array().cast("array<double>"), "_group": F.lit(None).cast("long"), "_n": F.lit(0), "_at": F.array().cast("array<int>"), "_ids": F.array().cast("array<int>"), "_rare": F.array().cast("array<string>")})
    half_schema = half.schema

    def frequent_alone(batches):
        """Each text's sums over windows of frequent terms; of the others the words: their places, their numbers or -1, and what those are."""
        (names_, idf, table), arrow = known.value, to_arrow_schema(half_schema)
        base, n_groups, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            found = pc.index_in(flat, value_set=names_).fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            out = {c: [] for c in ("sums", "group", "n", "at", "ids", "rare")}
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                ids = found[a:b]
                n = b - a
                size = min(window, n)
                starts = np.arange(0, n - size + 1, stride) if n else np.zeros(0, np.int64)
                unknown = np.r_[0, np.cumsum(ids < 0)]
                open_ = unknown[starts + size] > unknown[starts]
                total = np.zeros(n_topics)
                for i in range(0, len(starts), 8192):  # near ones together, also where few are left
                    part = starts[i : i + 8192]
                    total += _window_sums(ids, idf, table, part[~open_[i : i + 8192]], size, least)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, starts[open_], 1)
                np.add.at(edge, starts[open_] + size, -1)
                at = np.flatnonzero(np.cumsum(edge)[:-1])
                if len(at):
                    if held and held + len(at) > per_group:
                        n_groups, held = n_groups + 1, 0
                    held += len(at)
                out["sums"].append(np.round(total, 9).tolist())
                out["group"].append(base + n_groups if len(at) else None)
                out["n"].append(n)
                out["at"].append(at.astype(np.int32))
                out["ids"].append(ids[at].astype(np.int32))
                out["rare"].append(flat.take(pa.array(a + at[ids[at] < 0])).to_pylist())
            columns = [pa.array(x, field.type) for x, field in zip(out.values(), list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    words.mapInArrow(frequent_alone, half_schema).write.parquet(f"{folder}/half")
    half = spark.read.parquet(f"{folder}/half")
    left = half.filter("_group IS NOT NULL")
    asked = left.select(F.col("_group").alias("_asks"), F.explode(F.array_distinct("_rare")).alias("term")).distinct()
    answers = asked.join(terms, "term").select("_asks", "term", "idf", "xs")

    def rest(texts: pa.Table, found: pa.Table) -> pa.Table:
        """The sums of a group's texts, with those over the windows that wait for other terms."""
        names_, idf, table = known.value
        n_known, n_found = len(names_), found.num_rows
        more = np.zeros((n_found + 1, n_topics))
        if n_found:
            _place_terms(found.column("xs").combine_chunks(), np.arange(n_found), more)
        table = np.vstack([table[:-1], more])
        idf = np.r_[idf[:-1], found.column("idf").to_numpy(), 0.0]
        number = {t: n_known + i for i, t in enumerate(found.column("term").to_pylist())}
        out = []
        for sums, n, at, ids, rare in zip(*(texts.column(c).to_pylist() for c in ("_sums", "_n", "_at", "_ids", "_rare")), strict=True):
            at, ids = np.array(at), np.array(ids, dtype=np.int64)
            size = min(window, n)
            waits = ids < 0
            ids[waits] = [number.get(w, -1) for w in rare]
            # Windows whose words are all here, and one of them a word that was waited for.
            i = np.flatnonzero((at % stride == 0) & (at <= n - size))
            i = i[i + size <= len(at)]
            i = i[at[i + size - 1] - at[i] == size - 1]
            before = np.r_[0, np.cumsum(waits)]
            i = i[before[i + size] > before[i]]
            out.append(np.round(np.array(sums) + _window_sums(ids, idf, table, i, size, least), 9).tolist())  # sums of numbers of 9 places
        return pa.table({id_column: texts.column(id_column), "_sums": pa.array(out, pa.list_(pa.float64()))})

    done = half.filter("_group IS NULL").select(id_column, "_sums")
    frame = done.unionByName(left.groupBy("_group").cogroup(answers.groupBy("_asks")).applyInArrow(rest, done.schema))
    topics = F.array(*map(F.lit, names)) if names else F.array().cast(f"array<{docs.schema[topic].dataType.simpleString()}>" if topic in docs.columns else "array<string>")
    whole = F.aggregate("_sums", F.lit(0.0), lambda s, x: s + x)
    rows = frame.withColumn("_all", whole).filter("_all > 0").select(id_column, "_all", F.explode(F.arrays_zip(topics.alias("topic"), F.col("_sums").alias("sum"))).alias("s"))
    return rows.filter("s.sum > 0").select(id_column, F.col("s.topic").alias(topic), (F.col("s.sum") / F.col("_all")).alias("share"))


def topic_weights(terms: DataFrame, topic: str, outlier=None, min_df: int = 1) -> DataFrame:
    """(topic, term, idf, w) of class_tfidf with the terms' own factor; the outliers' terms count for that factor alone."""
    weights = _weighted(class_counts(terms, [topic], min_df), [topic]).select(topic, "term", "idf", "w").filter(F.col(topic).isNotNull())
    return weights if outlier is None else weights.filter(F.col(topic) != outlier)


def top_terms(weights: DataFrame, cls: list[str], k: int, digits: int = 9) -> DataFrame:
    """The k terms of largest positive weight of each class, with rank; weights count to `digits` places, ties by name."""
    rounded = weights.withColumn("w", F.round("w", digits)).filter("w > 0")
    order = Window.partitionBy(*cls).orderBy(F.desc("w"), "term")
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def word_lists(top: DataFrame, cls: list[str], as_text: bool = False) -> DataFrame:
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"])
    return top.groupBy(*cls).agg((F.array_join(words, ", ") if as_text else words).alias("top_words"))


def topic_diversity(top: DataFrame) -> DataFrame:
    """Different words over all words of the topics' lists."""
    return top.agg(F.count(F.lit(1)).alias("n_words"), F.countDistinct("term").alias("n_unique")).withColumn("diversity", F.round(F.try_divide(F.col("n_unique"), F.col("n_words")), 6))


def jaccard_pairs(top: DataFrame, topic: str) -> DataFrame:
    """(a, b, shared, jaccard) of topics a < b that share a word: an inverted-index join on the word."""
    words = top.select(F.col(topic), "term").distinct()
    sizes = words.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    pairs = words.withColumnRenamed(topic, "a").join(words.withColumnRenamed(topic, "b"), "term").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    both = pairs.join(sizes.select(F.col(topic).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(topic).alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def cooccurrence(terms: DataFrame, id_column: str, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document frequency (term, df), and pairs (w1 < w2, co), of the given words alone.

    Documents are cut to these words before the self-join.
    """
    used = terms.select(id_column, "term").join(F.broadcast(words.select("term").distinct()), "term").distinct()
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    pairs = used.withColumnRenamed("term", "w1").join(used.withColumnRenamed("term", "w2"), id_column).filter("w1 < w2").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("co"))
    return df, pairs


def cooccurrence_in_texts(docs: DataFrame, text: str, words: DataFrame, pattern: str = T.ALPHA_WORD) -> tuple[DataFrame, DataFrame]:
    """As `cooccurrence`, from texts: each row is cut to the given words before anything is made of it, so only these are shuffled.

    `words` are few: the lists of topics, which go to every task as one array.
    Each row is a document of its own, also where ids repeat.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "cooccurrence")
    known = words.agg(F.array_sort(F.collect_set("term")).alias("_known"))
    docs.select(F.col(text).alias("_text")).crossJoin(F.broadcast(known)).select(F.array_sort(F.array_intersect(T.tokens(F.col("_text"), pattern), F.col("_known"))).alias("ws")).filter("size(ws) > 0").write.parquet(folder)
    used = spark.read.parquet(folder)
    df = used.select(F.explode("ws").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    two = F.flatten(F.transform("ws", lambda w, i: F.transform(F.slice("ws", i + 2, F.greatest(F.size("ws") - i - 1, F.lit(0))), lambda v: F.struct(w.alias("w1"), v.alias("w2")))))
    pairs = used.select(F.explode(two).alias("p")).groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("co"))
    return df, pairs


def coherence(top: DataFrame, topic: str, df: DataFrame, pairs: DataFrame, n_docs: DataFrame) -> DataFrame:
    """NPMI and UMass of each topic: means over its word pairs.

    Words that no document has are left out; a pair that never meets counts
    -1, one that is in every document 1 (the limit).  Topics of fewer than two
    words have no value.
    """
    w = top.select(topic, "term", "rank").join(df, "term")
    pair = w.select(topic, F.col("term").alias("t1"), F.col("rank").alias("r1"), F.col("df").alias("d1")).join(w.select(topic, F.col("term").alias("t2"), F.col("rank").alias("r2"), F.col("df").alias("d2")), topic).filter("r1 < r2")
    keyed = pair.withColumns({"w1": F.least("t1", "t2"), "w2": F.greatest("t1", "t2")}).join(pairs, ["w1", "w2"], "left").withColumn("co", F.coalesce("co", F.lit(0))).crossJoin(F.broadcast(n_docs))
    p1, p2, p12 = F.col("d1") / F.col("n_docs"), F.col("d2") / F.col("n_docs"), F.col("co") / F.col("n_docs")
    npmi = F.when(F.col("co") == 0, -1.0).when(F.col("co") == F.col("n_docs"), 1.0).otherwise((F.log2(p12) - F.log2(p1) - F.log2(p2)) / -F.log2(p12))
    umass = F.log((F.col("co") + 1) / F.greatest(F.col("d1"), F.lit(1)))
    return keyed.groupBy(topic).agg(F.round(F.avg(npmi), 6).alias("npmi"), F.round(F.avg(umass), 6).alias("umass"))


def turnover(lists: DataFrame, topic: str, window: str, words: str = "words") -> DataFrame:
    """Change of each topic's words against its latest earlier window: 1 - shared / all, and which came and went."""
    before = F.lag(words).over(Window.partitionBy(topic).orderBy(window))
    since = F.lag(window).over(Window.partitionBy(topic).orderBy(window))
    out = lists.withColumns({"_before": before, "since": since}).filter("_before is not null")
    now, old = F.col(words), F.col("_before")
    share = 1 - F.size(F.array_intersect(now, old)) / F.size(F.array_union(now, old))
    return out.select(topic, "since", window, F.round(share, 6).alias("turnover"), F.array_join(F.array_except(now, old), ",").alias("entered"), F.array_join(F.array_except(old, now), ",").alias("dropped"))


def number_repeats(labels: DataFrame, label: str, order: str) -> DataFrame:
    """A label met before gets its number: X, X (2), X (3)."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return labels.withColumn("shown", F.when(n == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" ("), n.cast("string"), F.lit(")"))))


def merge_similar(pairs: DataFrame, least: float = 0.15) -> DataFrame:
    """(node, root) of topics joined by pairs of at least this overlap."""
    from plumbline.operators.graph import components

    return components(pairs.filter(F.col("jaccard") >= least))


def fallback_label(words: Column, n: int = 3) -> Column:
    return F.initcap(F.array_join(F.slice(words, 1, n), " "))
