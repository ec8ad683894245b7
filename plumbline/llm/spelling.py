"""Spelling variants: words one edit apart, by a rare-first prefix filter over positional bigrams.

One edit touches at most two bigrams of a word.  So of two words one edit
apart, any three bigrams of the one hold one that the edit left alone; with
bigrams in one global order (rarest first, then by name and place) the first
such bigram is among the first three of both words, at the same place, or one
further on in a word that is a letter longer.  Each word is listed under its
three rarest bigrams alone.  As the edit is on one side of the bigram, what
stands on the other side is the same in both, and goes into the key with the
place; so a list stays short however many words share a bigram.  Pairs that
meet are verified.

All steps are DataFrame expressions.  Words are counted with partial
aggregation, so a frequent word is no hot group; what is joined is the
vocabulary, whose rarest bigrams are short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.storage import shared_dir

#: Bigrams that one edit touches at most, and one more.
PREFIX = 3
#: Hash buckets in which bigrams are counted.
BUCKETS = 1 << 14
#: How often a root's chain doubles at most: each form is `ratio` times as frequent as its word, so 2**5 steps of ten are beyond any count.
DOUBLINGS = 6
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _shortened(doc_id: Column, word: Column, one_in: int) -> Column:
    """The word, or without one letter where the checksum of id and word is a multiple of `one_in`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.char_length(word)).cast("int")
    cut = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return F.when(h % one_in == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_length: int = 7, least: int = 2, one_in: int | None = None) -> DataFrame:
    """(word, n) of the words (runs of Latin letters, A-Z lower-cased) of at least `least_length` letters that occur `least` times or more.

    With `one_in`, misspellings are planted first: see _shortened.  Runs too
    short to count are not made into rows.  Null and empty texts have no words.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    words = docs.select(F.col(id_column).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("word"))
    if one_in:
        words = words.select(_shortened(F.col("id"), F.col("word"), one_in).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _rare(words: DataFrame) -> DataFrame:
    """(w, len, rare): each word with its `PREFIX` rarest bigrams as (gram, p), p from 0.

    The order is by frequency, then by bigram and place.  Frequencies are those
    of BUCKETS hash buckets, so the table of them is of one size whatever the
    alphabet; any fixed order is right.
    """
    spark = words.sparkSession
    bucket = lambda gram: F.pmod(F.hash(gram), F.lit(BUCKETS))
    grams = lambda w, n: F.transform(F.sequence(F.lit(1), n - 1), lambda p: F.substr(w, p, F.lit(2)))
    counts = words.select(F.explode(grams(F.col("w"), F.col("len"))).alias("gram")).groupBy(bucket(F.col("gram")).alias("id")).agg(F.count(F.lit(1)).alias("f"))
    dense = spark.range(BUCKETS).join(F.broadcast(counts), "id", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("f", F.lit(0)).alias("f")))), lambda s: s["f"]).alias("fs"))  # one row
    ordered = F.array_sort(F.transform(F.col("_grams"), lambda g, i: F.struct(F.get("fs", bucket(g)).alias("f"), g.alias("gram"), i.alias("p"))))
    return words.withColumn("_grams", grams(F.col("w"), F.col("len"))).crossJoin(F.broadcast(dense)).select("w", "len", F.transform(F.slice(ordered, 1, PREFIX), lambda s: s["p"]).alias("rare"))


def _keys(longer: bool) -> Column:
    """For each rare bigram of a word, hashes of what stays the same if one edit is made elsewhere.

    The edit is on one side of the bigram; the other side is the same.  Where
    that is no more than half the word, so is one half of the edited side.
    Keys hold the places, counted in the shorter word: a word joins as itself,
    or (`longer`) as one that is a letter longer than its partner.
    """
    w, size = F.col("w"), F.col("len")
    n = size - 1 if longer else size
    enough = F.floor((n + 1) / 2) + 1
    sub = lambda start, count: F.substr(w, (start + 1).cast("int"), count.cast("int"))  # noqa: E731  # from 0

    def of(p: Column) -> Column:
        before, after = p + 2, size - p  # letters up to the end of the bigram, and from its begin
        right, left = n - before, n - after  # letters beside it, in the shorter word
        key = lambda place, kind, *parts: F.xxhash64(n, place, F.lit(kind), *parts)
        h = F.floor(right / 2)
        edit_right = F.when(before >= enough, F.array(key(p, 0, sub(F.lit(0), before)))).otherwise(F.array(key(p, 1, sub(F.lit(0), before + h)), key(p, 2, sub(F.lit(0), before), sub(size - (right - h), right - h))))
        k = F.floor(left / 2)
        edit_left = F.when(after >= enough, F.array(key(left, 3, sub(p, after)))).otherwise(F.array(key(left, 4, sub(F.lit(0), k), sub(p, after)), key(left, 5, sub(p - (left - k), after + left - k))))
        none = F.array().cast("array<bigint>")
        return F.concat(F.when(right >= 0, edit_right).otherwise(none), F.when(left >= 0, edit_left).otherwise(none))

    return F.array_distinct(F.flatten(F.transform("rare", of)))


def near_pairs(words: DataFrame, word: str = "word") -> DataFrame:
    """(a, b) of all words one edit apart, each pair once (a is the shorter, or of equal length the lesser).

    Words of fewer than four letters, which may share no bigram with a near
    one, are left out.
    """
    folder = shared_dir(words.sparkSession, "spelling")
    _rare(words.select(F.col(word).alias("w"), F.char_length(word).alias("len")).filter("len >= 4").distinct()).write.parquet(folder)
    rare = words.sparkSession.read.parquet(folder)
    own = rare.select("w", "len", F.explode(_keys(False)).alias("key"))
    longer = rare.select("w", "len", F.explode(_keys(True)).alias("key"))
    left = own.select("key", F.col("w").alias("a"), F.col("len").alias("la"))
    right = own.unionByName(longer).select("key", F.col("w").alias("b"), F.col("len").alias("lb"))
    met = left.join(right, "key").filter(((F.col("lb") == F.col("la")) & (F.col("a") < F.col("b"))) | (F.col("lb") == F.col("la") + 1))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words with their counts.

    A word's form is the most frequent word one edit from it (ties: the first
    in code-point order) if it is at least `ratio` times as frequent, else
    null; its root is the last of the chain of forms, or itself.
    """
    spark = words.sparkSession
    folder = shared_dir(spark, "spelling-forms")
    words.select("word", "n").write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    best = F.min(F.struct((-F.col("near_n")).alias("o"), "near"))
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = F.expr(f"-best.o div {int(ratio)}") >= F.col("n")
    words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.o")).alias("form_n")).write.parquet(f"{folder}/forms")
    found = spark.read.parquet(f"{folder}/forms")
    step = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for k in range(DOUBLINGS):
        step.write.parquet(f"{folder}/roots-{k}")
        step = spark.read.parquet(f"{folder}/roots-{k}")
        on = step.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        if step.join(on, "root", "left_semi").isEmpty():
            break
        step = step.join(on, "root", "left").select("word", F.coalesce("_further", "root").alias("root"))
    return found.join(step, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_length: int = 7, least: int = 2, ratio: int = 10, one_in: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of whole texts; see word_counts and forms.

    Rows that repeat count as often as they are there; null texts have no
    words, an empty table gives an empty one, and other columns don't matter.
    """
    return forms(word_counts(docs, id_column, text, least_length, least, one_in), ratio).select("word", "form", "root", "n", "n_near", "form_n")
