"""Matching and enrichment joins: fallback lookups, fuzzy titles, overrides, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`; rows without key go."""
    return rows.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def works(responses: DataFrame) -> DataFrame:
    """One row per work of JSON responses (column results), with text rebuilt from its inverted index."""
    w = responses.select(F.explode("results").alias("w"))
    return w.select(
        F.col("w.id").alias("openalex_id"),
        T.normalize_doi(F.col("w.doi")).alias("doi"),
        F.col("w.display_name").alias("title"),
        F.col("w.publication_year").alias("year"),
        T.inverted_index_text(F.col("w.abstract_inverted_index")).alias("abstract"),
        T.strong_concepts(F.col("w.concepts")).alias("oa_concepts"),
        F.col("w.cited_by_count").alias("citation_count"),
        F.col("w.type").alias("oa_type"),
    )


def enrich_by_doi(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Left join on DOI, which null never matches; misses get no concepts."""
    extra = ["abstract", "oa_concepts", "citation_count", "openalex_id", "oa_type"]
    one = latest(found, "doi", [F.col("openalex_id").asc_nulls_last()]).select("doi", *extra)
    out = papers.drop(*extra).join(one, "doi", "left")
    return out.withColumn("oa_concepts", F.coalesce("oa_concepts", F.array().cast("array<string>")))


def with_fallback(papers: DataFrame, first: DataFrame, second: DataFrame, first_key: str, second_key: str, value: str = "abstract") -> DataFrame:
    """The value by the first key or, where that is missing or empty, by the second."""
    a = latest(first, first_key, [F.col(value).asc_nulls_last()]).select(first_key, F.col(value).alias("_a"))
    b = latest(second, second_key, [F.col(value).asc_nulls_last()]).select(second_key, F.col(value).alias("_b"))
    out = papers.drop(value).join(a, first_key, "left").join(b, second_key, "left")
    return out.withColumn(value, F.coalesce(F.nullif("_a", F.lit("")), "_b")).drop("_a", "_b")


def apply_overrides(papers: DataFrame, overrides: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """An override wins where its key is there; of several the last by `order`."""
    last = latest(overrides, key, [order.desc()]).select(key, F.col(value).alias("_o"), F.lit(True).alias("_has"))
    out = papers.join(last, key, "left")
    return out.withColumn(value, F.when(F.col("_has"), F.col("_o")).otherwise(F.col(value))).drop("_o", "_has")


def match_titles(papers: DataFrame, candidates: DataFrame, id_column: str, work_id: str, compose: bool = True, own: bool = False, strict_only: bool = False) -> DataFrame:
    """Best candidate work of each paper: (id, work, kind).

    Strict is an equal normalized title of the same year; loose an equal loose
    key within a year.  Strict wins, then the candidate's position, then its
    id.  Empty loose keys match nothing.  With `own`, candidates name the paper
    that they were found for, and match it alone.

    Of candidates alike only the first can be a paper's best, so there is one
    for each normalized title and year, and one for each loose key and each of
    the three years around, before papers meet them: a title that very many
    papers and candidates share makes no pairs.  A paper that is listed more
    than once has the best of all its titles.  With `strict_only`, the strict
    matches alone: as these come first, no loose ones are looked for.
    """
    mine = [id_column] if own else []

    def titled(rows: DataFrame, *columns: Column | str) -> DataFrame:
        return rows.select(*columns, F.col("year").alias("_year"), T.loose_key(F.col("title"), compose).alias("_key"), T.normalize(F.col("title"), compose).alias("_norm")).filter("_key <> '' AND _year IS NOT NULL")

    c = titled(candidates, *mine, F.struct("position", work_id).alias("_place"))
    strict = c.groupBy(*mine, "_norm", "_year").agg(F.min("_place").alias("_strict"))  # equal normalized titles have equal keys
    if strict_only:
        hits = titled(papers, id_column).drop("_key").join(strict, [*mine, "_norm", "_year"])
        return hits.groupBy(id_column).agg(F.min("_strict").alias("_best")).select(id_column, F.col(f"_best.{work_id}").alias(work_id), F.lit("strict").alias("kind"))
    around = F.explode(F.array(F.col("_year") - 1, F.col("_year"), F.col("_year") + 1)).alias("_year")
    loose = c.select(*mine, "_key", "_place", around).groupBy(*mine, "_key", "_year").agg(F.min("_place").alias("_loose"))
    hits = titled(papers, id_column).join(loose, [*mine, "_key", "_year"]).join(strict, [*mine, "_norm", "_year"], "left")
    best = F.min(F.struct(F.col("_strict").isNull().alias("loose"), F.coalesce("_strict", "_loose").alias("place"))).alias("_best")
    return hits.groupBy(id_column).agg(best).select(id_column, F.col(f"_best.place.{work_id}").alias(work_id), F.when(F.col("_best.loose"), "loose").otherwise("strict").alias("kind"))


def upsert(rows: DataFrame, recovered: DataFrame, key: str, columns: list[str], keep_old_if_null: tuple[str, ...] = ("doi",)) -> DataFrame:
    """Recovered values overwrite those of their row; of `keep_old_if_null` only where there is one.  has_doi follows.

    Of several recovered rows of one key the one with the highest values, in
    the order of `columns`, counts; no row of `rows` is multiplied.
    """
    new = latest(recovered.select(key, *columns), key, [F.col(c).desc_nulls_last() for c in columns]).select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = rows.join(new, key, "left")
    for c in columns:
        value = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in keep_old_if_null else F.col(f"_new_{c}")
        out = out.withColumn(c, F.when(F.col("_hit"), value).otherwise(F.col(c)))
    out = out.drop("_hit", *(f"_new_{c}" for c in columns))
    return out.withColumn("has_doi", F.col("doi").isNotNull()) if "has_doi" in rows.columns and "doi" in columns else out


def verified_title(rows: DataFrame, title: str, page_title: str, compose: bool = True) -> DataFrame:
    """match_kind of a scraped page's title (strict, loose, mismatch or missing); a mismatch blocks nothing."""
    a, b = F.col(title), F.col(page_title)
    kind = F.when(F.coalesce(b, F.lit("")) == "", "missing").when(T.normalize(a, compose) == T.normalize(b, compose), "strict").when(T.loose_key(a, compose) == T.loose_key(b, compose), "loose").otherwise("mismatch")
    return rows.withColumn("match_kind", kind)


def in_order(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows of the keys in `order` (key, ordinal), sorted by it."""
    return rows.join(order, key).orderBy("ordinal").drop("ordinal")


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """A column from a lookup table, with a default for keys that it lacks or leaves blank; of several values of a key the least that isn't blank."""
    named = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.when(F.trim(value) != "", F.col(value))).alias(value))
    return rows.drop(value).join(named, key, "left").withColumn(value, F.coalesce(F.nullif(F.trim(F.col(value)), F.lit("")), F.lit(default)))


def check_references(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, problem): used keys that aren't known, and known ones that nothing uses."""
    u, k = used.select(key).distinct(), known.select(key).distinct()
    return u.join(k, key, "left_anti").withColumn("problem", F.lit("unknown")).unionByName(k.join(u, key, "left_anti").withColumn("problem", F.lit("unused")))


def assert_references(used: DataFrame, known: DataFrame, key: str) -> None:
    bad = check_references(used, known, key).limit(20).collect()
    if bad:
        raise ValueError("references don't agree: " + ", ".join(f"{r[0]} ({r[1]})" for r in bad))


#: Values that are put into batches together, on average.
BATCHED = 10_000


def batches(values: DataFrame, column: str, most: int = 100, max_chars: int = 4000, part: Column | None = None) -> DataFrame:
    """Values packed greedily, in order, into batches of at most `most` values and `max_chars` characters with separators.

    The running total restarts whenever the next value doesn't fit, which no
    window expresses; each part is one pass over its sorted values.  `part`
    bounds it (default: by hash, as many parts as keep to BATCHED values).
    """
    import pandas as pd

    if part is None:
        part = F.pmod(F.xxhash64(column), F.lit(max(1, -(-values.count() // BATCHED))))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        batch, n, chars, out = 0, 0, 0, []
        for size in frame["v"].str.len() + 1:
            if n >= most or (n and chars + size > max_chars):
                batch, n, chars = batch + 1, 0, 0
            n, chars = n + 1, chars + size
            out.append(batch)
        return pd.DataFrame({"part": frame["part"], "batch": out, column: frame["v"]})

    rows = values.filter(F.col(column).isNotNull()).select(part.cast("long").alias("part"), F.col(column).alias("v"))
    return rows.groupBy("part").applyInPandas(fill, f"part long, batch int, {column} string")
