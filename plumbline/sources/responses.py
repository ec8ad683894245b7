"""Remote works as a data source: batches of DOIs against a cache, with a pluggable fetcher.

Requests are planned as a table of batches; each partition answers its batches
from the cached responses and asks the fetcher only for the rest.  Without a
fetcher (offline) the rest stays pending.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import match
from plumbline.operators.match import batches
from plumbline.schemas import WORKS
from plumbline.sources import answers
from plumbline.sources.answers import ANSWERS, FINAL, Fetcher, ask  # noqa: F401
from plumbline.storage import exists, overwrite, shared_dir

def plan(values: DataFrame, column: str, most: int = 100, max_chars: int = 4000) -> DataFrame:
    """(cache_key, values): one row per request, keyed by its content."""
    packed = batches(values.filter(F.col(column).isNotNull()).select(column).distinct(), column, most, max_chars)
    lists = packed.groupBy("part", "batch").agg(F.array_sort(F.collect_list(column)).alias("values"))
    return lists.select(F.sha1(F.array_join("values", "|")).alias("cache_key"), "values")


def pending(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a cached answer: what a resumed scan still has to ask."""
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti")


def scan(requests: DataFrame, fetch: Fetcher, per_second: float = 8.0, lanes: int = 4, sleep: Callable[[float], None] = time.sleep, keep: str | None = None) -> DataFrame:
    """(cache_key, status, body) of each request.

    Requests go through `lanes` tasks that take turns in time slots, one
    request a slot, so `per_second` holds for the whole job, also while a batch
    is halved or tried again.  When the budget is spent (429 without a wait) a
    lane asks no more: its other requests have no row and stay pending.  With
    `keep`, a folder that all executors share, each request's answers are
    written there at once, a lost task asks for nothing again, and a spent
    budget stops all lanes (see sources.answers).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = answers.Kept(keep) if keep else None
        pace = answers.Pace(per_second, TaskContext.get().partitionId() % lanes, lanes, sleep=sleep)
        mine = ((key, list(values)) for frame in frames for key, values in zip(frame["cache_key"], frame["values"], strict=True))
        rows: list[tuple] = []
        for row in answers.answered(mine, fetch, kept, pace, sleep):
            rows.append(row)
            if len(rows) >= 100:
                yield pd.DataFrame(rows, columns=["cache_key", "status", "body"])
                rows = []
        yield pd.DataFrame(rows, columns=["cache_key", "status", "body"])

    return requests.repartition(lanes).mapInPandas(run, ANSWERS)


def scan_rounds(requests: DataFrame, path: str, fetch: Fetcher, most: int = 10, **options) -> DataFrame:
    """The table of answers at `path`, after asking for what it lacks, round by round.

    A round's answers are written before any of them is looked at, so nothing
    is asked twice; where executors may be lost, `keep` (see scan) holds them
    request by request.  A request is kept when all its parts are answered (or
    refused for good); others are asked in the next round.  When the budget is
    spent no further round begins, and a later call goes on from there.
    """
    spark = requests.sparkSession
    read = lambda: spark.read.schema(ANSWERS).parquet(path) if exists(spark, path) else spark.createDataFrame([], ANSWERS)
    if options.get("keep"):
        answers.Kept(options["keep"]).go_on()
    for _ in range(most):
        todo = pending(requests, read())
        n = todo.count()
        if not n:
            break
        folder = shared_dir(spark, "answers")
        scan(todo, fetch, **options).write.parquet(folder)
        got = spark.read.schema(ANSWERS).parquet(folder)
        failed = got.filter(~F.col("status").isin(*FINAL))
        got.join(failed.select("cache_key").distinct(), "cache_key", "left_anti").write.mode("append").parquet(path)
        if got.select("cache_key").distinct().count() < n or not failed.filter("status = 429").isEmpty():  # the budget is spent
            break
    return read()


def scan_summary(requests: DataFrame, answers: DataFrame, path: str) -> DataFrame:
    """(doi, has_abstract) of all works answered.

    Kept below `path` under the numbers of requests and of their values, and
    read from there while these are the same; written only when nothing is
    pending.
    """
    spark = requests.sparkSession
    n = requests.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("values")), F.lit(0))).first()
    kept = f"{path}/requests={n[0]}/values={n[1]}"
    if exists(spark, kept):
        return spark.read.parquet(kept)
    found = match.works(parsed(answers)).filter("doi is not null").groupBy("doi").agg(F.max(F.col("abstract").isNotNull()).alias("has_abstract"))
    return overwrite(found, kept) if pending(requests, answers).isEmpty() else found


def title_requests(rows: DataFrame, id_column: str, title: str = "title", year: str = "year") -> DataFrame:
    """(id, cache_key, values): the search by title and year for each row that has both; rows of one title and year share their request."""
    t, y = F.col(title), F.col(year).cast("string")
    safe = F.replace(t, F.lit('"'), F.lit('\\"'))
    search = F.concat(F.lit('title.search:"'), safe, F.lit('",publication_year:'), y)
    return rows.filter(t.isNotNull() & y.isNotNull()).select(id_column, F.concat(F.lit("title_"), T.cache_key(t, F.lit("|"), y)).alias("cache_key"), F.array(search).alias("values"))


def title_candidates(requests: DataFrame, answers: DataFrame, id_column: str) -> DataFrame:
    """(id, openalex_id, position, title, year) of the works found for each row, for match_titles with own=True."""
    found = answers.filter("status = 200").select("cache_key", F.posexplode(F.from_json("body", WORKS)["results"]).alias("position", "w"))
    return requests.select(id_column, "cache_key").join(found, "cache_key").select(id_column, F.col("w.id").alias("openalex_id"), "position", F.col("w.display_name").alias("title"), F.col("w.publication_year").alias("year"))


def parsed(answers: DataFrame) -> DataFrame:
    """Answers as rows with the schema of works."""
    return answers.filter("status = 200").select(F.from_json("body", WORKS).alias("r")).select("r.results")


def stored(path_rows: list[dict]) -> Fetcher:
    """A fetcher over works at hand, for tests and offline runs."""
    by_doi = {(w.get("doi") or "").lower().removeprefix("https://doi.org/"): w for w in path_rows}

    def fetch(values: list[str]) -> tuple[int, str | None, float | None]:
        return 200, json.dumps({"results": [by_doi[v] for v in values if v in by_doi]}), None

    return fetch


def generated(wanted: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> DataFrame:
    """(key, value) of all wanted keys, from the table at `path`; what it lacks is made by `make` and added first.

    Keys are made once, however often they are wanted; null keys go.
    """
    spark = wanted.sparkSession
    have = spark.read.parquet(path) if exists(spark, path) else None
    lacking = match.latest(wanted, key, [F.lit(1).asc()]) if have is None else match.latest(wanted, key, [F.lit(1).asc()]).join(have.select(key), key, "left_anti")
    if have is None or not lacking.isEmpty():
        make(lacking).select(key, "value").write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(key).distinct(), key, "left_semi")


def cached_pages(targets: DataFrame, cache: DataFrame, url: str = "ee", order: Column | None = None) -> DataFrame:
    """Targets with their cached page and its state; each target once, as of several pages of a url the first by `order` counts.

    By default that is one with a page, then that of the greatest status and
    page.  States: found; missing (a final miss: not asked again); no_access
    (the session was refused: the scan has to stop and be given a new one);
    later (the service was busy or failed); unasked.
    """
    preferred = [order] if order is not None else [F.col("html").isNull(), F.col("status").desc_nulls_last(), F.col("html").desc_nulls_last()]
    one = match.latest(cache, "url", preferred).select(F.col("url").alias(url), "status", "html", F.lit(True).alias("_hit"))
    s = F.col("status")
    state = F.when(F.col("_hit").isNull(), "unasked").when(F.col("html").isNotNull(), "found").when(s.isin(*answers.NO_ACCESS), "no_access").when(s.isin(*BUSY), "later").otherwise("missing")
    return targets.drop("status", "html").join(one, url, "left").withColumn("state", state).drop("_hit")


# Statuses after which a page is asked for again, and the seconds before the first of four tries; the next waits twice as long.
BUSY = (429, 503)
FIRST_WAIT, PAGE_ATTEMPTS = 3.0, 4


def fetch_pages(targets: DataFrame, cache: DataFrame, get: Callable[[str], tuple[int, str | None]], url: str = "ee", per_second: float = 0.5, lanes: int = 1, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, status, html) of the pages that the cache lacks or has as busy, to be added to it.

    A busy service is waited for and tried again; another status than 200 is a
    miss, with no html.  Refused access, or a service that stays busy, ends
    the job, as going on would cost the session; pages that came before are
    lost with it unless they were cached, so a long list should go in parts.
    """
    todo = cached_pages(targets, cache, url).filter("state in ('unasked', 'later', 'no_access')").filter(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = answers.Pace(per_second, TaskContext.get().partitionId() % lanes, lanes, sleep=sleep)
        for frame in frames:
            for u in frame["url"]:
                for k in range(PAGE_ATTEMPTS):
                    pace.wait()
                    status, html = get(u)
                    if status in answers.NO_ACCESS:
                        raise PermissionError(f"status {status}: the session isn't valid")
                    if status not in BUSY:
                        break
                    sleep(FIRST_WAIT * 2**k)
                else:
                    raise RuntimeError(f"status {status} again and again: stopped")
                yield pd.DataFrame({"url": [u], "status": [status], "html": [html if status == 200 else None]}).astype({"html": object})

    return todo.repartition(lanes).mapInPandas(run, "url string, status int, html string")
