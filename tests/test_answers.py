"""The answers' data source: lanes, kept answers, resumed reads and streams, the rate of the job, the budget."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.sources import answers, responses

FAST = {"persecond": "100000"}


def service(log, fail_at=None, spent_after=None, malformed=()):
    """A fetcher that writes down what it is asked and when, one line a request, whatever process it runs in."""

    def fetch(values):
        with open(log, "a") as f:
            f.write(json.dumps([time.time(), values]) + "\n")
        n = sum(1 for _ in open(log))
        if fail_at is not None and fail_at in values and not os.path.exists(f"{log}.mended"):
            raise RuntimeError("the machine is gone")
        if spent_after is not None and n > spent_after:
            return 429, None, None
        if len(values) > 1 and set(malformed) & set(values):
            return 400, None, None
        if values[0] in malformed:
            return 400, None, None
        return 200, json.dumps({"results": [{"doi": v} for v in values]}), None

    return fetch


def asked(log):
    return [json.loads(line)[1] for line in open(log)] if os.path.exists(log) else []


@pytest.fixture
def place(spark, tmp_path):
    requests = spark.createDataFrame([(f"k{i:02d}", [f"10.1/{i}a", f"10.1/{i}b"]) for i in range(24)] + [("k03", ["10.1/3a", "10.1/3b"])], "cache_key string, values array<string>")
    folder = f"file://{tmp_path}/scan"
    answers.write_requests(requests, folder, lanes=3)
    return folder, str(tmp_path / "log")


def test_read_asks_once(spark, place):
    folder, log = place
    answers.register(spark, service(log), "once")
    read = lambda: spark.read.format("once").options(**FAST).load(folder)
    assert {(r["cache_key"], r["status"]) for r in read().collect()} == {(f"k{i:02d}", 200) for i in range(24)}
    assert read().count() == 24 and len(asked(log)) == 24
    assert read().rdd.getNumPartitions() == 3


def test_filters_spare_requests(spark, place):
    folder, log = place
    answers.register(spark, service(log), "filtered")
    frame = spark.read.format("filtered").options(**FAST).load(folder)
    assert frame.filter("cache_key = 'k05'").count() == 1 and asked(log) == [["10.1/5a", "10.1/5b"]]
    assert frame.filter(F.col("cache_key").isin("k05", "k06", "none")).count() == 2 and len(asked(log)) == 2


def test_a_killed_job_goes_on(spark, place):
    """The lane's answers before the fault are kept: the job that follows asks for none of them."""
    folder, log = place
    answers.register(spark, service(log, fail_at="10.1/7a"), "killed")
    frame = spark.read.format("killed").options(**FAST).load(folder)
    with pytest.raises(Exception, match="the machine is gone"):
        frame.count()
    before = [v[0] for v in asked(log)]
    open(f"{log}.mended", "w").close()
    assert frame.count() == 24
    again = Counter(v[0] for v in asked(log))
    assert {v for v, n in again.items() if n > 1} <= {"10.1/7a"} and len(before) < 24 <= len(again)


def test_a_spent_budget_stops_all_lanes(spark, place):
    folder, log = place
    answers.register(spark, service(log, spent_after=6), "spent")
    frame = spark.read.format("spent").options(**FAST).load(folder)
    some = [r["status"] for r in frame.collect()]
    assert some.count(200) == 6 and 1 <= some.count(429) <= 3 and len(asked(log)) == len(some)  # each lane learns of it once at most
    n = len(asked(log))
    assert frame.count() == 6 and len(asked(log)) == n  # the flag stands: nothing is asked
    answers.Kept(folder).go_on()
    answers.register(spark, service(log), "spent")
    assert spark.read.format("spent").options(**FAST).load(folder).count() == 24 and len(asked(log)) == n + 18


def test_refused_and_malformed_parts(spark, place):
    folder, log = place
    answers.register(spark, service(log, malformed=["10.1/2b"]), "parts")
    rows = spark.read.format("parts").options(**FAST).load(folder).filter("cache_key = 'k02'").collect()
    assert sorted((r["status"], r["body"] is None) for r in rows) == [(200, False), (400, True)]
    n = len(asked(log))
    assert spark.read.format("parts").options(**FAST).load(folder).filter("cache_key = 'k02'").count() == 2 and len(asked(log)) == n == 3


def test_stream_goes_on_where_it_was(spark, place, tmp_path):
    folder, log = place
    answers.register(spark, service(log, fail_at="10.1/20a"), "streamed")
    sink, checkpoint = f"{tmp_path}/sink", f"{tmp_path}/checkpoint"

    def run(until):
        q = spark.readStream.format("streamed").options(**FAST, perbatch="2").load(folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).start(sink)
        try:
            end = time.time() + 60
            while time.time() < end and not until(q):
                time.sleep(0.3)
        finally:
            q.stop()
        return q

    first = run(lambda q: q.exception() is not None)
    assert first.exception() is not None
    assert spark.read.schema(answers.ANSWERS).parquet(sink).count() < 24
    open(f"{log}.mended", "w").close()
    run(lambda q: spark.read.schema(answers.ANSWERS).parquet(sink).count() >= 24)
    got = Counter(r["cache_key"] for r in spark.read.schema(answers.ANSWERS).parquet(sink).collect())
    assert set(got) == {f"k{i:02d}" for i in range(24)} and set(got.values()) == {1}
    times = Counter(v[0] for v in asked(log))
    assert {v for v, n in times.items() if n > 1} <= {"10.1/20a"}


@pytest.mark.parametrize("per_second,lanes", [(20, 3), (10, 1), (25, 4)])
def test_no_second_holds_more_requests(spark, tmp_path, per_second, lanes):
    """Also while batches are halved: each request counts."""
    requests = spark.createDataFrame([(f"k{i}", [f"{i}-{j}" for j in range(8)]) for i in range(4)], "cache_key string, values array<string>")
    log = str(tmp_path / "log")
    got = responses.scan(requests, service(log, malformed=["1-3", "2-0"]), per_second=per_second, lanes=lanes).collect()
    times = [json.loads(line)[0] for line in open(log)]
    assert len(times) > 14 and sum(r["status"] == 400 for r in got) == 2
    assert max(Counter(int(t) for t in times).values()) <= per_second


def test_slots_by_a_clock_of_our_own():
    now, taken = [100.05], []
    lanes = [answers.Pace(8, i, 3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s)) for i in range(3)]
    for _ in range(20):
        for lane in lanes:
            lane.wait()
            taken.append(now[0])
    slots = [round(t * 8) for t in taken]
    assert len(set(slots)) == len(slots) and all(round(s) % 3 == i % 3 for i, s in enumerate(slots))
    for start in taken:
        assert sum(start <= t < start + 1 for t in taken) <= 8


def test_scan_keeps_each_answer(spark, tmp_path):
    """With a folder for answers, a task that is lost asks for nothing again."""
    requests = spark.createDataFrame([(f"k{i}", [f"v{i}"]) for i in range(10)], "cache_key string, values array<string>")
    log, keep = str(tmp_path / "log"), f"file://{tmp_path}/kept"
    scanned = lambda: responses.scan(requests, service(log, fail_at="v6"), per_second=1e5, lanes=1, keep=keep).collect()
    with pytest.raises(Exception, match="the machine is gone"):
        scanned()
    n = len(asked(log))
    open(f"{log}.mended", "w").close()
    assert len(scanned()) == 10 and len(asked(log)) == 10 + 1 and n >= 1


def test_no_access_ends_the_job(spark):
    requests = spark.createDataFrame([("k", ["v"])], "cache_key string, values array<string>")
    with pytest.raises(Exception, match="no access"):
        responses.scan(requests, lambda v: (403, None, None), per_second=1e5).collect()


def test_pages_once_each_with_their_state(spark):
    targets = spark.createDataFrame([(i, f"u{i}") for i in range(6)] + [(9, None)], "id int, ee string")
    cache = spark.createDataFrame([("u0", 404, None), ("u0", 200, "<p>new"), ("u1", 404, None), ("u1", 404, None), ("u2", 403, None), ("u3", 503, None), (None, 200, "x")], "url string, status int, html string")
    got = {r["id"]: (r["state"], r["html"]) for r in responses.cached_pages(targets, cache).collect()}
    assert responses.cached_pages(targets, cache).count() == 7
    assert got == {0: ("found", "<p>new"), 1: ("missing", None), 2: ("no_access", None), 3: ("later", None), 4: ("unasked", None), 5: ("unasked", None), 9: ("unasked", None)}


def test_status_policy_of_pages(spark, tmp_path):
    log = str(tmp_path / "pages")

    def get(u):
        with open(log, "a") as f:
            f.write(u + "\n")
        n = open(log).read().split().count(u)
        return {"ok": (200, "<p>"), "gone": (404, "no"), "odd": (418, "tea"), "busy": (503, None) if n < 3 else (200, "<q>")}[u]

    targets = spark.createDataFrame([("ok",), ("gone",), ("odd",), ("busy",), ("known",)], "ee string")
    cache = spark.createDataFrame([("known", 200, "<k>")], "url string, status int, html string")
    got = {r["url"]: (r["status"], r["html"]) for r in responses.fetch_pages(targets, cache, get, per_second=1e5, sleep=lambda s: None).collect()}
    assert got == {"ok": (200, "<p>"), "gone": (404, None), "odd": (418, None), "busy": (200, "<q>")}
    for status, message in ((403, "session"), (503, "again and again")):
        with pytest.raises(Exception, match=message):
            responses.fetch_pages(targets, cache, lambda u, s=status: (s, None), per_second=1e5, sleep=lambda s: None).collect()
