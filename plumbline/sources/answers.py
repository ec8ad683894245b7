"""Answers of a remote service as a data source, for batch and streaming reads.

    write_requests(responses.plan(dois, "doi"), folder, lanes=4)
    register(spark, fetch, "answers")
    spark.read.format("answers").load(folder)          # cache_key, status, body
    spark.readStream.format("answers").load(folder)

Requests lie below `folder` by lane; a partition of a read is a lane, and
lanes take turns in a schedule of time slots, so `per_second` holds for the
whole job without a word between its tasks.  Each request's answers are kept
in a file of its own before they are passed on: a task that is lost, or a job
that is killed and begun again, asks for nothing that was answered.  When the
service says that the budget is spent, a flag beside the answers stops all
lanes.

`folder` has to be one that all executors share, of a file system that pyarrow
opens by its URI.
"""

from __future__ import annotations

import hashlib
import json
import math
import posixpath
import time
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

ANSWERS = "cache_key string, status int, body string"

#: Given the values of a batch: (status, body or None, seconds to wait before another try or None).
Fetcher = Callable[[list[str]], tuple[int, str | None, float | None]]

# What statuses mean.  Final ones are kept and not asked for again; others are tried again.
FINAL = (200, 400, 404)
REFUSED_FOR_GOOD = (400, 404)
SPENT = 429
#: The session isn't valid (any more): the job can't go on, and nothing is kept as missing.
NO_ACCESS = (401, 403)


class Spent(Exception):
    """The budget is spent, here or in another lane."""


class Pace:
    """Time slots of 1 / per_second; lane i of n has those whose number leaves i modulo n.

    Machines whose clocks agree to within a slot need no other word of each
    other: no second on the clock holds more than `per_second` requests.
    """

    def __init__(self, per_second: float, lane: int = 0, lanes: int = 1, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.per_second, self.lane, self.lanes, self.clock, self.sleep, self.last = per_second, lane, lanes, clock, sleep, -1

    def wait(self) -> None:
        """Until the lane's next slot begins; each request takes one, also a repeated or halved one."""
        slot = max(math.ceil(self.clock() * self.per_second), self.last + 1)
        slot += (self.lane - slot) % self.lanes
        self.last = slot
        gap = slot / self.per_second - self.clock()
        if gap > 0:
            self.sleep(gap)


class Kept:
    """Answers by request, one file each, and the flag that the budget is spent."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)

    def _path(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def _is(self, path: str) -> bool:
        return self.fs.get_file_info(path).type == pafs.FileType.File

    def read(self, path: str) -> bytes | None:
        path = self._path(path)
        if not self._is(path):
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        """Whole or not at all: written beside its place, then moved."""
        path = self._path(path)
        self.fs.create_dir(posixpath.dirname(path), recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(data)
        self.fs.move(draft, path)

    @staticmethod
    def _name(key: str) -> str:
        digest = hashlib.sha1(key.encode()).hexdigest()
        return f"answers/{digest[:2]}/{digest}.json"

    def get(self, key: str) -> list[tuple[int, str | None]] | None:
        raw = self.read(self._name(key))
        return None if raw is None else [(s, b) for s, b in json.loads(raw)]

    def put(self, key: str, answers: list[tuple[int, str | None]]) -> None:
        self.write(self._name(key), json.dumps(answers, ensure_ascii=False).encode())

    def spent(self) -> bool:
        return self._is(self._path("SPENT"))

    def stop(self) -> None:
        self.write("SPENT", b"")

    def go_on(self) -> None:
        """Take the flag away, when there is a budget again."""
        if self.spent():
            self.fs.delete_file(self._path("SPENT"))

    def files(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self._path(folder), recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and posixpath.basename(f.path)[0] not in "._")


def ask(fetch: Fetcher, values: list[str], attempts: int = 4, sleep: Callable[[float], None] = time.sleep, pace: Callable[[], None] = lambda: None) -> list[tuple[int, str | None]]:
    """Answers for a batch; `pace` is called before each request.

    Waits and tries again when told to (at most 60 s; 2**k s where no time is
    given) and halves a batch that is refused as malformed.  The last status
    counts when all attempts failed; 429 alone when the budget is spent (429
    without a wait).  Denied access is a PermissionError.
    """
    try:
        return _ask(fetch, values, attempts, sleep, pace)
    except Spent:
        return [(SPENT, None)]


def _ask(fetch: Fetcher, values: list[str], attempts: int, sleep: Callable[[float], None], pace: Callable[[], None]) -> list[tuple[int, str | None]]:
    for k in range(attempts):
        pace()
        status, body, wait = fetch(values)
        if status == 200:
            return [(status, body)]
        if status == 400 and len(values) > 1:
            half = len(values) // 2
            return _ask(fetch, values[:half], attempts, sleep, pace) + _ask(fetch, values[half:], attempts, sleep, pace)
        if status in REFUSED_FOR_GOOD:
            return [(status, None)]
        if status in NO_ACCESS:
            raise PermissionError(f"status {status}: no access to the service")
        if status == SPENT and wait is None:
            raise Spent
        if k < attempts - 1:
            sleep(min(60.0, wait if wait is not None else 2.0**k))
    return [(status, None)]


def answered(requests: Iterator[tuple[str, list[str]]], fetch: Fetcher, kept: Kept | None, pace: Pace, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, int, str | None]]:
    """(cache_key, status, body) of a lane's requests, from what is kept or from the service.

    A request is kept when all its parts have a final status.  The one that
    finds the budget spent has one row of status 429; those after it have none
    unless they are kept.
    """
    for key, values in requests:
        got = kept.get(key) if kept else None
        if got is None:
            if kept and kept.spent():
                continue  # later requests may be kept
            try:
                got = _ask(fetch, values, 4, sleep, pace.wait)
            except Spent:
                yield key, SPENT, None
                if kept:
                    kept.stop()
                    continue
                return
            if kept and all(s in FINAL for s, _ in got):
                kept.put(key, got)
        yield from ((key, s, b) for s, b in got)


def write_requests(requests: DataFrame, folder: str, lanes: int = 4) -> None:
    """Requests (cache_key, values) as files, dealt to lanes by hash; keys that repeat count once."""
    one = requests.groupBy("cache_key").agg(F.min("values").alias("values"))
    lane = F.pmod(F.xxhash64("cache_key"), F.lit(lanes)).cast("int")
    dealt = one.withColumn("lane", lane).repartition(lanes, "lane").sortWithinPartitions("lane", "cache_key")
    dealt.write.mode("overwrite").partitionBy("lane").json(f"{folder}/requests")
    sizes = {r["lane"]: r["n"] for r in dealt.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).collect()}
    Kept(folder).write("lanes.json", json.dumps([sizes.get(i, 0) for i in range(lanes)]).encode())


class Lane(InputPartition):
    def __init__(self, lane: int, start: int = 0, end: int | None = None):
        super().__init__(lane)
        self.lane, self.start, self.end = lane, start, end


def _requests(kept: Kept, lane: Lane) -> Iterator[tuple[str, list[str]]]:
    n = 0
    for path in kept.files(f"requests/lane={lane.lane}"):
        with kept.fs.open_input_stream(path, compression=None) as f:
            for line in f.read().splitlines():
                if n >= lane.start and (lane.end is None or n < lane.end):
                    row = json.loads(line)
                    yield row["cache_key"], row["values"]
                n += 1


class _Lanes:
    """What batch and stream readers share."""

    def __init__(self, options: dict, fetch: Fetcher):
        self.folder, self.fetch = options["path"], fetch
        self.per_second = float(options.get("persecond", "8"))
        self.keys: set[str] | None = None

    def sizes(self) -> list[int]:
        raw = Kept(self.folder).read("lanes.json")
        if raw is None:
            raise FileNotFoundError(f"no requests below {self.folder}: write_requests() makes them")
        return json.loads(raw)

    def read(self, partition: Lane) -> Iterator[tuple[str, int, str | None]]:
        kept, lanes = Kept(self.folder), len(self.sizes())
        wanted = (r for r in _requests(kept, partition) if self.keys is None or r[0] in self.keys)
        yield from answered(wanted, self.fetch, kept, Pace(self.per_second, partition.lane, lanes))


class AnswersReader(_Lanes, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Requests that a filter on cache_key leaves out aren't asked."""
        for f in filters:
            keys = None
            if isinstance(f, EqualTo) and f.attribute == ("cache_key",):
                keys = {f.value}
            elif isinstance(f, In) and f.attribute == ("cache_key",):
                keys = set(f.value)
            if keys is None:
                yield f
            else:
                self.keys = keys if self.keys is None else self.keys & keys

    def partitions(self) -> list[Lane]:
        return [Lane(i) for i, n in enumerate(self.sizes()) if n] or [Lane(0)]


class AnswersStream(_Lanes, DataSourceStreamReader):
    """Offsets are places in the lanes; each batch takes `perbatch` requests of each lane.

    What latestOffset gives is written down first, and never less than before,
    so a query that begins again goes on where its checkpoint is.
    """

    def __init__(self, options: dict, fetch: Fetcher):
        super().__init__(options, fetch)
        self.per_batch, self.last = int(options.get("perbatch", "100")), None
        self.log = f"offsets/{options.get('query', 'stream')}.json"

    def initialOffset(self) -> dict:
        return {str(i): 0 for i in range(len(self.sizes()))}

    def latestOffset(self) -> dict:
        kept = Kept(self.folder)
        written = kept.read(self.log) if self.last is None else None
        if written is not None:
            self.last = json.loads(written)
        else:
            before = self.last or self.initialOffset()
            self.last = {str(i): min(n, before[str(i)] + self.per_batch) for i, n in enumerate(self.sizes())}
            kept.write(self.log, json.dumps(self.last).encode())
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        return [Lane(int(i), start[i], end[i]) for i in end if end[i] > start.get(i, 0)]


def register(spark: SparkSession, fetch: Fetcher, name: str = "answers") -> None:
    """Make `name` a format whose reads ask `fetch`; options path, persecond, perbatch, query (a name for its offsets)."""

    class Answers(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ANSWERS

        def reader(self, schema) -> AnswersReader:
            return AnswersReader(dict(self.options), fetch)

        def streamReader(self, schema) -> AnswersStream:
            return AnswersStream(dict(self.options), fetch)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Answers)
