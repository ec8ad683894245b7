"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are the same after all ASCII white space is deleted.

* Each task combines the equal texts of its own rows (bytes are compared) and
  writes one entry for each: key, members, text.  However often a text is
  repeated, a task adds a few entries for it at most.
* The directory is grown from counts of different keys by prefix: an overfull
  bucket splits by one more bit of the key, and the directory doubles when the
  bucket's depth is its own.  Entries of one key never split a bucket; they
  are its chain.
* An owner task takes a range of the directory.  Entries come sorted by key;
  within a chain the bytes decide which are one text.  Chains of more than
  `page` entries are dealt to several owners by pages, whose first texts then
  meet as one more chain.

Every step's result is a written table, so a lost executor costs its tasks
alone.  The key only proposes: texts of one key and other bytes stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from plumbline.llm._text import CHUNK_BYTES, WHITE, partitions, slices, string_bytes
from plumbline.storage import shared_dir

#: Different keys in a bucket of the index: the directory takes 12 bytes for each so many.
BUCKET = 4096
#: Entries of one key that a single owner compares.
PAGE = 4096
#: Bytes of different texts that a task holds while it combines.
HELD_BYTES = 48 << 20
#: What a held row takes besides its text.
ROW_BYTES = 600
#: Bits of the key by which one count goes on from the last.
STEP = 12

Key = Callable[[bytes], int]


def text_key(text: bytes) -> int:
    """Signed 64-bit key of a normalised text."""
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big", signed=True)


class Directory:
    """Prefixes of keys and their buckets: `depth` bits, and for each of 2**depth prefixes the number of its bucket."""

    def __init__(self) -> None:
        self.depth, self.slots = 0, np.zeros(1, dtype=np.int32)
        self.local, self.counts = [0], [0]

    def split(self, bucket: int, counts: tuple[int, int]) -> None:
        """Deal a bucket's keys to two by their next bit, doubling the directory where it has no bit left."""
        if self.local[bucket] == self.depth:
            self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
        mine = np.flatnonzero(self.slots == bucket)
        self.local[bucket] += 1
        self.slots[mine[len(mine) // 2 :]] = len(self.local)
        self.local.append(self.local[bucket])
        self.counts[bucket] = counts[0]
        self.counts.append(counts[1])

    def prefix(self, bucket: int) -> int:
        """The bits that all keys of a bucket begin with, as a number of `local` bits."""
        return int(np.argmax(self.slots == bucket)) >> (self.depth - self.local[bucket])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Bucket of each key (as unsigned)."""
        return self.slots[(keys >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(keys), np.int32)


def grow(keys: DataFrame, bucket: int = BUCKET, step: int = STEP) -> Directory:
    """The directory of different keys (column key): no bucket holds more than `bucket` of them.

    Counts come for `step` further bits at a time, of overfull prefixes alone.
    The directory doubles up to 16 times the size that full buckets would
    need, which evenly hashed keys don't reach; a bucket that is overfull then
    stays so, as a longer chain.
    """
    found, depth = Directory(), 0
    found.counts[0] = keys.count()
    deepest = min(60, max(1, found.counts[0] // bucket).bit_length() + 4)
    while depth < deepest:
        full = [b for b, n in enumerate(found.counts) if n > bucket]
        if not full:
            break
        now = min(depth + step, deepest)
        prefix = F.shiftrightunsigned("key", 64 - now)
        asked = keys
        if depth:  # one prefix of 8 bytes for each bucket that is still overfull
            spark = keys.sparkSession
            wide = spark.createDataFrame([(found.prefix(b) << (depth - found.local[b]),) for b in full], "p long")
            asked = keys.join(F.broadcast(wide), F.shiftrightunsigned("key", 64 - depth) == F.col("p"), "left_semi")
        counts = {r[0]: r[1] for r in asked.groupBy(prefix.alias("p")).count().collect()}
        at = np.sort(np.fromiter(counts, dtype=np.int64, count=len(counts)))
        total = np.r_[0, np.cumsum([counts[p] for p in at.tolist()])]
        todo = full
        while todo:
            b = todo.pop()
            if found.counts[b] <= bucket or found.local[b] >= now:
                continue
            low, span = found.prefix(b) << (now - found.local[b]), 1 << (now - found.local[b])
            cut = np.searchsorted(at, [low, low + span // 2, low + span])
            found.split(b, (int(total[cut[1]] - total[cut[0]]), int(total[cut[2]] - total[cut[1]])))
            todo += [b, len(found.local) - 1]
        depth = now
    return found


ENTRY = "part long, local int, key long, text binary, text_sha256 string, top_chars long, top_tie long, top_row int, n int"


def entries(docs: DataFrame, id_column: str = "doc_id", text: str = "text", key: Key = text_key, held: int = HELD_BYTES) -> DataFrame:
    """One row for each different normalised text of a task: its members (id, code points of the original) and the best of them.

    The best has the most code points, then the least id (null last), then the
    least hash of the original text.  When more than `held` bytes are kept, the
    texts met once are passed on; those met again stay while there is room.
    """
    frame = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    out = StructType.fromDDL(f"{ENTRY}, top_id {kind}, members array<struct<id:{kind},chars:bigint>>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part, local = to_arrow_schema(out), TaskContext.get().partitionId(), 0
        kept: dict[bytes, list] = {}  # digest of a text -> the different texts of that digest, as [bytes, members, best]
        size = 0

        def passed(once: bool) -> Iterator[pa.RecordBatch]:
            """Texts met once, or all that are held, as entries."""
            nonlocal local, size
            rows, bulk = [], 0
            for digest in list(kept):
                for c in kept[digest]:
                    if once and len(c[1]) > 1:
                        continue
                    (less_chars, _, row_id, tie), at = c[2], c[3]
                    rows.append((part, local, c[4], c[0], digest.hex(), -less_chars, tie, at, len(c[1]), row_id, c[1]))
                    local, bulk, size = local + 1, bulk + len(c[0]), size - len(c[0]) - ROW_BYTES
                    if len(rows) == 512 or bulk > CHUNK_BYTES:
                        yield _batch(rows, schema)
                        rows, bulk = [], 0
                kept[digest] = [c for c in kept[digest] if once and len(c[1]) > 1]
                if not kept[digest]:
                    del kept[digest]
            if rows:
                yield _batch(rows, schema)

        for batch in slices(batches, "text"):
            data, offsets = string_bytes(batch.column(1))
            keep = ~WHITE[data]
            lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            chars = (lead[offsets[1:]] - lead[offsets[:-1]]).tolist()
            cut = np.r_[0, np.cumsum(keep)][offsets].tolist()
            plain, raw, ends = data[keep].tobytes(), data.tobytes(), offsets.tolist()
            for i, row_id in enumerate(batch.column(0).to_pylist()):
                mine = plain[cut[i] : cut[i + 1]]
                tie = xxh3_64_intdigest(raw[ends[i] : ends[i + 1]]) >> 1
                order = (-chars[i], row_id is None, row_id, tie)
                chain = kept.setdefault(hashlib.sha256(mine).digest(), [])
                found = next((c for c in chain if c[0] == mine), None)
                member = {"id": row_id, "chars": chars[i]}
                if found is None:
                    chain.append([mine, [member], order, 0, key(mine)])
                    size += len(mine) + ROW_BYTES
                else:
                    if _before(order, found[2]):
                        found[2], found[3] = order, len(found[1])
                    found[1].append(member)
            if size > held:
                yield from passed(True)
            if size > held // 2:
                yield from passed(False)
        yield from passed(False)

    return frame.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _before(a: tuple, b: tuple) -> bool:
    """Order of (-chars, id is null, id, tie); null ids are never compared."""
    if a[:2] != b[:2] or a[1]:
        return (a[0], a[1], a[3]) < (b[0], b[1], b[3])
    return a < b


def _chains(frame: DataFrame, directory, kind: str) -> DataFrame:
    """For each entry of an owner (sorted by key): its text's totals on this page, over byte-equal entries of the same key.

    An entry of the first place in its chain of a paged key carries the text
    on.  One key's entries on one page are held, no more.
    """
    out = StructType.fromDDL(f"part long, local int, key long, page int, pages int, bucket int, chain int, size long, top_chars long, top_tie long, top_part long, top_local int, top_row int, top_id {kind}, text binary")

    def close(key, entries: list[dict], bucket: int) -> Iterator[tuple]:
        texts: list[bytes] = []
        groups: list[list[dict]] = []
        for e in entries:
            at = next((k for k, t in enumerate(texts) if t == e["text"]), None)
            if at is None:
                texts.append(e["text"])
                groups.append([])
                at = len(texts) - 1
            groups[at].append(e)
        for chain, group in enumerate(groups):
            best = _best(group)
            n = sum(e["n"] for e in group)
            for k, e in enumerate(group):
                yield (e["part"], e["local"], key, e["page"], e["pages"], bucket, chain, n, best["top_chars"], best["top_tie"], best["top_part"], best["top_local"], best["top_row"], best["top_id"], texts[chain] if k == 0 and e["pages"] > 1 else None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, index = to_arrow_schema(out), directory.value
        now, held, rows = None, [], []
        for batch in batches:
            for e in batch.to_pylist():
                at = (e["key"], e["page"])
                if at != now:
                    if held:
                        rows += close(now[0], held, int(index.find(np.array([now[0]], np.int64).view(np.uint64))[0]))
                    now, held = at, []
                held.append(e)
            if len(rows) >= 1024:
                yield _batch(rows, schema)
                rows = []
        if held:
            rows += close(now[0], held, int(index.find(np.array([now[0]], np.int64).view(np.uint64))[0]))
        if rows:
            yield _batch(rows, schema)

    return frame.mapInArrow(run, out)


def _best(group: list[dict]) -> dict:
    """The entry whose best row stays: most code points, least id (null last), least hash, first place."""
    most = max(e["top_chars"] for e in group)
    first = [e for e in group if e["top_chars"] == most]
    first = [e for e in first if e["top_id"] is not None] or first
    return min(first, key=lambda e: (() if e["top_id"] is None else (e["top_id"],), e["top_tie"], e["top_part"], e["top_local"]))


def build(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", key: Key = text_key, bucket: int = BUCKET, page: int = PAGE, held: int = HELD_BYTES) -> Directory:
    """Write the index of `docs` below `folder`: entries, directory and buckets (see the module); returns the directory."""
    spark = docs.sparkSession
    entries(docs, id_column, text, key, held).write.parquet(f"{folder}/entries")
    table = spark.read.parquet(f"{folder}/entries")
    kind = table.schema["top_id"].dataType.simpleString()
    table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/keys")
    keys = spark.read.parquet(f"{folder}/keys")
    found = grow(keys.select("key"), bucket)
    spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(found.slots), dtype=np.int64), "bucket": found.slots}), "slot long, bucket int").write.parquet(f"{folder}/directory")
    # Keys of more than a page are at most as many as entries / page; each is 12 bytes.
    paged = keys.filter(F.col("n") > page).select("key", F.ceil(F.col("n") / page).cast("int").alias("pages"))
    owners = partitions(spark)
    owner = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(owners), 32).cast("int")  # equal ranges of keys; a chain's pages go to different owners
    dealt = table.select("part", "local", "key", "text", "top_chars", "top_tie", "top_row", "top_id", "n", F.col("part").alias("top_part"), F.col("local").alias("top_local"))
    dealt = dealt.join(paged if paged.count() > 1_000_000 else F.broadcast(paged), "key", "left").withColumn("pages", F.coalesce("pages", F.lit(1)))
    dealt = dealt.withColumn("page", F.when(F.col("pages") > 1, F.pmod(F.xxhash64("part", "local"), F.col("pages"))).otherwise(0).cast("int"))
    owned = dealt.repartitionById(owners, F.pmod(owner + F.col("page"), F.lit(owners)).cast("int")).sortWithinPartitions("key", "page")
    _chains(owned, spark.sparkContext.broadcast(found), kind).write.parquet(f"{folder}/buckets")
    return found


def _final(buckets: DataFrame, kind: str) -> DataFrame:
    """(part, local) of each entry with its class: where its best row is, that row's id, and how many rows."""
    fields = ["part", "local", "size", "top_part", "top_local", "top_row", F.col("top_id").alias("keep_id")]
    one = buckets.filter("pages = 1").select(*fields)
    heads = buckets.filter("text is not null")

    # A paged key's first texts: one for each page and different text, compared as a chain of their own.
    out = StructType.fromDDL(f"key long, page int, chain int, size long, top_part long, top_local int, top_row int, top_id {kind}")

    def meet(table: pa.Table) -> pa.Table:
        chains: dict[bytes, list[dict]] = {}
        for r in table.to_pylist():
            chains.setdefault(r["text"], []).append(r)
        done = []
        for group in chains.values():
            best = _best(group)
            n = sum(r["size"] for r in group)
            done += [(r["key"], r["page"], r["chain"], n, best["top_part"], best["top_local"], best["top_row"], best["top_id"]) for r in group]
        return pa.Table.from_batches([_batch(done, to_arrow_schema(out))])

    met = heads.groupBy("key").applyInArrow(meet, out)
    many = buckets.filter("pages > 1").select("part", "local", "key", "page", "chain").join(met, ["key", "page", "chain"])
    return one.unionByName(many.select(*fields))


def classes(spark, folder: str) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of an index: entries meet their class once each, then give their rows."""
    table = spark.read.parquet(f"{folder}/entries").select("part", "local", "text_sha256", "members")
    buckets = spark.read.parquet(f"{folder}/buckets")
    found = _final(buckets, buckets.schema["top_id"].dataType.simpleString())
    rows = table.join(found, ["part", "local"])
    mine = (F.col("part") == F.col("top_part")) & (F.col("local") == F.col("top_local"))
    rows = rows.select(F.posexplode("members").alias("row", "m"), "keep_id", F.col("size").alias("group_size"), mine.alias("_mine"), "top_row", "text_sha256")
    return rows.select(F.col("m.id").alias("id"), "keep_id", "group_size", (F.col("_mine") & (F.col("row") == F.col("top_row"))).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of `docs`.

    Of equal texts the row of most code points stays, then that of the least
    id (null last), then that of the least hash of its original text; of rows
    that are the same in all three one stays.  A null text counts as empty,
    and all empty ones are one group.  Other columns are dropped, so their
    names don't matter.  An empty table gives an empty one.
    """
    folder = shared_dir(docs.sparkSession, "exact-dedup")
    build(docs, folder, id_column, text, **options)
    return classes(docs.sparkSession, folder).withColumnRenamed("id", id_column)
