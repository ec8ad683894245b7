"""Best-fit-decreasing packing of documents into sequences of fixed capacity.

Pieces are placed longest first, each into the open sequence with the least
room that still takes it; a segment tree over the remaining capacities finds
that room in logarithmic time.  Pieces of one length are interchangeable, so
the driver packs runs: from the histogram of lengths (at most `capacity` rows,
whatever the corpus) it derives which ranks of each length go to which
sequences.  The result is that of best-fit decreasing over all pieces, one by
one; the pieces themselves stay distributed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._text import slices, string_bytes
from plumbline.llm.tokens import library_table, with_end
from plumbline.storage import shared_dir


class RoomTree:
    """Which remaining capacities 0..capacity have open sequences; the least at or above a size in O(log capacity)."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.width)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, first: int, n: int) -> None:
        self.open[room].append((first, n))
        at = room + self.width
        while at and not self.any[at]:
            self.any[at] = True
            at //= 2

    def pop(self, room: int) -> tuple[int, int]:
        got = self.open[room].pop()
        if not self.open[room]:
            at = room + self.width
            self.any[at] = False
            at //= 2
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = False
                at //= 2
        return got

    def tightest(self, size: int) -> int | None:
        """The least room >= size with an open sequence."""
        at = size + self.width
        if self.any[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Placements (length, rank, until, sequence, per_sequence, offset) of best-fit decreasing.

    Pieces of `length` with ranks from `rank` to before `until` go to
    sequences from `sequence` on, `per_sequence` to each, the first at
    `offset`.  The number of rows depends on the number of different lengths,
    not on that of pieces.
    """
    tree, rows, sequences = RoomTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while n:
            room = tree.tightest(length)
            if room is None:
                room, first, bins = capacity, sequences, -(-n // (capacity // length))
                sequences += bins
            else:
                first, bins = tree.pop(room)
            each = min(room // length, n)
            whole = min(bins, n // each)
            rows.append((length, rank, rank + whole * each, first, each, capacity - room))
            rank, n = rank + whole * each, n - whole * each
            tree.push(room - each * length, first, whole)
            if whole < bins:
                tree.push(room, first + whole, bins - whole)
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents as token pieces of at most `capacity`, with the writing task's number and the rank among its pieces of equal length."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    frame = docs.select(*keep, "text")
    out = StructType(frame.select(*keep).schema.fields + StructType.fromDDL("piece int, start long, length long, ids_crc32 long, _part int, _rank long").fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, table, schema = TaskContext.get().partitionId(), library_table(tokenizer_path), to_arrow_schema(out)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for part in slices(batches):
            data, offsets = string_bytes(part.column(len(keep)))
            ids, counts = with_end(*table.encode(data, offsets), end_id)
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = number * capacity
            length = np.minimum(counts[row] - start, capacity)
            raw, at = ids.astype("<u4").tobytes(), 4 * ((np.cumsum(counts) - counts)[row] + start)
            crc = [zlib.crc32(raw[a : a + 4 * m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sizes = length[order]
            edge = np.r_[True, sizes[1:] != sizes[:-1]] if len(sizes) else np.zeros(0, bool)
            first = np.flatnonzero(edge)
            many = np.diff(np.r_[first, len(sizes)])
            rank = np.empty(len(row), dtype=np.int64)
            rank[order] = np.arange(len(row)) - np.repeat(first, many) + seen[sizes]
            seen[sizes[first]] += many
            kept = [part.column(i).take(pa.array(row)) for i in range(len(keep))]
            made = [number.astype(np.int32), start, length, np.array(crc, dtype=np.int64), np.full(len(row), task, np.int32), rank]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, made)], schema=schema)

    return frame.mapInArrow(run, out)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and place.

    Every document ends with `end_id`; only longer ones than `capacity` are
    cut.  A null text counts as empty (the end id alone).  Repeated rows are
    packed each for itself; an empty table gives no rows.  Pieces of equal
    length are placed in the order of the tasks that made them.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "packing")
    pieces(docs, tokenizer_path, capacity, end_id, keep).write.parquet(folder)
    staged = spark.read.parquet(folder)
    counts = staged.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("_part", "length", F.coalesce(before, F.lit(0)).alias("_base"))
    ranked = staged.join(base, ["_part", "length"]).select(*keep, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_base")).alias("_rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        key = rows[:, 0] << 40 | rows[:, 1]
        order = np.argsort(key)
        key, rows = key[order], rows[order]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            at = rows[np.searchsorted(key, length << 40 | rank, side="right") - 1]
            along = rank - at[:, 1]
            sequence = at[:, 3] + along // at[:, 4]
            offset = at[:, 5] + along % at[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    from pyspark.sql.types import StructType

    out = StructType(ranked.schema.fields[:-1] + StructType.fromDDL("sequence_id long, offset long").fields)
    return ranked.mapInArrow(place, out)
