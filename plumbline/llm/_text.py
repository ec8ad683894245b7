"""Shared low-level helpers: Arrow batches, byte buffers and word hashing.

Every operator of this subpackage works on whole texts.  Texts are taken from
Arrow batches as one byte buffer with offsets, so the inner loops are numpy
passes over bytes and no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside a task.
CHUNK_BYTES = 2 << 20

_MASK = (1 << 64) - 1
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a run that are hashed by one chain of steps.
HASH_BLOCK = 256


def column(name: str) -> Column:
    """The column of exactly this name, dots and ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def aside(docs: DataFrame, names: list[str], without: tuple[str, ...] = ()) -> tuple[list[Column], list[tuple[str, str]]]:
    """Columns of a table under names of their own (c0, c1, ...), that no operator's columns clash with, and these names with the old ones.

    Those in `without` are left out, however they are spelled.
    """
    gone = {w.casefold() for w in without}
    kept = [n for n in names if n.casefold() not in gone]
    return [column(n).alias(f"c{i}") for i, n in enumerate(kept)], [(f"c{i}", n) for i, n in enumerate(kept)]


def back(kept: list[tuple[str, str]]) -> list[Column]:
    return [F.col(mine).alias(name) for mine, name in kept]


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    elif pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(col) + 1, offset=col.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with about `limit` bytes of `column` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def split_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of non-separator bytes."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number; bytes past the end are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))


#: Keeps the first k of eight bytes.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _hash_runs(loads: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hash of each run: its length, then eight bytes at a time, mixed in between."""
    h = mix(lens.astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F))
    at, step = np.arange(len(starts)), 0
    while len(at):
        some = mix(h[at] ^ (loads[starts[at] + step] & _KEEP[np.minimum(lens[at] - step, 8)]))
        h[at] = some
        step += 8
        at = at[lens[at] > step]
    return h


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run [start, end), none empty.

    Every eight bytes pass through a mixing step of their own, so neither the
    order nor the place of parts is lost.  Long runs are hashed by blocks,
    each mixed with its number, so no run takes a pass of its own.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    loads, lens = _loads(data), ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    long = lens > HASH_BLOCK
    out[~long] = _hash_runs(loads, starts[~long], lens[~long])
    if long.any():
        n = -(-lens[long] // HASH_BLOCK)
        first = np.cumsum(n) - n
        number = np.arange(int(n.sum())) - np.repeat(first, n)
        at = np.repeat(starts[long], n) + number * HASH_BLOCK
        parts = _hash_runs(loads, at, np.minimum(np.repeat(ends[long], n) - at, HASH_BLOCK))
        parts = mix(parts ^ mix(number.astype(np.uint64) + np.uint64(1)))
        out[long] = mix(np.add.reduceat(parts, first) ^ mix(lens[long].astype(np.uint64)))
    return out


def same_runs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, other: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Is each run [start, start + len) of `data` equal, byte for byte, to the one at `others` in `other` (which has as many bytes there)?"""
    same = np.ones(len(starts), dtype=bool)
    if not len(starts):
        return same
    a, b = _loads(data), _loads(other) if other is not data else None
    b = a if b is None else b
    short = np.flatnonzero(lens <= HASH_BLOCK)
    at, step = short, 0
    while len(at):
        keep = _KEEP[np.minimum(lens[at] - step, 8)]
        same[at] &= (a[starts[at] + step] & keep) == (b[others[at] + step] & keep)
        step += 8
        at = at[(lens[at] > step) & same[at]]
    for i in np.flatnonzero(lens > HASH_BLOCK).tolist():
        n = lens[i]
        same[i] = np.array_equal(data[starts[i] : starts[i] + n], other[others[i] : others[i] + n])
    return same


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [start, start + len)."""
    first = np.cumsum(lens, dtype=np.int64) - lens
    out = np.repeat(starts - first, lens)
    out += np.arange(len(out))
    return out


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row number (rows ascending), as int64."""
    out = np.zeros(n, dtype=np.int64)
    if len(values):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = np.add.reduceat(values.astype(np.int64), first)
    return out
