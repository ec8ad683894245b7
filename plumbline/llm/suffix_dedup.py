"""Exact substring deduplication with longest-previous-factor arrays.

Every byte covered by a string of `length` bytes that also starts earlier
(smaller document, or same document and earlier position) is removed; the
first copy stays.  The corpus is never sorted as a whole; hashes only propose
which parts of it may repeat, and every removal is read from the longest
previous factors of such parts:

1. Each window of `length` bytes has an anchor: the least hashed gram within
   it.  Equal windows have equal anchors at equal places, so a window can only
   repeat where its anchor's gram repeats.  Consecutive windows with one
   anchor form a run.
2. A run whose hash an earlier run has is taken to follow it.  Runs that
   follow one another in both texts form stretches, which meet the bytes of
   their source: within a task at once, else where the later document is.
3. Different runs that share an anchor go, with their bytes, to the task of
   that anchor.  An anchor with very many different runs is split into its
   single windows, keyed by their content, so no task has to hold a common
   passage's whole surroundings.
4. Wherever such parts meet, they are laid out in document order.  A suffix
   array (prefix doubling as far as `length` asks) and the previous and next
   smaller text positions in suffix order give each window's longest previous
   factor; windows whose factor reaches `length` are later copies.
5. The spans found are joined back to their documents and cut out.

What travels between tasks are packed arrays.  No byte is removed without
equal bytes before it; two different runs of one 64-bit hash and one anchor
could at most hide a later copy.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._text import BYTE_CODE, aside, expand, hash_words, mix, partitions, slices, string_bytes

LENGTH, GRAM = 100, 32
#: Different runs of one anchor within a task that make the anchor a common one.
COMMON = 256
#: Runs that a task holds at a time, with their texts, for its pre-aggregation.
HELD_RUNS = 400_000
#: Bytes of text for each bucket of anchors; documents are dealt to four times as many slots.
BUCKET_BYTES = 8 << 20
#: Bytes whose suffixes are sorted at a time, and of a stretch that are handled in one piece: what a processor's cache holds.
LOT, PIECE = 40_000, 10_000
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_LOW = 22  # bits of a position within a segment
SEGMENT = 1 << 20

RUN, SPAN, ASKED, BYTES, FOLLOW, SOURCE = range(6)
_PLACE = ("doc:i8", "tie:i8", "slot:i4", "pos:i4", "size:i4")
#: Columns of packed arrays by kind of row.
FIELDS = {
    RUN: ("anchor:u8", "content:u8", *_PLACE),
    SPAN: _PLACE,
    ASKED: ("anchor:u8", *_PLACE, "common:i1"),
    BYTES: ("anchor:u8", *_PLACE),
    FOLLOW: (*_PLACE, "sdoc:i8", "stie:i8", "sslot:i4", "spos:i4"),
    SOURCE: _PLACE,
}
PACKED = "bucket int, kind int, slot int, rows long, packed binary, raw binary"
Table = dict[str, np.ndarray]


# ---- packed arrays


@functools.lru_cache(maxsize=1)
def _zstd():
    import zstandard as zstd

    return zstd.ZstdCompressor(level=1), zstd.ZstdDecompressor()


def pack(kind: int, t: Table) -> bytes:
    """Arrays as one compressed block; doc and pos as differences, bytes of equal weight together."""
    out = []
    for f in FIELDS[kind]:
        name, code = f.split(":")
        a = t[name].astype(f"<{code}")
        if name in ("doc", "sdoc"):
            a = np.diff(a, prepend=a.dtype.type(0))
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())
    return _zstd()[0].compress(b"".join(out))


def unpack(kind: int, rows: int, packed: bytes) -> Table:
    raw, at, out = np.frombuffer(_zstd()[1].decompress(packed), np.uint8), 0, {}
    for f in FIELDS[kind]:
        name, code = f.split(":")
        width = int(code[1])
        a = np.ascontiguousarray(raw[at : at + rows * width].reshape(width, rows).T).reshape(-1).view(f"<{code}")
        out[name] = np.cumsum(a, dtype=np.int64) if name in ("doc", "sdoc") else a
        at += rows * width
    return out


def join(tables: list[Table], kind: int) -> Table:
    return {f.split(":")[0]: np.concatenate([t[f.split(":")[0]] for t in tables]) if tables else np.zeros(0, f"<{f.split(':')[1]}") for f in FIELDS[kind]}


def take(t: Table, at: np.ndarray) -> Table:
    return {k: v[at] for k, v in t.items()}


def size(t: Table) -> int:
    return len(t["doc"])


def packed_rows(kind: int, t: Table, bucket: np.ndarray, raw: list | None = None, slot: int = 0) -> Iterator[tuple]:
    """One (bucket, kind, slot, rows, packed, raw) row for each bucket; rows in document order within it."""
    order = np.lexsort((t["pos"], t["tie"], t["doc"], bucket))
    t, bucket = take(t, order), bucket[order]
    if not len(bucket):
        return
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        part = take(t, slice(a, b))
        yield int(bucket[a]), kind, slot, b - a, pack(kind, part), _zstd()[0].compress(b"".join(raw[i] for i in order[a:b])) if raw is not None else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("bucket", pa.int32()), ("kind", pa.int32()), ("slot", pa.int32()), ("rows", pa.int64()), ("packed", pa.binary()), ("raw", pa.binary())]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def _by_kind(batches: Iterable[pa.RecordBatch]) -> dict[int, list[tuple]]:
    """(slot, rows, packed, raw) of each row, by kind."""
    found: dict[int, list[tuple]] = {}
    for b in batches:
        for kind, *rest in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "slot", "rows", "packed", "raw")), strict=True):
            found.setdefault(kind, []).append(tuple(rest))
    return found


def _all(found: dict[int, list[tuple]], kind: int) -> Table:
    return join([unpack(kind, n, p) for _, n, p, _ in found.get(kind, [])], kind)


# ---- runs


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = SEGMENT + (64 << 10)
    one = lambda p: np.r_[np.uint64(1), np.cumprod(np.full(n, p, dtype=np.uint64))]
    return one(_P), one(_P_INVERSE)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window start, anchor hash and content hash of each run, in order; the buffer is a segment at most."""
    empty = np.zeros(0, np.int64)
    starts = expand(offsets[:-1], np.maximum(0, np.diff(offsets) - length + 1))
    if not len(starts):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    power, inverse = _powers()
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * power[:n], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    key = (grams >> np.uint64(_LOW) << np.uint64(_LOW)) | np.arange(len(grams), dtype=np.uint64)
    width, least = 1, key
    wide = length - gram + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    anchor = (np.minimum(least[starts], least[starts + wide - width]) & np.uint64((1 << _LOW) - 1)).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.r_[first[1:], len(starts)] - 1]
    row = np.searchsorted(offsets, lo, side="right") - 1
    end = hi + length
    content = mix((total[end] - total[lo]) * inverse[lo] + (end - lo).astype(np.uint64))
    return row, lo, hi, grams[anchor[first]], content


def segments(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, doc, tie, slot, base) of chunks of whole texts; longer texts in segments that overlap by length - 1 bytes."""
    for part in slices(batches, "text", SEGMENT):
        data, offsets = string_bytes(part.column(part.schema.get_field_index("text")))
        ids = [part.column(part.schema.get_field_index(c)).to_numpy() for c in ("__doc", "__tie", "__slot")]
        if len(data) <= SEGMENT:
            yield data, offsets, *ids, np.zeros(len(ids[0]), np.int64)
            continue
        for i in range(len(ids[0])):
            text = data[offsets[i] : offsets[i + 1]]
            for at in range(0, max(1, len(text) - length + 1), SEGMENT - length):
                cut = text[at : at + SEGMENT - 1]
                yield cut, np.array([0, len(cut)]), *(x[i : i + 1] for x in ids), np.array([at])


def first_of(t: Table, keys: list[str]) -> np.ndarray:
    """Order t by keys, document and position in place, once where a document is listed twice; True for the first of equal keys."""
    order = np.lexsort((t["pos"], t["tie"], t["doc"], *(t[k] for k in reversed(keys))))
    t.update(take(t, order))
    once = np.ones(len(order), dtype=bool)
    if len(order):
        once[1:] = np.logical_or.reduce([t[k][1:] != t[k][:-1] for k in (*keys, "doc", "tie", "pos")])
    if not once.all():
        t.update(take(t, once))
        order = order[once]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([t[k][1:] != t[k][:-1] for k in keys])
    return new


def group_sizes(new: np.ndarray) -> np.ndarray:
    """For each entry the size of its group; `new` marks the groups' first entries."""
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(new)])
    return np.repeat(n, n)


# ---- suffix order and longest previous factors


def _sorted(keys: list[np.ndarray], bits: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of positions by several numbers below 2**bits (the first below 2**first), ties by position, and where a key differs from the one before."""
    n = len(keys[0])
    at = max(1, n.bit_length())
    if first + bits * (len(keys) - 1) + at <= 64:  # keys and position in one number: a plain sort
        packed = keys[0].astype(np.uint64)
        for k in keys[1:]:
            packed = packed << np.uint64(bits) | k.astype(np.uint64)
        packed = np.sort(packed << np.uint64(at) | np.arange(n, dtype=np.uint64))
        order, key = (packed & np.uint64((1 << at) - 1)).astype(np.int64), packed >> np.uint64(at)
        return order, key[1:] != key[:-1]
    order = np.lexsort(keys[::-1])
    return order, np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])


def prefix_ranks(data: np.ndarray, depth: int) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """Ranks of all suffixes by their first 4, 4r, 4rr, ... bytes as far as `depth` (4 at least), 0 past the end; and r, 3 for short texts, else 2."""
    n, span = len(data), 4
    bits = n.bit_length()
    ratio = 3 if 4 * bits <= 64 else 2
    head = np.zeros(n + 4, dtype=np.int64)
    head[:n] = data
    head[:n] += 1
    pairs = head[:-1] << 9 | head[1:]
    levels, keys, width, first = [], [pairs[:n], pairs[2 : n + 2]], 18, 18
    while True:
        order, new = _sorted(keys, width, first)
        rank = np.zeros(n + ratio * max(depth, 4), dtype=np.int32 if n < 1 << 30 else np.int64)
        rank[order] = np.r_[1, 1 + np.cumsum(new)] if n else 0
        levels.append((span, rank))
        if ratio * span > depth:
            return ratio, levels
        keys, width, first = [rank[k * span : n + k * span] for k in range(ratio)], bits, bits
        span *= ratio


def nearest_smaller(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the previous and the next smaller value (-1 and len(a) for none), by pointer jumping."""

    def previous(v: np.ndarray) -> np.ndarray:
        v = np.r_[np.iinfo(v.dtype).min, v]
        p = np.arange(-1, len(v) - 1, dtype=v.dtype)
        p[0] = 0
        todo = np.flatnonzero(v[:-1] > v[1:]) + 1
        while len(todo):
            at = p[p[todo]]
            p[todo] = at
            todo = todo[v[at] > v[todo]]
        return p[1:] - 1

    a = a.astype(np.int32) if len(a) < 1 << 30 else a
    return previous(a), len(a) - 1 - previous(a[::-1])[::-1]


def previous_factors(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each start (ascending) the length, up to `depth`, of the longest string that also begins at an earlier start; overlaps allowed.

    The longest previous factor at a position is shared with the previous or
    the next smaller position in suffix order.
    """
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.int64)
    ratio, levels = prefix_ranks(data, depth)
    span, rank = levels[-1]
    # Suffix order as far as `depth` bytes tell; ties in text order.
    rest = max(0, depth - span)
    order, _ = _sorted([rank[starts + k] for k in sorted({0, min(span, rest), rest})], n.bit_length(), n.bit_length())
    out = np.zeros(len(starts), dtype=np.int64)
    for near in nearest_smaller(order):
        some = np.flatnonzero((near >= 0) & (near < len(order)) & (out[order] < depth))
        out[order[some]] = np.maximum(out[order[some]], _common(data, ratio, levels, starts[order[some]], starts[order[near[some]]], depth))
    return out


def _common(data: np.ndarray, ratio: int, levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at i and j, up to `depth`."""
    length = np.zeros(len(i), dtype=np.int64)
    most = np.minimum(depth, len(data) - np.maximum(i, j))
    for span, rank in reversed(levels):
        for _ in range(ratio - 1):
            at = np.minimum(length, most)
            length += span * (rank[i + at] == rank[j + at])
    length = np.minimum(length, most)
    for _ in range(3):
        at = np.flatnonzero(length < most)
        at = at[data[i[at] + length[at]] == data[j[at] + length[at]]]
        length[at] += 1
    return length


def longest_previous_factor(data: bytes) -> np.ndarray:
    """The length of the longest string at each position that also starts earlier (overlaps allowed)."""
    return previous_factors(np.frombuffer(data, np.uint8), np.arange(len(data)), len(data))


# ---- parts that may repeat: tables with doc, tie, slot, pos, size and at, the place of their bytes in a buffer


def later_copies(data: np.ndarray, parts: Table, length: int) -> Table:
    """Spans of the parts' windows whose longest previous factor reaches `length`; no window is in two parts."""
    parts = take(parts, np.lexsort((parts["pos"], parts["tie"], parts["doc"])))
    sizes = parts["size"].astype(np.int64)
    text = data[expand(parts["at"], sizes)]
    n = sizes - length + 1
    row = np.repeat(np.arange(len(n)), n)
    shift = expand(np.zeros(len(n), np.int64), n)
    hit = previous_factors(text, (np.cumsum(sizes) - sizes)[row] + shift, length) >= length
    row, shift = row[hit], shift[hit]
    new = np.r_[True, (row[1:] != row[:-1]) | (shift[1:] != shift[:-1] + 1)] if len(row) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(row)][: len(head)] - 1
    span = take(parts, row[head])
    span["pos"], span["at"] = (span["pos"] + shift[head]).astype(np.int32), span["at"] + shift[head]
    span["size"] = (shift[last] - shift[head] + length).astype(np.int32)
    return span


def merged(parts: Table, length: int) -> Table:
    """Parts whose windows follow each other or overlap as one."""
    place = parts["at"] - parts["pos"]
    order = np.lexsort((parts["pos"], place, parts["tie"], parts["doc"]))
    t, place = take(parts, order), place[order]
    group = np.cumsum(np.r_[False, (t["doc"][1:] != t["doc"][:-1]) | (t["tie"][1:] != t["tie"][:-1]) | (place[1:] != place[:-1])]) << 32
    end = np.maximum.accumulate(group + t["pos"] + t["size"])
    new = np.r_[True, (group + t["pos"])[1:] > end[:-1] - length + 1]
    head = np.flatnonzero(new)
    out = take(t, head)
    out["size"] = (end[np.r_[head[1:], len(end)] - 1] - group[head] - out["pos"]).astype(np.int32)
    return out


def stretches(t: Table, length: int) -> Table:
    """Runs that follow each other, and whose sources do, as one; t also has sdoc, stie, sslot and spos, and places at and sat."""
    t = take(t, np.lexsort((t["pos"], t["tie"], t["doc"])))
    if not size(t):
        return t
    new = np.ones(size(t), dtype=bool)
    new[1:] = t["pos"][1:] > t["pos"][:-1] + t["size"][:-1] - length + 1
    for a in (t["doc"], t["tie"], t["sdoc"], t["stie"], t["pos"] - t["spos"], t["at"] - t["pos"], t["sat"] - t["spos"]):
        new[1:] |= a[1:] != a[:-1]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(new)] - 1
    out = take(t, head)
    out["size"] = (t["pos"][last] + t["size"][last] - t["pos"][head]).astype(np.int32)
    return out


def _sources(t: Table) -> Table:
    return {k: t["s" + k] for k in ("doc", "tie", "slot", "pos", "at")} | {"size": t["size"]}


def confirmed(data: np.ndarray, t: Table, length: int) -> Table:
    """Spans of later copies in stretches and their sources, lot by lot."""
    t = stretches(t, length)
    # Pieces of long stretches overlap, so that each window is in one.
    n = -(-(t["size"].astype(np.int64) - length + 1) // PIECE)
    row = np.repeat(np.arange(len(n)), n)
    shift = expand(np.zeros(len(n), np.int64), n) * PIECE
    t = take(t, row)
    for k in ("pos", "spos", "at", "sat"):
        t[k] = t[k] + shift
    t["size"] = np.minimum(t["size"] - shift, PIECE + length - 1)
    t = take(t, np.lexsort((t["spos"], t["stie"], t["sdoc"])))
    lot = np.cumsum(2 * t["size"]) // LOT
    spans = []
    for k in np.unique(lot).tolist():
        some = take(t, slice(*np.searchsorted(lot, [k, k + 1]).tolist()))
        both = {k: np.concatenate([some[k], v]) for k, v in _sources(some).items()}
        spans.append(later_copies(data, merged(both, length), length))
    return {k: np.concatenate([x[k] for x in spans]) if spans else t[k][:0] for k in ("doc", "tie", "slot", "pos", "size", "at")}


# ---- the stages


def _mark(docs: DataFrame, slots: int) -> DataFrame:
    """Add the key a document is known by: its id, a tie-break where ids repeat, and the slot that it is dealt to."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    tie = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    return docs.withColumns({"__doc": doc, "__tie": tie, "__slot": F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")})


def _followers(t: Table, new: np.ndarray) -> Table:
    """The rows of t that aren't the first of their group, each with the first as its source; `new` marks the firsts."""
    later = np.flatnonzero(~new)
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[later] if len(later) else later
    own = take(t, later)
    return own | {"s" + k: t[k][first] for k in ("doc", "tie", "slot", "pos", "at") if k in t}


def _covered(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the places a to b - 1 lie within any of the intervals lo to hi - 1; nothing is as long as the text."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order])
    head = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]]) if len(lo) else np.zeros(0, np.int64)
    lo, hi = lo[head], end[np.r_[head[1:], len(end)][: len(head)] - 1]
    before = np.r_[0, np.cumsum(hi - lo)]

    def below(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(lo, x, side="right")
        return before[k] - np.where(k > 0, np.maximum(hi[k - 1] - x, 0), 0) if len(lo) else np.zeros(len(x), np.int64)

    return below(b) - below(a)


def _collect_runs(length: int, gram: int, buckets: int, most: int, held: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId() % buckets
        parts, texts, n, base_at = [], [], 0, 0
        for data, offsets, doc, tie, slot, base in segments(batches, length):
            row, lo, hi, anchor, content = runs(data, offsets, length, gram)
            parts.append({"anchor": anchor, "content": content, "doc": doc[row], "tie": tie[row], "slot": slot[row], "pos": (lo - offsets[row] + base[row]).astype(np.int32), "size": (hi - lo + length).astype(np.int32), "at": lo + base_at})
            texts.append(data)
            n += len(row)
            base_at += len(data)
            if n >= held or base_at >= 64 * held:
                yield from _first_runs(parts, texts, here, length, buckets, most)
                parts, texts, n, base_at = [], [], 0, 0
        if parts:
            yield from _first_runs(parts, texts, here, length, buckets, most)

    return run


def _first_runs(parts: list[Table], texts: list[np.ndarray], here: int, length: int, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pre-aggregate a task's runs: spans of later copies within the task, requests of common anchors, and the runs that go on."""
    t = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    data = np.concatenate(texts)
    new = first_of(t, ["anchor", "content"])
    follow = _followers(t, new)
    if size(follow):
        spans = confirmed(data, follow, length)
        yield _batch(list(packed_rows(SPAN, spans, np.full(size(spans), here))))
        # What has been found needs to go no further: the first copy does.
        windows = t["size"] - length + 1
        t = take(t, new | (_covered(spans["at"], spans["at"] + spans["size"] - length + 1, t["at"], t["at"] + windows) < windows))
    new = np.r_[True, t["anchor"][1:] != t["anchor"][:-1]] if size(t) else np.zeros(0, bool)
    common = group_sizes(new) > most
    asked = take(t, common) | {"common": np.ones(int(common.sum()), np.int8)}
    yield _batch(list(packed_rows(ASKED, asked, np.full(int(common.sum()), here))))
    # Of a common anchor one run of size 0 goes on, to say so to the runs of other tasks.
    t["size"] = np.where(common, 0, t["size"])
    t = take(t, ~common | new)
    yield _batch(list(packed_rows(RUN, t, (t["anchor"] >> np.uint64(20)).astype(np.int64) % buckets)))


def _match_runs(most: int):
    """Of each anchor: later runs of equal content follow the first; different runs are asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _by_kind(batches)
        spans, asked, t = (_all(found, kind) for kind in (SPAN, ASKED, RUN))
        told = np.unique(t["anchor"][t["size"] == 0])
        t = take(t, t["size"] > 0)
        new = first_of(t, ["anchor", "content"])
        follow = _followers(t, new)
        t = take(t, new)
        new = np.r_[True, t["anchor"][1:] != t["anchor"][:-1]] if size(t) else np.zeros(0, bool)
        many = group_sizes(new)
        common = np.isin(t["anchor"], told) | (many > 16 * most)
        keep = common | (many > 1)
        asked = {k: np.concatenate([asked[k], v]) for k, v in (take(t, keep) | {"common": common[keep].astype(np.int8)}).items() if k in asked}
        for kind, whole, to in ((SPAN, spans, "slot"), (ASKED, asked, "slot"), (FOLLOW, follow, "sslot")):
            yield _batch(list(packed_rows(kind, whole, whole[to])))

    return run


def _fetch(length: int, buckets: int):
    """At a slot: bytes of the runs asked for, to their anchors, and of the sources of stretches, to the slots of these."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        me = key[0].as_py()
        found = _by_kind(right.to_batches())
        out = [(n % buckets, SPAN, me, rows, p, None) for n, (_, rows, p, _) in enumerate(found.get(SPAN, []))]
        ask, follow = _all(found, ASKED), _all(found, FOLLOW)
        if left.num_rows and (size(ask) or size(follow)):
            data, offsets, row_of = _index(left)
            raw = data.tobytes()
        if size(ask) and left.num_rows:
            ask["at"] = offsets[row_of(ask)] + ask["pos"]
            runs_ = take(ask, ask["common"] == 0)
            # Windows of common anchors, each under its own content; of equal ones here the first.
            many = np.flatnonzero(ask["common"])
            n = ask["size"][many] - length + 1
            row = np.repeat(many, n)
            shift = expand(np.zeros(len(n), np.int64), n)
            w = take(ask, row) | {"pos": (ask["pos"][row] + shift).astype(np.int32), "size": np.full(len(row), length, np.int32), "at": ask["at"][row] + shift}
            w["anchor"] = hash_words(data, w["at"], w["at"] + length)
            new = first_of(w, ["anchor"])
            spans = confirmed(data, _followers(w, new), length)
            out += packed_rows(SPAN, spans, np.full(size(spans), me % buckets), slot=me)
            w = take(w, new)
            whole = {f: np.concatenate([runs_[f], w[f]]) for f in ("anchor", "doc", "tie", "slot", "pos", "size", "at")}
            out += packed_rows(BYTES, whole, (whole["anchor"] >> np.uint64(20)).astype(np.int64) % buckets, _cut(raw, whole))
        if size(follow) and left.num_rows:
            follow["sat"] = offsets[row_of(_sources(follow | {"sat": follow["spos"]}))] + follow["spos"]
            follow = stretches(follow | {"at": follow["pos"]}, length)
            for slot in np.unique(follow["slot"]).tolist():
                mine = take(follow, follow["slot"] == slot)
                out += packed_rows(FOLLOW, mine, np.full(size(mine), slot % buckets), slot=slot)
                if slot != me:
                    parts = merged(_sources(mine), length)
                    out += packed_rows(SOURCE, parts, np.full(size(parts), slot % buckets), _cut(raw, parts), slot=slot)
        return pa.Table.from_batches([_batch(out)])

    return run


def _cut(raw: bytes, t: Table) -> list[bytes]:
    return [raw[a : a + n] for a, n in zip(t["at"].tolist(), t["size"].tolist(), strict=True)]


def _index(left: pa.Table):
    """The documents' bytes and offsets, and a function that gives the row of each entry of a table; of documents listed twice the first row."""
    data, offsets = string_bytes(left.column("text"))
    doc, tie = left.column("__doc").to_numpy(), left.column("__tie").to_numpy()
    order = np.lexsort((tie, doc))
    key = np.empty(len(doc), dtype=[("d", "i8"), ("t", "i8")])
    key["d"], key["t"] = doc[order], tie[order]

    def row_of(t: Table) -> np.ndarray:
        want = np.empty(size(t), dtype=key.dtype)
        want["d"], want["t"] = t["doc"], t["tie"]
        return order[np.minimum(np.searchsorted(key, want), len(key) - 1)]

    return data, offsets, row_of


def _with_bytes(found: dict[int, list[tuple]], kind: int) -> tuple[Table, np.ndarray]:
    """All rows of a kind with their place in the bytes that came with them."""
    t = _all(found, kind)
    data = np.frombuffer(b"".join(_zstd()[1].decompress(raw) for *_, raw in found.get(kind, [])), np.uint8)
    t["at"] = np.cumsum(t["size"], dtype=np.int64) - t["size"]
    return t, data


def _match_bytes(length: int):
    """Later copies among the runs of each anchor; what is for a slot alone goes on to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _by_kind(batches)
        yield _batch([(slot, kind, slot, *rest) for kind in (SPAN, FOLLOW, SOURCE) for slot, *rest in found.get(kind, [])])
        t, data = _with_bytes(found, BYTES)
        if size(t):
            # Equal anchors need to meet, others need not: groups of anchors of some size are sorted at a time.
            order = np.argsort(t["anchor"], kind="stable")
            edge = np.flatnonzero(np.r_[True, t["anchor"][order][1:] != t["anchor"][order][:-1]])
            amount = np.add.reduceat(t["size"][order].astype(np.int64), edge)
            lot = np.repeat(np.cumsum(amount) // LOT, np.diff(np.r_[edge, len(order)]))
            for k in np.unique(lot).tolist():
                spans = later_copies(data, take(t, order[slice(*np.searchsorted(lot, [k, k + 1]).tolist())]), length)
                yield _batch(list(packed_rows(SPAN, spans, spans["slot"])))

    return run


def _followed(found: dict[int, list[tuple]], data: np.ndarray, offsets: np.ndarray, row_of, me: int, length: int) -> Table:
    """Spans of the stretches of a slot's documents, by their sources' bytes."""
    t = _all(found, FOLLOW)
    if not size(t):
        return _all({}, SPAN)
    source, raw = _with_bytes(found, SOURCE)
    t["at"] = offsets[row_of(t)] + t["pos"]
    here = t["sslot"] == me  # sources among the slot's own documents
    t["sat"] = np.zeros(size(t), np.int64)
    t["sat"][here] = offsets[row_of(_sources(take(t, here)))] + t["spos"][here]
    if not here.all():
        key = np.empty(size(source), dtype=[("d", "i8"), ("t", "i8"), ("p", "i8")])
        key["d"], key["t"], key["p"] = source["doc"], source["tie"], source["pos"]
        order = np.argsort(key)
        want = np.empty(int((~here).sum()), dtype=key.dtype)
        want["d"], want["t"], want["p"] = t["sdoc"][~here], t["stie"][~here], t["spos"][~here]
        part = order[np.searchsorted(key[order], want, side="right") - 1]
        t["sat"][~here] = len(data) + source["at"][part] + t["spos"][~here] - source["pos"][part]
    spans = confirmed(np.concatenate([data, raw]), t, length)
    return take(spans, spans["slot"] == me)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, prefix: str = "", common: int = COMMON, held: int = HELD_RUNS) -> DataFrame:
    """Documents without bytes that a string of `length` bytes repeats from earlier on.

    Returns all columns of `docs` (doc_id alone unless with_text), the text
    without the removed bytes (halves of cut characters dropped), and n_bytes,
    n_removed, n_spans (maximal removed runs) and kept_sha256 of the remaining
    bytes (`prefix` goes before these names, which are replaced in `docs`).  A
    null text counts as empty and stays null; a null doc_id comes
    before all others.  Rows that repeat doc_id and text are one document
    listed twice and give equal rows; rows that repeat only doc_id are ordered
    by a hash of their text.  An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    others, kept = aside(docs, docs.columns if with_text else [], ("doc_id", "text", *(prefix + c for c in added)))
    names = ["doc_id", *(["text"] if with_text else []), *(c for c, _ in kept)]
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"), *others)
    # Buckets of some MB, however few shuffle partitions the session asks for.
    n = max(partitions(spark), -(-(frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    marked = _mark(frame, 4 * n)
    found = marked.select("text", "__doc", "__tie", "__slot").mapInArrow(_collect_runs(length, gram, n, common, held), PACKED)
    matched = found.repartitionById(n, "bucket").mapInArrow(_match_runs(common), PACKED)
    fetched = marked.groupBy("__slot").cogroup(matched.groupBy("bucket")).applyInArrow(_fetch(length, n), PACKED)
    spans = fetched.repartitionById(n, "bucket").mapInArrow(_match_bytes(length), PACKED)
    out = StructType(frame.select(*names).schema.fields + StructType.fromDDL(", ".join(f"{c} {k}" for c, k in zip(added, ("long", "long", "long", "string"), strict=True))).fields)

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = to_arrow_schema(out)
        if not left.num_rows:
            return schema.empty_table()
        found = _by_kind(right.to_batches())
        data, offsets, row_of = _index(left)
        t = _all(found, SPAN)
        more = _followed(found, data, offsets, row_of, key[0].as_py(), length)
        t = {k: np.concatenate([v, more[k]]) for k, v in t.items()}
        rows = left.num_rows
        sizes = np.diff(offsets)
        gone = np.zeros(len(data) + 1, dtype=np.int32)
        if size(t):
            # A document listed twice has its spans at every listing.
            doc, tie = left.column("__doc").to_numpy(), left.column("__tie").to_numpy()
            alike = np.unique(np.stack([doc, tie], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            first = np.zeros(alike.max() + 1, np.int64)
            first[alike[::-1]] = np.arange(rows)[::-1]
            row, inside = row_of(t), t["pos"]
            by_class = np.argsort(alike[row], kind="stable")
            cls = alike[row][by_class]
            lo, hi = np.searchsorted(cls, alike, side="left"), np.searchsorted(cls, alike, side="right")
            pick = by_class[expand(lo, hi - lo)]
            start = np.repeat(offsets[:-1], hi - lo) + inside[pick]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + t["size"][pick], -1)
        removed = np.cumsum(gone[:-1]) > 0
        fresh = removed.copy()
        fresh[1:] &= ~removed[:-1]
        edge = offsets[:-1][sizes > 0]
        fresh[edge] = removed[edge]
        total, spans_ = np.r_[0, np.cumsum(removed)], np.r_[0, np.cumsum(fresh)]
        n_removed, n_spans = total[offsets[1:]] - total[offsets[:-1]], spans_[offsets[1:]] - spans_[offsets[:-1]]
        raw, texts, digests = data.tobytes(), [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            kept = raw[a:b] if not n_removed[i] else data[a:b][~removed[a:b]].tobytes()
            digests.append(sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode("utf-8", "ignore"))
        columns = {c: left.column(c) for c in names}
        if with_text:
            null = left.column("text").is_null().to_pylist()
            columns["text"] = pa.array([None if z else x for z, x in zip(null, texts, strict=True)], pa.string())
        columns |= dict(zip(added, map(pa.array, (sizes, n_removed, n_spans, digests)), strict=True))
        return pa.table({f.name: columns[f.name].cast(f.type) for f in schema}, schema=schema)

    done = marked.groupBy("__slot").cogroup(spans.groupBy("bucket")).applyInArrow(cut, out)
    mine = {"doc_id": "doc_id"} | ({"text": "text"} if with_text else {}) | {name: c for c, name in kept}
    order = [c for c in docs.columns if c in mine] if with_text else ["doc_id"]
    return done.select(*(F.col(mine[c]).alias(c) for c in order), *(F.col(c).alias(prefix + c) for c in added))
