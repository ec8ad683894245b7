"""Alignment of two tokenizers over the same bytes: byte-level ids (A) and sentence pieces (B).

A text is cut into units, each of spaces and what follows them, at places that
neither tokenizer's tokens span; each different unit is encoded by both
libraries once per worker.  Over the bytes of new units, np.repeat of token
numbers gives each byte's owner in A and in B: consecutive different pairs of
owners are the overlaps, and places where both owners change are the cuts of
groups.  As a unit's ends are cuts, a document's groups and links are those of
its units in order.

How many documents hold an id pair is counted from each document's different
pairs, summed in every task before they are shuffled.  The counts go back to
the documents in blocks of bounded size, one pass of the stored pairs each.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm._text import expand, row_sums, slices, string_bytes
from plumbline.llm.bpe import byte_letters
from plumbline.llm.tokens import load
from plumbline.storage import shared_dir

#: Pairs whose counts are sent to the tasks at a time (13 bytes each).
PAIR_BLOCK = 1_000_000
#: Units and bytes of units that a worker remembers; longer units are encoded each time.
UNITS, UNIT_BYTES, LONG_UNIT = 400_000, 24 << 20, 128

_ID_BITS = 32


@functools.lru_cache(maxsize=2)
def byte_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; the strings of special tokens stand for themselves."""
    tok = load(path)
    value = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    n = tok.get_vocab_size(with_added_tokens=True)
    return [b"".join(value.get(c, c.encode()) for c in tok.id_to_token(i) or "") for i in range(n)]


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """A sentencepiece model and the bytes of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    joined = [p for p in names if "▁" in p.lstrip("▁")]
    if joined:
        raise ValueError(f"pieces that go on over a space can't be aligned unit by unit: {joined[:3]}")
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


def owners(lengths: np.ndarray) -> np.ndarray:
    """Token number that owns each byte, of tokens of these lengths."""
    return np.repeat(np.arange(len(lengths)), lengths)


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cut) of all token pairs whose byte ranges overlap, in byte order; cut says that a group begins with the pair."""
    a, b = owners(a_lengths), owners(b_lengths)
    new_a, new_b = np.ones(len(a), bool), np.ones(len(b), bool)
    new_a[1:], new_b[1:] = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.flatnonzero(new_a | new_b)
    return a[at], b[at], (new_a & new_b)[at]


class Units:
    """Alignments of the units met so far: ids, groups and links of each."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.a_bytes = load(a_path), byte_tokens(a_path)
        self.a.encode_special_tokens = True
        self.b, self.b_bytes = pieces(b_path)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (list(map(str, range(len(t)))) for t in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)
        self.same = np.zeros(0, dtype=bool)
        self.codes, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _same(ids: list[list[int]], table: list[bytes], sizes: np.ndarray, units: list[bytes], wanted: np.ndarray) -> np.ndarray:
        """Do each unit's ids give its bytes back?"""
        flat, counts = _flat(ids)
        if np.array_equal(row_sums(sizes[flat], np.repeat(np.arange(len(units)), counts), len(units)), wanted) and b"".join(map(table.__getitem__, flat.tolist())) == b"".join(units):
            return np.ones(len(units), dtype=bool)
        return np.array([b"".join(map(table.__getitem__, mine)) == u for mine, u in zip(ids, units, strict=True)], dtype=bool)

    def _add(self, units: list[bytes]) -> None:
        """Encode and align units; each begins with a space, which B adds by itself."""
        texts = [u.decode() for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        if b" " in units:  # a text's last space, to which B adds none
            b[units.index(b" ")] = self.b.encode("a ")[len(self.b.encode("a")) :]
        wanted = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        right_a, right_b = self._same(a, self.a_bytes, self.a_sizes, units, wanted), self._same(b, self.b_bytes, self.b_sizes, units, wanted)
        same = right_a & right_b
        for k in np.flatnonzero(~same).tolist():
            a[k], b[k] = [], []
        (flat_a, n_a), (flat_b, n_b) = _flat(a), _flat(b)
        at_a, at_b, cut = overlaps(self.a_sizes[flat_a], self.b_sizes[flat_b])
        unit_of = np.repeat(np.arange(len(units)), n_a)[at_a]
        n_links, n_groups = (np.bincount(x, minlength=len(units)) for x in (unit_of, unit_of[cut]))
        # A group begins with a pair where both owners change: from there to the next one are its ids.
        from_a, from_b = np.r_[at_a[cut], len(flat_a)].tolist(), np.r_[at_b[cut], len(flat_b)].tolist()
        text_a, text_b = list(map(self.a_names.__getitem__, flat_a.tolist())), list(map(self.b_names.__getitem__, flat_b.tolist()))
        made = [
            f"{text_a[p]}|{text_b[q]}" if p2 - p == 1 == q2 - q else f"{','.join(text_a[p:p2])}|{','.join(text_b[q:q2])}"
            for p, p2, q, q2 in zip(from_a[:-1], from_a[1:], from_b[:-1], from_b[1:], strict=True)
        ]
        ends = np.cumsum(n_groups).tolist()
        self.groups += [";".join(made[e - n : e]) for e, n in zip(ends, n_groups.tolist(), strict=True)]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.same = np.concatenate([self.same, same])
        self.start = np.concatenate([self.start, len(self.codes) + np.cumsum(n_links) - n_links])
        self.codes = np.concatenate([self.codes, (flat_a[at_a] << _ID_BITS) | flat_b[at_b]])

    def align(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text, given as bytes: its numbers (A ids, B ids, groups, links) and groups; of all links the code and the text's number."""
        n = len(offsets) - 1
        some = np.flatnonzero(np.diff(offsets))
        raw = data.tobytes()
        spaced = b"".join(b" " + raw[a:b] for a, b in zip(offsets[some].tolist(), offsets[some + 1].tolist(), strict=True))
        begins = offsets[some] + np.arange(len(some))
        starts = unit_starts(np.frombuffer(spaced, np.uint8), begins)
        ends = np.r_[starts[1:], len(spaced)][: len(starts)]  # none where all texts are empty
        units = [spaced[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        rows = some[np.searchsorted(begins, starts, side="right") - 1]
        if len(self.number) > UNITS or self.held > UNIT_BYTES:
            self.clear()
        kept, number = len(self.groups), self.number
        new = [u for u in dict.fromkeys(units) if u not in number]
        for k, u in enumerate(new):
            number[u] = kept + k
        self._add(new)
        seq = np.fromiter(map(number.__getitem__, units), dtype=np.int64, count=len(units))
        for u in new:  # forgotten by name, as it is unlikely to come again
            if len(u) > LONG_UNIT:
                del number[u]
        self.held += sum(map(len, new))
        bad = np.zeros(n, dtype=bool)
        bad[rows[~self.same[seq]]] = True
        keep = ~bad[rows]
        seq, rows = seq[keep], rows[keep]
        sums = np.stack([row_sums(self.counts[seq, k], rows, n) for k in range(4)], axis=1)
        at = np.searchsorted(rows, np.arange(n + 1)).tolist()
        names = list(map(self.groups.__getitem__, seq.tolist()))
        groups = [";".join(names[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        links = self.counts[seq, 3]
        return sums, groups, self.codes[expand(self.start[seq], links)], np.repeat(rows, links)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64, count=int(counts.sum())), counts


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places where a unit begins: a text's begin, or a space after a sign that is no white space (ASCII, or of two bytes and not below U+00C0)."""
    if not len(data):
        return np.zeros(0, np.int64)
    before = np.r_[np.uint8(0), data[:-1]]
    two = np.r_[np.uint8(0), before[:-1]]
    solid = (before > 0x20) & (before < 0x7F) | (before >= 0x80) & (before < 0xC0) & (two >= 0xC3) & (two < 0xE0)
    first = (data == 0x20) & solid
    first[begins] = True
    return np.flatnonzero(first)


@functools.lru_cache(maxsize=1)
def _units(a_path: str, b_path: str) -> Units:
    return Units(a_path, b_path)


def different(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different codes of each row (rows ascending) with how often they are there, and how many each row has."""
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.r_[first, len(codes)]), np.bincount(rows[first], minlength=n)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def link(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_groups: bool = True) -> DataFrame:
    """Of each row the columns `keep`, n_a, n_b, n_groups, n_links, groups or (without them) groups_sha256, and its different links with how often each is there.

    A link's code is the A id times 2**32 and the B id.  Texts that are null,
    empty or not given back whole by either tokenizer have no tokens: numbers
    are 0 and the groups empty.  Repeated rows give equal rows.
    """
    frame = docs.select(*keep, text)
    shown = "groups" if with_groups else "groups_sha256"
    out = StructType(frame.select(*keep).schema.fields + StructType.fromDDL(f"n_a long, n_b long, n_groups long, n_links long, {shown} string, link array<bigint>, times array<int>").fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, schema = _units(a_path, b_path), to_arrow_schema(out)
        for part in slices(batches, text):
            data, offsets = string_bytes(part.column(part.num_columns - 1))
            sums, groups, codes, rows = units.align(data, offsets)
            codes, times, sizes = different(codes, rows, part.num_rows)
            if not with_groups:
                groups = [sha256(g.encode()).hexdigest() if g else "" for g in groups]
            made = [*(pa.array(c) for c in sums.T), pa.array(groups, pa.string()), _lists(codes, sizes, pa.int64()), _lists(times, sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(m.cast(f.type) for m, f in zip(made, list(schema)[len(keep) :], strict=True))], schema=schema)

    return frame.mapInArrow(run, out)


def link_counts(linked: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(link, n, best): in how many rows each link is, and whether no link of its A id is in more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            codes = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            keys, inverse = np.unique(np.concatenate([keys, codes]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([n, np.ones(len(codes), np.int64)]), minlength=len(keys)).astype(np.int64)
            if len(keys) > most:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["link", "n"])
                keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["link", "n"])

    whole = linked.select("link").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    counts = whole.withColumn("a", F.shiftright("link", _ID_BITS))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def with_counts(linked: DataFrame, counts: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """`linked` with n_best and count_sum in place of its links.

    Counts are sent to the tasks in blocks of about `block` links; the rows
    pass each block in turn, within one stage.
    """
    spark = linked.sparkSession
    n_blocks = max(1, -(-counts.count() // block))
    frame = linked.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    schema = frame.schema
    for k in range(n_blocks):
        mine = counts.filter(F.pmod(F.xxhash64("link"), F.lit(n_blocks)) == k).toArrow()
        keys = mine.column("link").to_numpy()
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order], mine.column("n").to_numpy()[order], mine.column("best").to_numpy()[order]))

        def run(batches: Iterable[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            keys, n, best = table.value
            for batch in batches:
                at = {name: batch.schema.get_field_index(name) for name in ("link", "times", "n_best", "count_sum")}
                codes, times = (batch.column(at[c]).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("link", "times"))
                sizes = np.diff(batch.column(at["link"]).offsets.to_numpy())
                rows = np.repeat(np.arange(batch.num_rows), sizes)
                place = np.minimum(np.searchsorted(keys, codes), max(len(keys) - 1, 0))
                hit = keys[place] == codes if len(keys) else np.zeros(len(codes), bool)
                columns = list(batch.columns)
                for name, value in (("n_best", best), ("count_sum", n)):
                    add = np.where(hit, times * value[place], 0) if len(keys) else np.zeros(len(codes), np.int64)
                    columns[at[name]] = pa.array(batch.column(at[name]).to_numpy() + row_sums(add, rows, batch.num_rows))
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        frame = frame.mapInArrow(run, schema)
    return frame.drop("link", "times")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_groups: bool = True, block: int = PAIR_BLOCK) -> DataFrame:
    """One row for each row of `docs`: the columns of `link` but for its links, n_best (links whose count is the highest of their A id) and count_sum (sum of the links' counts).

    A link's count is the number of rows that hold it.  Other columns are
    dropped, so their names don't matter; an empty table gives an empty one.
    """
    folder = shared_dir(docs.sparkSession, "align")
    link(docs, a_path, b_path, text, keep, with_groups).write.option("compression", "zstd").parquet(f"{folder}/links")
    linked = docs.sparkSession.read.parquet(f"{folder}/links")
    link_counts(linked).write.parquet(f"{folder}/counts")
    return with_counts(linked, docs.sparkSession.read.parquet(f"{folder}/counts"), block)
