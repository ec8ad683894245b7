"""BPE encoding by a pair occurrence index, and decoding from a token table.

All different pre-tokens met in a chunk are laid out as one array of symbols.
An index maps each pair's merge rank to the positions where that pair stands.
Active ranks are applied in ascending order; each merge rewrites its positions
at once and adds the pairs that arise to the index.

In a trained vocabulary each token is the product of one merge, so a pair that
holds a new token always ranks after the merge that made it: ascending order
over the whole chunk equals ascending order within each pre-token.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm._text import expand, slices, string_bytes
from plumbline.llm.tokens import WordTable, encode_words, load, vocabulary


class PairIndex:
    """Merge table of a vocabulary file with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        if len(np.unique(self.product)) != len(self.product):
            raise ValueError("a token of this vocabulary has two merges; ranks can't be applied to all words at once")
        self.left, self.right = left, right
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank_of = key[order], order

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_of[at], -1)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of pre-tokens (none empty)."""
        raw = [p.encode() for p in pieces]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n, ends = len(data), np.cumsum(lens)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(pieces), np.int64)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        # A sentinel symbol at -1 and n, and links that end at the word's edges.
        sym = np.append(sym, -1)
        nxt = np.arange(1, n + 2)
        prv = np.arange(-1, n)
        nxt[ends - 1] = n
        prv[ends - lens] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(rank: np.ndarray, pos: np.ndarray) -> None:
            """Put positions into the index by rank."""
            hit = rank >= 0
            if not hit.any():
                return
            rank, pos = rank[hit], pos[hit]
            order = np.argsort(rank, kind="stable")
            rank, pos = rank[order], pos[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            edges = [0, *cut.tolist(), len(rank)]
            for r, a, b in zip(rank[np.r_[0, cut]].tolist(), edges[:-1], edges[1:], strict=True):
                if r in index:
                    index[r].append(pos[a:b])
                else:
                    index[r] = [pos[a:b]]
                    heapq.heappush(active, r)

        here = np.flatnonzero(nxt[:n] != n)
        add(self.ranks(sym[here], sym[here + 1]), here)
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            pos = found[0] if len(found) == 1 else np.concatenate(found)
            left, right, new = self.left[r], self.right[r], self.product[r]
            pos = pos[(sym[pos] == left) & (sym[nxt[pos]] == right)]  # others were overtaken by lower ranks
            if not len(pos):
                continue
            if left == right:
                pos = self._apart(np.unique(pos), nxt)
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], sym[gone] = new, -2
            nxt[pos] = after
            inner = after != n
            prv[after[inner]] = pos[inner]
            before = prv[pos]
            has = before != n
            b, p = before[has], pos[inner]
            add(np.concatenate([self.ranks(sym[b], sym[pos[has]]), self.ranks(sym[p], sym[nxt[p]])]), np.concatenate([b, p]))
        alive = sym[:n] >= 0
        word = np.repeat(np.arange(len(pieces)), lens)
        return sym[:n][alive].astype(np.uint32), np.bincount(word[alive], minlength=len(pieces)).astype(np.int64)

    @staticmethod
    def _apart(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences of a pair of equal symbols, every second from the left."""
        keep, last = [], -1
        for p in pos.tolist():
            if p != last:
                keep.append(p)
                last = int(nxt[p])
        return np.array(keep, dtype=np.int64)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free code from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def pair_index(path: str) -> PairIndex:
    return PairIndex(path)


def odd_words(path: str):
    """Encoder of words with special-token strings or characters outside the plain range."""
    tok, index = load(path), pair_index(path)
    added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    at_added = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
    letter = {c: b for b, c in enumerate(byte_letters())}

    def pieces_of(part: str) -> list[str]:
        cut = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part))
        return [bytes(letter[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in cut]

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, number, seqs = [], {}, []
        for w in words:
            seq = []
            for part in at_added.split(w) if at_added else [w]:
                if part in added:
                    seq.append(-1 - added[part])
                elif part:
                    seq += [number.setdefault(p, len(number)) for p in pieces_of(part) if p]
            seqs.append(seq)
        flat, counts = index.encode(list(number)) if number else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        start = np.cumsum(counts) - counts
        for seq in seqs:
            got = [np.array([-1 - s], np.uint32) if s < 0 else flat[start[s] : start[s] + counts[s]] for s in seq]
            parts.append(np.concatenate(got) if got else np.zeros(0, np.uint32))
        return np.concatenate(parts) if parts else flat[:0], np.array([len(p) for p in parts], dtype=np.int64)

    return encode


@functools.lru_cache(maxsize=2)
def pair_table(path: str) -> WordTable:
    index, odd = pair_index(path), odd_words(path)
    return WordTable(lambda words: encode_words(words, index.encode, odd))


@functools.lru_cache(maxsize=2)
def _joined(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each id: its decimal digits and its token, each with a space behind, as bytes with starts and lengths."""

    def table(strings: list[str]):
        raw = [(s + " ").encode() for s in strings]
        lens = np.array([len(r) for r in raw], dtype=np.int64)
        return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(lens) - lens, lens

    vocab = vocabulary(path)
    return *table([str(i) for i in range(len(vocab))]), *table(vocab)


def join_ids(ids: np.ndarray, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> bytes:
    """Each id's string, with one space between."""
    return flat[expand(starts[ids], lens[ids])].tobytes()[:-1] if len(ids) else b""


def decode(path: str, ids: np.ndarray) -> str:
    """The text of ids, special tokens included: tokens with one space between, as the vocabulary has no decoder of its own."""
    return join_ids(ids, *_joined(path)[3:]).decode()


OUTPUT = "n_tokens long, ids binary, decoded string"


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Adds to the columns `keep`: n_tokens, ids (little-endian unsigned 32-bit)
    and decoded.  A null text counts as empty: no ids, empty decoded text.
    Rows are independent, so repeated rows give equal rows; other columns of
    `docs` are dropped.
    """
    return _over_ids(docs, tokenizer_path, text, keep, OUTPUT, lambda ids: (len(ids), ids.astype("<u4").tobytes(), decode(tokenizer_path, ids)))


def encode_decode_digests(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode_decode, with SHA-256 digests of the decimal ids and of the decoded text instead of both."""

    def digests(ids: np.ndarray):
        digits = join_ids(ids, *_joined(tokenizer_path)[:3])
        decoded = decode(tokenizer_path, ids)
        return len(ids), sha256(digits).hexdigest(), sha256(decoded.encode()).hexdigest()

    return _over_ids(docs, tokenizer_path, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _over_ids(docs, path, text, keep, added: str, make) -> DataFrame:
    from pyspark.sql.types import StructType

    frame = docs.select(*keep, text)
    out = StructType(frame.select(*keep).schema.fields + StructType.fromDDL(added).fields)
    names = out.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pair_table(path)
        schema = None
        for part in slices(batches, text):
            data, offsets = string_bytes(part.column(part.schema.get_field_index(text)))
            ids, counts = table.encode(data, offsets)
            at = np.r_[0, np.cumsum(counts)]
            rows = [make(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if schema is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                schema = to_arrow_schema(out)
            kept = [part.column(part.schema.get_field_index(k)) for k in keep]
            made = [pa.array(c, type=schema.field(n).type) for c, n in zip(zip(*rows, strict=True), names[len(keep) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return frame.mapInArrow(run, out)
