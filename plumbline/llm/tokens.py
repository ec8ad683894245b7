"""Token ids of whole texts with a word-end BPE vocabulary, at corpus speed.

A text is cut at ASCII white space, which no token of such a vocabulary
spans.  Each different word is encoded once per Python worker and found again
by hash and bytes in a compact sorted table, so the cost of a repeated word is
a lookup.
Two encoders plug in: the tokenizers library, and the pair occurrence index
of `bpe`.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterable

import numpy as np
import regex

from plumbline.llm._text import expand, hash_words, row_sums, same_runs, split_words

#: Encodes a list of pre-tokens: flat ids and the number of ids of each.
PieceEncoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

# Fixed value: the pre-token pattern of the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = regex.compile("\n|" + PIECES)
#: Words of these characters alone are lower-cased and cut here; the library cuts all others.
_PLAIN = regex.compile("[\n!-~¡-ɏ]*")
_SPECIAL = "<|"


@functools.lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    tok = load(path)
    n = tok.get_vocab_size(with_added_tokens=True)
    return [tok.id_to_token(i) or "" for i in range(n)]


@functools.lru_cache(maxsize=2)
def word_end(path: str) -> np.ndarray:
    return np.array([t.endswith("</w>") for t in vocabulary(path)], dtype=bool)


def plain(word: str) -> bool:
    return _SPECIAL not in word and _PLAIN.fullmatch(word) is not None


def library_pieces(path: str) -> PieceEncoder:
    """Encode pre-tokens with the tokenizers library, all in one call."""
    tok, ends = load(path), word_end(path)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(tok.encode(" ".join(pieces), add_special_tokens=False).ids, dtype=np.uint32)
        at = np.flatnonzero(ends[ids])
        if len(at) != len(pieces):  # not a vocabulary that marks each word's end
            got = [tok.encode(p, add_special_tokens=False).ids for p in pieces]
            return np.array([i for g in got for i in g], dtype=np.uint32), np.array([len(g) for g in got], dtype=np.int64)
        return ids, np.diff(at, prepend=-1)

    return encode


def library_words(path: str) -> PieceEncoder:
    """Encode words of any characters with the tokenizers library alone."""
    tok = load(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for g in got for i in g], dtype=np.uint32), np.array([len(g) for g in got], dtype=np.int64)

    return encode


def encode_words(joined: str, pieces: PieceEncoder, odd: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and counts of white-space-delimited words, given with a line end between.

    `pieces` encodes the pre-tokens of plain words; `odd` encodes whole words
    that hold other characters or the strings of special tokens.
    """
    if plain(joined):
        return _encode_plain(joined, joined.count("\n") + 1, pieces)
    words = joined.split("\n")
    is_plain = np.array([plain(w) for w in words], dtype=bool)
    some = [w for w, p in zip(words, is_plain, strict=True) if p]
    plain_ids, plain_counts = _encode_plain("\n".join(some), len(some), pieces) if some else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    odd_ids, odd_counts = odd([w for w, p in zip(words, is_plain, strict=True) if not p])
    all_counts = np.zeros(len(words), dtype=np.int64)
    all_counts[is_plain], all_counts[~is_plain] = plain_counts, odd_counts
    source = np.zeros(len(words), dtype=np.int64)
    source[is_plain] = np.cumsum(plain_counts) - plain_counts
    source[~is_plain] = np.cumsum(odd_counts) - odd_counts + len(plain_ids)
    return np.concatenate([plain_ids, odd_ids])[expand(source, all_counts)], all_counts


def _encode_plain(joined: str, n: int, pieces: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    cuts = _SPLIT.findall(joined.lower())
    different = dict.fromkeys(["\n", *cuts])
    number = dict(zip(different, range(len(different)), strict=True))
    seq = np.fromiter(map(number.__getitem__, cuts), dtype=np.int64, count=len(cuts))
    flat, counts = pieces(list(different)[1:]) if len(different) > 1 else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    counts = np.r_[0, counts]
    starts = np.cumsum(counts) - counts
    word_of = np.cumsum(seq == 0)
    return flat[expand(starts[seq], counts[seq])], np.bincount(word_of, weights=counts[seq], minlength=n).astype(np.int64)


class WordTable:
    """Ids of the words met so far, by word hash and bytes.

    At most `limit` words of `limit_bytes` bytes are kept.  The hash only
    proposes a known word: a word counts as one if its bytes are the same, and
    is encoded for itself if another word has its hash.
    """

    def __init__(self, encode: Callable[[str], tuple[np.ndarray, np.ndarray]], limit: int = 2_000_000, limit_bytes: int = 48 << 20, hashes=hash_words):
        self.encode_new, self.limit, self.limit_bytes, self.hashes = encode, limit, limit_bytes, hashes
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int32)
        self.flat, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.bytes, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _add(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        joined = _joined(data, starts, ends)
        flat, count = self.encode_new(joined.tobytes().decode())
        slots = len(self.count) + np.arange(len(keys), dtype=np.int32)
        size = (ends - starts).astype(np.int32)
        self.at = np.concatenate([self.at, len(self.bytes) + np.cumsum(size + 1, dtype=np.int64) - size - 1])
        self.bytes, self.size = np.concatenate([self.bytes, joined, [np.uint8(10)]]), np.concatenate([self.size, size])
        self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(count) - count).astype(np.int32)])
        self.count, self.flat = np.concatenate([self.count, count.astype(np.int32)]), np.concatenate([self.flat, flat])
        into = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, into, keys), np.insert(self.slot, into, slots)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows' texts, and the number of ids of each row."""
        starts, ends, rows = split_words(data, offsets)
        n = len(offsets) - 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        uniq, first, inverse = np.unique(self.hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        if not known.all():
            new = first[~known]
            if len(self.keys) + len(new) > self.limit or len(self.bytes) + int((ends[new] - starts[new] + 1).sum()) > self.limit_bytes:
                self.clear()
                known[:] = False
                new = first
            self._add(data, uniq[~known], starts[new], ends[new])
            at = np.searchsorted(self.keys, uniq)
        slot = self.slot[at][inverse]
        lens = ends - starts
        same = lens == self.size[slot]
        same[same] = same_runs(data, starts[same], lens[same], self.bytes, self.at[slot[same]])
        flat, start, count = self.flat, self.start[slot], self.count[slot]
        if not same.all():
            odd, odd_count = self.encode_new(_joined(data, starts[~same], ends[~same]).tobytes().decode())
            start, count = start.astype(np.int64), count.copy()
            start[~same], count[~same] = len(flat) + np.cumsum(odd_count) - odd_count, odd_count
            flat = np.concatenate([flat, odd])
        return flat[expand(start, count)], row_sums(count, rows, n)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' bytes with a line end between."""
    lens = ends - starts + 1
    out = data[np.minimum(expand(starts, lens), len(data) - 1)]
    out[np.cumsum(lens) - 1] = 10
    return out[:-1]


@functools.lru_cache(maxsize=2)
def library_table(path: str) -> WordTable:
    pieces, odd = library_pieces(path), library_words(path)
    return WordTable(lambda words: encode_words(words, pieces, odd))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append `end_id` to each row's ids."""
    total = counts + 1
    out = np.empty(int(total.sum()), dtype=np.uint32)
    last = np.cumsum(total) - 1
    out[last] = end_id
    keep = np.ones(len(out), dtype=bool)
    keep[last] = False
    out[keep] = ids
    return out, total


def reference_ids(path: str, texts: Iterable[str | None]) -> list[list[int]]:
    """Ids straight from the library, whole text by whole text (for tests)."""
    return [e.ids for e in load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
