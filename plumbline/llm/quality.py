"""Quality classifier: logistic regression on hashed word n-grams.

Words are the white-space-delimited runs of a text.  Hashed into `BITS` bits
are 1- to 3-grams of lower-cased words, and of word shapes: runs of upper
case, lower case, digits and each punctuation mark, with a mark on a word
equal to the one before it.  A feature's value is its share of the text's
words.  Weights are learned by follow-the-regularised-leader updates per
coordinate and applied as a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._text import aside, back, hash_words, mix, slices, split_words, string_bytes
from plumbline.llm.labelled import MAX_CHARS, MAX_ROWS, fit_sample, held_out, release

BITS = 20
THRESHOLD = 0.7
#: Values are shares of words; this brings typical texts to a length of about 1.
SCALE = 8.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (words x 6 streams: word and shape 1- to 3-grams that end there), their rows, and words per row."""
    starts, ends, rows = split_words(data, offsets)
    n_rows = len(offsets) - 1
    words = np.bincount(rows, minlength=n_rows)
    if not len(starts):
        return np.zeros((0, 6), np.int64), rows, words
    plain = hash_words(_LOWER[data], starts, ends)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (plain[1:] == plain[:-1]) & (rows[1:] == rows[:-1])
    shape = _SHAPE[data]
    keep = np.zeros(len(data), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    kept = np.r_[0, np.cumsum(keep)]
    s = hash_words(shape[keep], kept[starts], kept[ends])
    first = np.r_[True, rows[1:] != rows[:-1]]
    grams = [*_grams(plain, first), *_grams(mix(s + same.astype(np.uint64)), first)]
    mask = np.uint64((1 << BITS) - 1)
    return np.stack([mix(g + np.uint64(i)) & mask for i, g in enumerate(grams)], axis=1).astype(np.int64), rows, words


def _grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each entry, of it with the one before and with the two before; `first` marks where a row begins."""
    one = np.where(first, np.uint64(1), np.roll(h, 1))
    two = np.where(first | np.roll(first, 1), np.uint64(2), np.roll(h, 2))
    pair = mix(h * np.uint64(3) + one)
    return h, pair, mix(pair * np.uint64(5) + two)


def _length_feature(words: np.ndarray) -> np.ndarray:
    bucket = np.where(words > 0, np.floor(np.log2(np.maximum(words, 1))), -1).astype(np.int64)
    return (mix((bucket + 1000).astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates, for logistic loss."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> float:
        """One example with different coordinates `at`; returns the probability given before it."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return float(p)


def fit(sample: pa.Table, epochs: int = 3, seed: int = 7) -> np.ndarray:
    """Weights of the hashed features; the last one is the intercept."""
    size = 1 << BITS
    model = Ftrl(size + 1)
    data, offsets = string_bytes(sample.column("text"))
    y = sample.column("y").to_numpy()
    examples = []
    for i in range(len(y)):
        f, _, words = features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
        at, count = np.unique(f, return_counts=True)
        x = SCALE * count / max(1, words[0])
        at, place = np.unique(np.r_[at, _length_feature(words), size], return_inverse=True)
        examples.append((at.astype(np.int32), np.bincount(place, weights=np.r_[x, 1.0, 1.0]).astype(np.float32)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            model.update(*examples[i], float(y[i]))
    return model.weights()


def scores(weights: np.ndarray, shift: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 per row."""
    f, rows, words = features(data, offsets)
    n = len(words)
    total = np.zeros(n)
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        total[rows[first]] = np.add.reduceat(weights[f].sum(axis=1), first)
    dot = SCALE * total / np.maximum(1, words) + weights[_length_feature(words)] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot + shift, -35, 35)))


def score(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, fit_docs: DataFrame | None = None, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """All columns of `docs` (or those in `keep`) with score (0 to 1) and predicted (1 where score >= threshold).

    A null text scores as an empty one; repeated rows score alike; an empty
    table gives an empty one.  Columns of the added names (`prefix` goes
    before them) in `docs` are replaced.  Without labels of both classes the
    score is the labels' share of 1 (0.5 without labels).
    """
    sample, shift = fit_sample(fit_docs if fit_docs is not None else docs, labels, target, max_rows, max_chars)
    weights = docs.sparkSession.sparkContext.broadcast(fit(sample).astype(np.float32))
    del sample
    release()
    return apply_scores(docs, lambda data, offsets: scores(weights.value, shift, data, offsets), threshold, keep, prefix)


def apply_scores(docs: DataFrame, rate, threshold: float, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Add score and predicted from `rate(bytes, offsets)` over each chunk of whole texts."""
    from pyspark.sql.types import StructType

    added = (f"{prefix}score", f"{prefix}predicted")
    columns, kept = aside(docs, docs.columns if keep is None else keep, added)
    frame = docs.select(*columns, F.col("text").cast("string").alias("text"))
    out = StructType(frame.schema.fields[:-1] + StructType.fromDDL("score double, predicted int").fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = rate(*string_bytes(part.column(len(kept))))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=out.fieldNames())

    return frame.mapInArrow(run, out).select(*back(kept), *(F.col(c).alias(n) for c, n in zip(("score", "predicted"), added, strict=True)))


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
