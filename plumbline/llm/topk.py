"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... segments; each keeps its mean and standard
deviation.  By Cauchy-Schwarz the distance of two vectors is at least
sum(len * ((m - m')^2 + (s - s')^2)), so their inner product is at most
sum(len * (m * m' + s * s')).  For a block of queries and a block of
candidates the bounds are taken coarse to fine; only pairs whose bound still
reaches the query's k-th best known score get their exact product.  While most
pairs are left a level is one matrix product over all, then one pair at a time.

Queries and candidates meet in a grid of blocks of bounded size, of which
there are at least as many as tasks can run at once; each cell gives the best
k of its candidates for each query, and a ranked window merges the cells.  No
side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most and fewest candidates of a cell, and most queries.
CANDIDATE_ROWS, LEAST_ROWS, QUERY_ROWS = 32_768, 2_048, 16_384
LEVELS = (1, 2, 4, 8, 16)
#: Queries handled at a time within a cell.
STRIPE = 128
#: Share of pairs below which those left are taken one by one.
SPARSE = 1 / 16
_EXACT = float(1 << 53)


def quantized(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("double"))


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, weighted so that products of two rows' entries sum to the bound."""
    d = x.shape[1]
    edges = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    lens = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    mean = total / lens
    deviation = np.sqrt(np.maximum(0, squares / lens - mean * mean))
    return np.concatenate([mean * np.sqrt(lens), deviation * np.sqrt(lens)], axis=1)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, tally: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best candidates of other ids; ties to the smaller id.

    `tally` counts all pairs and those that reached their exact product.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    d, n = x.shape[1], len(x)
    levels = [s for s in LEVELS if s < d] or [1]
    stats_x = [segment_statistics(x, s) for s in levels]
    big = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d >= _EXACT
    norm_x = float(np.sqrt((x * x).sum(axis=1)).max(initial=0))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), STRIPE):
        qs, qi = q[at : at + STRIPE], q_ids[at : at + STRIPE]
        slack = 1e-9 * (1 + np.sqrt((qs * qs).sum(axis=1)) * norm_x)
        stats_q = [segment_statistics(qs, s) for s in levels]
        # Seeds: the candidates with the best bounds at a middle level give a first k-th best score.
        middle = min(3, len(levels) - 1)
        bound = stats_q[middle] @ stats_x[middle].T
        seeds = min(n, 8 * k)
        near = np.argpartition(bound, n - seeds, axis=1)[:, n - seeds :]
        score = np.einsum("qd,qnd->qn", qs, x[near])
        score[ids[near] == qi[:, None]] = -np.inf
        least = np.sort(score, axis=1)[:, seeds - k] if seeds >= k else np.full(len(qs), -np.inf)
        least = (least - slack - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)))[:, None]
        left = ids[None, :] != qi[:, None]
        for level, (sq, sx) in enumerate(zip(stats_q, stats_x, strict=True), 1):
            left &= (bound if level - 1 == middle else sq @ sx.T) >= least
            if big or np.count_nonzero(left) < SPARSE * left.size:
                break
        many = np.count_nonzero(left)
        if big or many < SPARSE * left.size:
            row, col = np.nonzero(left)
            for sq, sx in zip(stats_q[level:], stats_x[level:], strict=True):
                row, col = _survivors(row, col, sq, sx, least[:, 0])
            many = len(row)
            exact = _products(row, col, qs, x, big)
        else:
            product = qs @ x.T
            left &= product >= least
            row, col = np.nonzero(left)
            exact = product[row, col].astype(np.int64)
        if tally is not None:
            tally["pairs"], tally["exact"] = tally.get("pairs", 0) + left.size, tally.get("exact", 0) + many
        keep = _best(row, exact, k)
        found.append((row[keep] + at, by_id[col[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (by_id[:0], by_id[:0], by_id[:0])


def _best(row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest scores, of equal ones the first; rows ascend."""
    if not len(row):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(row)], strict=True):
        s = score[a:b]
        if b - a > k:
            least = np.partition(s, b - a - k)[b - a - k]
            above = np.flatnonzero(s > least)
            at = np.r_[above, np.flatnonzero(s == least)[: k - len(above)]]
        else:
            at = np.arange(b - a)
        out.append(a + at)
    return np.concatenate(out)


def _survivors(row, col, sq, sx, least):
    """Pairs whose bound at this level still reaches the least score."""
    if 4 * len(row) > len(sq) * len(sx):
        hit = (sq @ sx.T)[row, col] >= least[row]
    else:
        hit = np.concatenate([np.einsum("nd,nd->n", sq[row[a : a + 65536]], sx[col[a : a + 65536]]) >= least[row[a : a + 65536]] for a in range(0, len(row), 65536)] or [np.zeros(0, bool)])
    return row[hit], col[hit]


def _products(row, col, q, x, big: bool) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they are held at the ends of that range."""
    if big:
        ends = (-(1 << 63), (1 << 63) - 1)
        qi, xi = {}, {}
        out = []
        for a, b in zip(row.tolist(), col.tolist(), strict=True):
            left = qi.setdefault(a, [int(v) for v in q[a]])
            right = xi.setdefault(b, [int(v) for v in x[b]])
            out.append(min(ends[1], max(ends[0], sum(u * v for u, v in zip(left, right, strict=True)))))
        return np.array(out, dtype=np.int64)
    if 4 * len(row) > len(q) * len(x):
        return (q @ x.T)[row, col].astype(np.int64)
    parts = [np.einsum("nd,nd->n", q[row[a : a + 65536]], x[col[a : a + 65536]]) for a in range(0, len(row), 65536)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", factor: int = 256, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best other rows; ties to the smaller id.

    `is_query` is a predicate on the id.  Rows without id or usable vector
    take no part; vectors of different lengths aren't compared.  Every row is
    a candidate and, where its id is asked for, a query: rows that repeat an
    id rank beside each other, equal ones once for each, and the best k are
    those of all rows of a query's id.  Fewer than k candidates give fewer
    rows, an empty table none.
    """
    table = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("_raw"))
    named = vectors.select(F.col(id_column).alias("vec_id")).agg(F.count("vec_id"), F.count(F.when(is_query, 1))).first()
    blocks = max(1, -(-named[1] // query_rows))
    at_once = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    cells = max(1, -(-named[0] // candidate_rows), min(-(-at_once // blocks), named[0] // LEAST_ROWS))
    # Equal rows are one with a number of copies.
    ready = table.filter(F.col("vec_id").isNotNull() & usable(F.col("_raw"))).select("vec_id", quantized(F.col("_raw"), factor).alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = ready.withColumn("cell", F.pmod(F.xxhash64("vec_id", "v"), F.lit(cells)).cast("int")).withColumn("block", numbers(blocks))
    queries = ready.filter(is_query).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("cell", numbers(cells))
    key = ["dim", "cell", "block"]
    names = ["query_id", "vec_id", "score", "copies"]

    def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return t.column("vec_id").to_numpy(), values.reshape(t.num_rows, -1), t.column("copies").to_numpy()

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [np.zeros(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            (q_ids, q, q_copies), (ids, x, copies) = columns(left), columns(right)
            row, col, score = best_of_block(q_ids, q, ids, x, k)
            # More copies than places change nothing.
            got = [q_ids[row], ids[col], score, np.minimum(q_copies[row], k) * np.minimum(copies[col], k)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, got, strict=True)})

    partial = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(cell, ", ".join(f"{n} long" for n in names))
    each = partial.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
