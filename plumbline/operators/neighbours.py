"""Nearest neighbours of all rows: an approximate graph by neighbour descent, its recall, fuzzy weights and a layout.

A graph is a table (id, near, distance, rank) with the k nearest other rows of
each row, ties to the least id.  Rows without id or without a usable vector
(null, a null or non-finite component, another length) take no part; of rows
that repeat an id the least vector counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.operators.vectors import matrix, usable
from plumbline.storage import shared_dir

#: Rows of one cell or query block that are compared as one matrix product.
CELL = 1024
#: Rows that stand for the cells of a first guess, at most (64 dimensions: 2 MB).
PIVOTS = 4096


def _kinds(vectors: DataFrame, id_column: str) -> str:
    return vectors.schema[id_column].dataType.simpleString()


def prepared(vectors: DataFrame, id_column: str, vector: str, metric: str = "cosine", size: int | None = None) -> DataFrame:
    """(id, v) of usable rows, one per id; for cosine distances vectors have length 1 (a zero vector stays)."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"no such metric: {metric}")
    rows = usable(vectors, vector, size).filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    one = rows.groupBy("id").agg(F.min("v").alias("v"))
    if metric == "euclidean":
        return one
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return one.select("id", F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias("v"))


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two sets of prepared vectors, to 12 places."""
    if metric == "cosine":
        return np.round(np.maximum(1 - x @ y.T, 0), 12)
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.round(np.sqrt(np.maximum(square, 0)), 9)


def _top(frame: DataFrame, k: int, *extra: str) -> DataFrame:
    """The k nearest of each id.  Spark prunes each task's rows to k before it shuffles them, so an id with very many candidates is no hot group."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "near"))).filter(F.col("rank") <= k).select("id", "near", "distance", *extra, "rank")


def _growing(batches: Iterable[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batches in parts of as many rows as came before (`least` or more), so that bounds are near early."""
    seen = 0
    for names, y in batches:
        at = 0
        while at < len(y):
            to = min(len(y), at + max(least, seen))
            yield names[at:to], y[at:to]
            seen, at = seen + to - at, to


def _nearer(ids: np.ndarray, q: np.ndarray, k: int, metric: str, batches: Iterable[tuple[np.ndarray, np.ndarray]], tile: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, id and distance of the k nearest rows of each query, from batches (ids, vectors) of rows.

    A product in single precision, with a bound on its error, leaves the pairs
    that may be among the k nearest so far; their distances are then exact.
    The product's tiles stay in the cache, and of a tile only queries are
    looked at whose least value is within their bound: few, once many rows
    have passed.
    """
    cosine = metric == "cosine"
    floor, step = (-1.0, 1e-12) if cosine else (0.0, 1e-9)  # least value of what is compared (-product, or squared distance); places of distances
    square = (q * q).sum(1)
    bound = np.full(len(q), np.inf)  # of what is compared, for the k-th nearest
    room = {}
    at, names, far = np.zeros(0, np.int64), ids[:0], np.zeros(0)
    for name, y in _growing(batches, tile):
        square_y = (y * y).sum(1)
        most = max(square.max(initial=0), square_y.max(initial=0))
        kind, unit = (np.float32, 2.0**-23) if most < 1e30 else (np.float64, 2.0**-51)
        slack = unit * (q.shape[1] + 4) * 4 * most + 2 * step
        a, b = (-q if cosine else -2 * q).astype(kind), np.ascontiguousarray(y.T.astype(kind))
        if not cosine:  # squares are two more components
            one = np.ones((len(q), 1), kind), np.ones((1, len(y)), kind)
            a, b = np.hstack([a, square[:, None].astype(kind), one[0]]), np.vstack([b, one[1], square_y[None].astype(kind)])
        if kind not in room:
            room = {kind: np.empty(tile * tile, kind)}
        found = []
        for start in range(0, len(y), tile):
            right = np.ascontiguousarray(b[:, start : start + tile])
            for lo in range(0, len(q), tile):
                left = a[lo : lo + tile]
                e = np.matmul(left, right, out=room[kind][: len(left) * right.shape[1]].reshape(len(left), -1))
                mine = bound[lo : lo + tile]
                if e.shape[1] > k and np.isinf(mine).any():  # k + 1, as one may be the query itself
                    np.minimum(mine, np.maximum(np.partition(e, k, axis=1)[:, k], floor) + slack, out=mine)
                limit = np.nextafter((mine + slack).astype(kind), kind(np.inf))
                some = np.flatnonzero(~(e.min(axis=1) > limit))  # with those that hold no number
                i, j = np.divmod(np.flatnonzero(e[some] <= limit[some, None]), e.shape[1])
                i, j = some[i] + lo, j + start
                other = name[j] != ids[i]
                i, j = i[other], j[other]
                for c in range(0, len(i), 16384):
                    u, v = i[c : c + 16384], j[c : c + 16384]
                    product = np.einsum("ij,ij->i", q[u], y[v])
                    d = np.round(np.maximum(1 - product, 0), 12) if cosine else np.round(np.sqrt(np.maximum(square[u] + square_y[v] - 2 * product, 0)), 9)
                    found.append((u, name[v], d))
        at, names, far = (np.concatenate(x) for x in zip((at, names, far), *found, strict=True))
        order = np.lexsort((names if names.dtype != object else np.unique(names, return_inverse=True)[1], far, at))
        at, names, far = at[order], names[order], far[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        last = place == k - 1
        d = far[last] + step
        bound[at[last]] = np.minimum(bound[at[last]], d - 1 if cosine else d * d)
        at, names, far = at[place < k], names[place < k], far[place < k]
    return at, names, far


def _named(column: pa.Array) -> np.ndarray:
    """Ids as an array: numbers as such, others as objects."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def nearest_of(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", block: int = 8192) -> DataFrame:
    """(id, near, distance, rank) of given queries (id, v) against all rows (id, v), exactly.

    Both are written first.  Queries go out in blocks of `block` rows; all rows
    stream past each block, and a task passes on k rows of each query.  The
    more blocks there are, the fewer tasks share one, but two at least: were
    each block's part a single partition, Spark would take their union as one
    too, and all blocks would be one task's work.
    """
    spark = rows.sparkSession
    kind = _kinds(rows, "id")
    out = StructType.fromDDL(f"id {kind}, near {kind}, distance double")
    folder = shared_dir(spark, "nearest")
    rows.select("id", "v").write.parquet(f"{folder}/rows")
    rows = spark.read.schema(f"id {kind}, v array<double>").parquet(f"{folder}/rows")
    queries.select("id", "v").write.parquet(f"{folder}/queries")
    queries = spark.read.schema(f"id {kind}, v array<double>").parquet(f"{folder}/queries")
    blocks = max(1, -(-queries.count() // block))
    queries.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition("_b").write.partitionBy("_b").parquet(f"{folder}/blocks")
    dealt = spark.read.schema(f"id {kind}, v array<double>, _b int").parquet(f"{folder}/blocks")
    share = max(2, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    parts = []
    for b in range(blocks):
        mine = dealt.filter(F.col("_b") == b).select("id", "v").toArrow().combine_chunks()
        asked = spark.sparkContext.broadcast((_named(mine.column("id").combine_chunks()), matrix(mine.column("v")) if mine.num_rows else None))

        def run(batches: Iterable[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            ids, q = asked.value
            if len(ids):
                at, names, d = _nearer(ids, q, k, metric, ((_named(x.column(0)), matrix(x.column(1))) for x in batches if x.num_rows))
                schema = to_arrow_schema(out)
                for lo in range(0, len(at), 10_000):
                    some = slice(lo, lo + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((ids[at[some]], names[some], d[some]), schema, strict=True)], schema=schema)

        parts.append(rows.coalesce(share).mapInArrow(run, out))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return _top(whole, k)


def _groups(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Runs of equal values of a column, of sorted batches, each whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_pylist()
        at = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if held and held[0].column(column)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _first_guess(rows: DataFrame, k: int, metric: str, probes: int, n: int) -> DataFrame:
    """(id, near, distance): the k nearest rows within cells around chosen rows.

    A row is in the cells of its `probes` nearest pivots.  A cell of more than
    CELL rows is cut by hash, so many copies of one vector are no hot group.
    """
    spark = rows.sparkSession
    kind = _kinds(rows, "id")
    few = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, int(np.ceil(np.sqrt(n))))).select("v").toArrow().combine_chunks()
    pivots = spark.sparkContext.broadcast(matrix(few.column("v")))

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(matrix(batch.column(1)), pivots.value, metric)
                m = min(probes, d.shape[1])
                near = np.argsort(d, axis=1, kind="stable")[:, :m]
                at = np.repeat(np.arange(batch.num_rows), m)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *(c.take(pa.array(at)) for c in batch.columns)], names=["cell", "id", "v"])

    dealt = rows.select("id", "v").mapInArrow(cells, f"cell int, id {kind}, v array<double>")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("long").alias("cuts"))  # one row for each pivot
    dealt = dealt.join(F.broadcast(sizes), "cell").select(F.struct("cell", F.pmod(F.xxhash64("id"), F.col("cuts")).alias("cut")).alias("cell"), "id", "v")
    out = StructType.fromDDL(f"id {kind}, near {kind}, distance double")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            x = matrix(group.column(2))
            for a in range(0, len(x), CELL):
                d = distances(x[a : a + CELL], x, metric)
                d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
                m = min(k, len(x) - 1)
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                at = np.repeat(np.arange(len(d)), m)
                yield pa.RecordBatch.from_arrays([group.column(1).take(pa.array(a + at)), group.column(1).take(pa.array(near.ravel())), pa.array(d[at, near.ravel()])], schema=schema)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, out)


def descend(vectors: DataFrame, id_column: str, vector: str, k: int = 15, metric: str = "cosine", size: int | None = None, rounds: int = 12, least_change: float = 0.002, probes: int = 6, sample: int | None = None) -> DataFrame:
    """The graph of the k nearest rows of each row, by neighbour descent: approximate; see `recall`.

    From a first guess within cells, each round compares the neighbours of
    each row, and the rows whose neighbour it is, with each other (a sample of
    `sample` each way, by a hash that changes from round to round; pairs of
    which neither is new are left out), until a round changes less than a
    share of `least_change` of all places.  Each round is a written table.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark, "descent")
    prepared(vectors, id_column, vector, metric, size).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    n, sample = rows.count(), sample or 3 * k
    kind = _kinds(rows, "id")
    pair = StructType.fromDDL(f"id {kind}, near {kind}, distance double")
    if n < 2:
        return spark.createDataFrame([], StructType.fromDDL(f"id {kind}, near {kind}, distance double, rank int"))
    first = _first_guess(rows, k, metric, probes, n).distinct().withColumn("fresh", F.lit(True))
    _top(first, k, "fresh").drop("rank").write.parquet(f"{folder}/0")
    graph = spark.read.parquet(f"{folder}/0")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row's list: the pairs that come nearer than what either has."""
        schema = to_arrow_schema(pair)
        made, count = [], 0
        for group in _groups(batches):
            x, fresh, far = matrix(group.column(4)), group.column(2).to_numpy(zero_copy_only=False), group.column(3).to_numpy(zero_copy_only=False)
            d = distances(x, x, metric)
            np.fill_diagonal(d, np.inf)
            wanted = (fresh[:, None] | fresh[None, :]) & (d <= far[:, None]) & np.isfinite(d)
            i, j = np.nonzero(wanted)
            if len(i):
                made.append(pa.RecordBatch.from_arrays([group.column(1).take(pa.array(i)), group.column(1).take(pa.array(j)), pa.array(d[i, j])], schema=schema))
                count += len(i)
            if count > 50_000:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made, count = [], 0
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    for r in range(1, rounds + 1):
        far = graph.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("far"))
        known = rows.join(far, "id", "left").select(F.col("id").alias("member"), F.coalesce("far", F.lit(float("inf"))).alias("far"), "v")
        ways = graph.select(F.col("id").alias("centre"), F.col("near").alias("member"), "fresh", F.lit(0).alias("way")).unionByName(graph.select(F.col("near").alias("centre"), F.col("id").alias("member"), "fresh", F.lit(1).alias("way")))
        order = Window.partitionBy("centre", "way").orderBy(F.desc("fresh"), F.xxhash64("member", F.lit(r)))
        some = ways.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
        self_ = rows.select(F.col("id").alias("centre"), F.col("id").alias("member"), F.lit(False).alias("fresh"))
        lists = some.unionByName(self_).join(known, "member").select("centre", "member", "fresh", "far", "v")
        found = lists.repartition("centre").sortWithinPartitions("centre").mapInArrow(compare, pair)
        both = graph.select("id", "near", "distance", F.lit(0).alias("_new")).unionByName(found.filter("id <> near").withColumn("_new", F.lit(1)))
        # A pair that is known already isn't new; its distance is the same, to the rounding of `distances`.
        once = both.groupBy("id", "near").agg(F.min("distance").alias("distance"), (F.min("_new") == 1).alias("fresh"))
        _top(once, k, "fresh").drop("rank").write.parquet(f"{folder}/{r}")
        graph = spark.read.parquet(f"{folder}/{r}")
        if graph.filter("fresh").count() <= least_change * n * k:
            break
    return _top(graph, k)


def recall(graph: DataFrame, vectors: DataFrame, id_column: str, vector: str, k: int, metric: str = "cosine", size: int | None = None, queries: int = 1000) -> float:
    """Share of the true k nearest rows of `queries` rows (by hash of the id) that the graph holds; 1 if there are none."""
    rows = prepared(vectors, id_column, vector, metric, size)
    truth = nearest_of(rows.orderBy(F.xxhash64("id"), "id").limit(queries), rows, k, metric)
    hits = truth.join(graph.select("id", "near", F.lit(1).alias("hit")), ["id", "near"], "left").agg(F.count(F.lit(1)), F.count("hit")).first()
    return hits[1] / hits[0] if hits[0] else 1.0


def fuzzy_weights(graph: DataFrame, k: int) -> DataFrame:
    """(a, b, weight) of a < b: how surely two rows are neighbours.

    From a row's side the weight falls from 1 at its nearest neighbour, at a
    rate that makes all k sum to log2(k); the sides a and b give a + b - ab.
    """
    lists = graph.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "near"))).alias("l"))  # k entries a row
    kind = _kinds(graph, "id")
    out = StructType.fromDDL(f"id {kind}, near {kind}, w double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            d, near = flat.field("distance").to_numpy(), flat.field("near")
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            first = d[np.cumsum(sizes) - sizes]
            over = np.maximum(d - first[rows], 0)
            low, high = np.zeros(batch.num_rows), np.full(batch.num_rows, np.inf)
            rate = np.full(batch.num_rows, max(float(over.mean()), 1e-9))
            target = np.log2(np.maximum(np.minimum(sizes, k), 2))
            for _ in range(64):
                total = np.bincount(rows, weights=np.exp(-over / rate[rows]), minlength=batch.num_rows)
                big = total > target
                high, low = np.where(big, rate, high), np.where(big, low, rate)
                rate = np.maximum(np.where(np.isinf(high), rate * 2, (low + high) / 2), 1e-12)
                rate = np.minimum(rate, 1e12)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), near, pa.array(np.exp(-over / rate[rows]))], schema=schema)

    sides = lists.mapInArrow(run, out).select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b"), "w")
    return sides.groupBy("a", "b").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("weight"))


def layout(weights: DataFrame, start: DataFrame, dims: int = 5, steps: int = 10, epochs: int = 10, block: int = 4096, pushes: int = 5, spread: tuple[float, float] = (1.577, 0.895), seed: int = 42) -> DataFrame:
    """(id, reduced): places in which linked rows are near, by sampled forces along edges.

    `start` gives (id, reduced) to begin from.  Rows are dealt to blocks by
    hash, anew in each step; a block holds its rows, the places of their
    neighbours and, as rows to push away from, the block's own.  It moves its
    rows alone, for `epochs` rounds in which an edge acts with the probability
    of its weight; then all places meet again.  With `steps` x `epochs` rounds
    the moves shrink to nothing.  `spread` are the parameters a and b of the
    curve 1 / (1 + a d^2b) (these: of least distance 0).
    """
    spark = weights.sparkSession
    folder = shared_dir(spark, "layout")
    kind = _kinds(start, "id")
    weights.select(F.col("a").alias("id"), F.col("b").alias("near"), "weight").unionByName(weights.select(F.col("b").alias("id"), F.col("a").alias("near"), "weight")).write.parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")
    scale = start.agg(F.max(F.aggregate("reduced", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))).first()[0] or 1.0
    start.select("id", F.transform("reduced", lambda x: x * (10.0 / scale)).alias("reduced")).write.parquet(f"{folder}/0")
    now = spark.read.parquet(f"{folder}/0")
    blocks = max(1, -(-now.count() // block))
    out = StructType.fromDDL(f"id {kind}, reduced array<double>")
    a, b = spread
    total = steps * epochs

    def mover(s: int):
        def move(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by("id")
            n = table.num_rows
            rng = np.random.default_rng([seed, s, n])
            x = matrix(table.column("reduced")).copy()
            counts = [len(v) if v is not None else 0 for v in table.column("l").to_pylist()]
            rows = np.repeat(np.arange(n), counts)
            links = [e for v in table.column("l").to_pylist() if v for e in v]
            w = np.array([e["weight"] for e in links], dtype=np.float64)
            there = np.array([e["there"] for e in links], dtype=np.float64).reshape(len(links), x.shape[1])
            for e in range(epochs):
                pace = 1 - (s * epochs + e) / total
                on = np.flatnonzero(rng.random(len(rows)) < w)
                if not len(on):
                    continue
                away = x[rows[on]] - there[on]
                d2 = (away * away).sum(1)
                pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * np.maximum(d2, 1e-12) ** b), 0.0)
                step = np.zeros_like(x)
                np.add.at(step, rows[on], np.clip(pull[:, None] * away, -4, 4))
                for _ in range(pushes if n > 1 else 0):
                    other = rng.integers(0, n, len(on))
                    away = x[rows[on]] - x[other]
                    d2 = (away * away).sum(1)
                    push = 2 * b / ((0.001 + d2) * (1 + a * np.maximum(d2, 1e-12) ** b))
                    push[other == rows[on]] = 0
                    np.add.at(step, rows[on], np.clip(push[:, None] * away, -4, 4))
                x += pace * np.clip(step, -4, 4)
            return pa.Table.from_arrays([table.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], schema=to_arrow_schema(out))

        return move

    for s in range(steps):
        lists = edges.join(now.select(F.col("id").alias("near"), F.col("reduced").alias("there")), "near").groupBy("id").agg(F.collect_list(F.struct("weight", "there")).alias("l"))
        mine = now.join(lists, "id", "left").withColumn("block", F.pmod(F.xxhash64("id", F.lit(s)), F.lit(blocks)))
        mine.groupBy("block").applyInArrow(mover(s), out).write.parquet(f"{folder}/{s + 1}")
        now = spark.read.parquet(f"{folder}/{s + 1}")
    return now


def reduce(vectors: DataFrame, id_column: str, vector: str, dims: int = 5, k: int = 15, metric: str = "cosine", seed: int = 42, **options) -> DataFrame:
    """(id, reduced): `dims` numbers for each usable row, near where the rows are near: neighbour graph, fuzzy weights, layout from the principal components.

    A row that is alone is at the origin.
    """
    from plumbline.operators.vectors import reduce as components

    spark = vectors.sparkSession
    folder = shared_dir(spark, "reduced")
    prepared(vectors, id_column, vector, metric).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    if rows.count() < 2:
        return rows.select(F.col("id").alias(id_column), F.array_repeat(F.lit(0.0), dims).alias("reduced"))
    graph = descend(rows, "id", "v", k, metric)
    fuzzy_weights(graph, k).write.parquet(f"{folder}/weights")
    start = components(rows, "v", dims).select("id", "reduced")
    return layout(spark.read.parquet(f"{folder}/weights"), start, dims, seed=seed, **options).withColumnRenamed("id", id_column)


def trustworthiness(rows: DataFrame, reduced: DataFrame, k: int = 15, metric: str = "cosine", queries: int = 500) -> float:
    """How far near rows of a reduction were near before, over `queries` rows by hash of the id: 1 if all were.

    `rows` is (id, v) as `prepared` gives it, `reduced` (id, v) after.  Each
    of a query's k rows in the reduction that isn't among its k before costs
    its rank before, less k.
    """
    spark = rows.sparkSession
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(queries)
    after = nearest_of(reduced.join(chosen.select("id"), "id"), reduced, k, "euclidean")
    pairs = after.select("id", "near").join(chosen.select("id", F.col("v").alias("q")), "id").join(rows.select(F.col("id").alias("near"), F.col("v").alias("x")), "near").toArrow().combine_chunks()  # queries x k rows
    if not pairs.num_rows:
        return 1.0
    asked, members = np.unique(np.array(pairs.column("id").to_pylist(), dtype=object).astype(str), return_inverse=True)
    first = np.array([np.argmax(members == i) for i in range(len(asked))])
    q, x = matrix(pairs.column("q"))[first], matrix(pairs.column("x"))
    limit = np.array([distances(q[m : m + 1], x[i : i + 1], metric)[0, 0] for i, m in enumerate(members)])
    known = spark.sparkContext.broadcast((q, members, limit))

    def nearer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, members, limit = known.value
        total = np.zeros(len(limit), np.int64)
        for batch in batches:
            if batch.num_rows:
                d = np.sort(distances(q, matrix(batch.column(0)), metric), axis=1)
                total += [np.searchsorted(d[m], x, side="left") for m, x in zip(members.tolist(), limit.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(limit))), pa.array(total)], names=["pair", "nearer"])

    # The query itself is among the nearer ones: a rank of k or less costs nothing.
    ranks = rows.select("v").mapInArrow(nearer, "pair long, nearer long").groupBy("pair").agg(F.sum("nearer").alias("rank"))
    cost = ranks.agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0)))).first()[0]
    return 1 - cost * 2 / (len(asked) * k * (2 * n - 3 * k - 1))
