"""Near-duplicate documents by a chosen-path join over word shingles.

A document is the set of its shingles of five words.  Documents of equal sets
are one node.  A node's set is embedded as min-hash coordinates; a run splits
all nodes on a sampled coordinate, then each part on another, and so on: a
path.  One coordinate is chosen for each part and sometimes a second, 1/0.8 on
average, so that a pair of similarity 0.8 is expected to share one path at any
depth.  Parts of bounded size are compared by brute force; the nodes of larger
ones are split deeper.  At each depth runs repeat until the expected recall of
a pair reaches its target, so the deeper the more of them.

Pairs that a part's estimate doesn't rule out join nodes to candidate groups;
within these all pairs of nodes are compared exactly.  A part or group beyond
a block's size is compared as a grid of block pairs in many tasks, so none is
capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._text import column, hash_words, mix, slices, split_words, string_bytes
from plumbline.operators.graph import components
from plumbline.storage import shared_dir

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
COORDINATES, DEPTH, MAX_DEPTH = 64, 2, 8
#: Nodes of a part or group that are compared in one block; of long texts fewer, so many shingles count as one.
BLOCK, LONG = 512, 4096
#: An estimate from the coordinates is short of the truth by more than this in about one of 10,000 pairs.
SLACK = 0.2

_WORD_EDGE = np.ones(256, dtype=bool)
_WORD_EDGE[[95, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_rng = np.random.default_rng(1998)
_MULTIPLY = _rng.integers(1, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each row, and their number.

    Words are runs of ASCII letters, digits, underscores and of all other
    characters, in lower case.  A text of fewer than k words has all its words
    as its only shingle; one without words has none.
    """
    data = _FOLD[data]
    if len(data):
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[capital] += 32
    starts, ends, rows = split_words(data, offsets, _WORD_EDGE)
    n_rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_rows, np.int64)
    words = hash_words(data, starts, ends)
    per_row = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(per_row) - per_row
    h = np.zeros(len(words), dtype=np.uint64)
    left = np.repeat(first + per_row, per_row) - np.arange(len(words))  # words from here to the row's end
    for i in range(k):
        part = np.zeros(len(words), dtype=np.uint64)
        part[: max(0, len(words) - i)] = words[i:]
        h = np.where(left > i, (h ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1), h)
    h = mix(h)
    keep = (left >= k) | (np.arange(len(words)) == np.repeat(first, per_row))
    h, rows = h[keep], rows[keep]
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]
    return h[new], np.bincount(rows[new], minlength=n_rows)


def fingerprints(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits of each row's whole set; 0 for an empty one."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = counts > 0
    first = (np.cumsum(counts) - counts)[full]
    if len(first):
        a, b = np.add.reduceat(sets, first), np.bitwise_xor.reduceat(sets * np.uint64(0xD6E8FEB86659FD93), first)
        out[full] = mix(mix(a) + b * np.uint64(3) + counts[full].astype(np.uint64))
    return out


def sketches(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Min-hash coordinates (rows x COORDINATES) of rows with a set that isn't empty."""
    full = counts[counts > 0]
    first = np.cumsum(full) - full
    h = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(full), COORDINATES), dtype=np.uint32)
    for i in range(COORDINATES):
        v = h * _MULTIPLY[i]
        v ^= v >> np.uint32(15)
        v *= _MULTIPLY[-1 - i]
        v += _ADD[i]
        out[:, i] = np.minimum.reduceat(v, first) if len(first) else 0
    return out


def _survives(drawn: float, similarity: float, depth: int) -> float:
    """Chance that a pair whose coordinates agree in this share is in one part after `depth` splits of a run."""
    survives = 1.0
    for _ in range(depth):
        x = drawn * survives
        survives = 1 - (1 - x) * (1 - (1 / similarity - 1) * x)
    return survives


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs after which a pair of this similarity has met with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - _survives(similarity, similarity, depth))))


def runs_at(recall: float, similarity: float, depth: int) -> int:
    """The same over all sketches that such a pair may have: some agree in fewer coordinates than it would be expected to."""
    agree = np.arange(COORDINATES + 1)
    share = np.array([math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in agree.tolist()])
    apart = np.array([1 - _survives(k / COORDINATES, similarity, depth) for k in agree.tolist()])
    runs = runs_for(recall, similarity, depth)
    while (share * apart**runs).sum() > 1 - recall:
        runs += 1
    return runs


def children(key: np.ndarray, sketch: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the next parts: split on the coordinate that the part's key draws, and on a second in 1/similarity - 1 of the parts."""
    draw = mix(key + np.uint64(0x51ED27))
    row = np.arange(len(key))
    second = (draw >> np.uint64(40)).astype(np.float64) / (1 << 24) < 1 / similarity - 1
    one = (draw % np.uint64(COORDINATES)).astype(np.int64)
    other = (one + 1 + (mix(draw) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    at = np.r_[row, row[second]]
    coordinate = np.r_[one, other[second]]
    value = sketch[at, coordinate].astype(np.uint64)
    return at, mix(mix(key[at] + value * np.uint64(0x9E3779B97F4A7C15)) + coordinate.astype(np.uint64))


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str], size: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, many small groups at a time: about `size` bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.nbytes
        if n < size:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[table.num_rows - 1].as_py() for k in keys]
        same = np.ones(table.num_rows, dtype=bool)
        for k, v in zip(keys, last, strict=True):
            same &= table.column(k).to_numpy() == v
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, n = table.to_batches(), table.nbytes
    if n:
        yield pa.Table.from_batches(held)


def _edges_of(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(new).tolist()
    return list(zip(first, [*first[1:], table.num_rows], strict=True))


def spanning(n: int, linked: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component in a boolean adjacency matrix."""
    root = np.arange(n)
    while True:
        # The least root among a node and its neighbours, then of that root.
        near = np.where(linked, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, near)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _cells(frame: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Deal each row of a group to the block pairs (i, j), i <= j, that hold its block: one pair for most groups."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    frame = frame.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return frame.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_other")


def _keys() -> dict:
    """What a row is known by: its id (the least number for null) and a hash of its text."""
    return {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "text_key": F.xxhash64(F.col("text").cast("string"))}


def _sets(docs: DataFrame) -> DataFrame:
    """doc, text_key, node (fingerprint of the set), and the node's coordinates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, counts = shingle_sets(*string_bytes(part.column(1)))
            full = counts > 0
            sketch = sketches(sets, counts)
            raw = np.full(len(counts), None, dtype=object)
            raw[full] = [s.tobytes() for s in sketch]
            node = fingerprints(sets, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(node), pa.array(counts, pa.int64()), pa.array(raw.tolist(), pa.binary())], names=["doc", "text_key", "node", "n_shingles", "sketch"])

    keys = _keys()
    return docs.select(keys["doc"].alias("doc"), F.col("text").cast("string").alias("text"), keys["text_key"].alias("text_key")).mapInArrow(run, "doc long, text_key long, node long, n_shingles long, sketch binary")


def _paths(nodes: DataFrame, runs: int, depth: int, similarity: float) -> DataFrame:
    """(key, node) of each node's parts after `depth` splits in all runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, COORDINATES)
            node = batch.column(0).to_numpy()
            for r in range(runs):
                key, row = np.full(len(node), mix(np.array([r + 1], np.uint64))[0]), np.arange(len(node))
                for _ in range(depth):
                    at, key = children(key, sketch[row], similarity)
                    row = row[at]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[row])], names=["key", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long").distinct()


def _candidates(parts: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that span the nodes of each part whose estimated similarity isn't too low."""
    keys = ["key", "i", "j"]
    dealt = _cells(parts, "key", "n", BLOCK)
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            nodes = table.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            a, b = [], []
            for lo, hi in _edges_of(table, keys):
                s, m = sketch[lo:hi], hi - lo
                if m == 1:
                    continue
                # Each in turn against all that are not yet in its component.
                root = np.arange(m)
                for x in range(m - 1):
                    rest = np.flatnonzero(root != root[x])
                    if not len(rest):
                        break
                    hit = rest[(s[rest] == s[x]).mean(axis=1) >= similarity - SLACK]
                    for r in np.unique(root[hit]).tolist():
                        a.append(nodes[lo + r])
                        b.append(nodes[lo + root[x]])
                        root[root == r] = root[x]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.select(*keys, "node", "sketch").mapInArrow(run, "a long, b long").distinct()


def _intersections(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of common elements of all pairs of sets, by products of membership columns."""
    m = len(counts)
    row = np.repeat(np.arange(m), counts)
    _, column, many = np.unique(values, return_inverse=True, return_counts=True)
    shared = many[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, at), np.searchsorted(column, at + width)
        member = np.zeros((m, width), dtype=np.float32)
        member[row[lo:hi], column[lo:hi] - at] = 1
        out += member @ member.T
    return out.astype(np.int64)


def _exact(grouped: DataFrame, similarity: float) -> DataFrame:
    """Per node and cell of its candidate group: copies of the nodes that it links to, and the least node of its component there."""
    keys = ["grp", "i", "j"]

    def run_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, counts = shingle_sets(*string_bytes(part.column(part.schema.get_field_index("text"))))
            node = fingerprints(sets, counts).view(np.int64)
            at = np.r_[0, np.cumsum(counts)]
            want = part.column(part.schema.get_field_index("node")).to_numpy()
            rows = np.flatnonzero(node == want)  # of rows that share a doc_id the one that the node stands for
            raw = [sets[at[i] : at[i + 1]].tobytes() for i in rows.tolist()]
            kept = [part.column(part.schema.get_field_index(c)).take(pa.array(rows)) for c in ("grp", "size", "node", "copies")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(raw, pa.binary())], names=["grp", "size", "node", "copies", "shingles"])

    sets = grouped.mapInArrow(run_sets, "grp long, size long, node long, copies long, shingles binary")
    dealt = _cells(sets, "grp", "size", BLOCK).repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            nodes, copies, own = (table.column(c).to_numpy() for c in ("node", "copies", "_own"))
            i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
            raw = table.column("shingles").to_pylist()
            out = [[], [], []]
            for lo, hi in _edges_of(table, keys):
                at = lo + np.flatnonzero(np.r_[True, nodes[lo + 1 : hi] != nodes[lo : hi - 1]])  # a node once
                if len(at) < 2:
                    continue
                sets = [np.frombuffer(raw[x], np.uint64) for x in at.tolist()]
                counts = np.array([len(s) for s in sets])
                common = _intersections(np.concatenate(sets), counts)
                linked = common >= similarity * (counts[:, None] + counts[None, :] - common) - 1e-9
                np.fill_diagonal(linked, False)
                if i[lo] != j[lo]:
                    linked &= own[at][:, None] != own[at][None, :]
                links = linked @ copies[at]
                hit = np.flatnonzero(links)
                out[0].append(nodes[at][hit])
                out[1].append(nodes[at][spanning(len(at), linked)][hit])
                out[2].append(links[hit])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["a", "b", "links"])

    return dealt.select(*keys, "_own", "node", "copies", "shingles").mapInArrow(run, "a long, b long, links long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and n_links (other documents of at least this similarity) of each document.

    A class is a connected component of links.  Equal texts are linked.  Texts
    without words (null and empty ones too) link to nothing and are classes of
    their own.  A row that repeats another one counts as a document; a null
    doc_id has a null class_id unless its class holds another id.  An empty
    table gives an empty one.
    """
    full, alone, classes = _classes(docs, similarity, recall)
    doc_id = F.when(F.col("doc") != -(1 << 63), F.col("doc"))
    own = alone.select(doc_id.alias("doc_id"), doc_id.alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.select("doc", "node").join(classes, "node").select(doc_id.alias("doc_id"), F.when(~F.col("first.no_id"), F.col("first.doc")).alias("class_id"), "n_links").unionByName(own)


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Of each class of near duplicates one row with all its columns: that of the least id (null last), then of the least hash of its text.

    A class is a chain of links, so a text may go that is near to a text that
    goes and not to the one that stays.  Texts without words stay; rows that
    repeat both id and text are one.  An empty table gives an empty one.
    """
    full, _, classes = _classes(docs, similarity, recall)
    row = full.select("node", F.struct(_no_id().alias("no_id"), "doc", "text_key").alias("row"))
    later = row.join(classes.select("node", "first"), "node").filter("row <> first").select("row.doc", "row.text_key").distinct()
    keyed = docs.select(F.struct(*map(column, docs.columns)).alias("row"), *(v.alias(k) for k, v in _keys().items()))
    kept = keyed.join(later, ["doc", "text_key"], "left_anti")
    repeated = keyed.groupBy("doc", "text_key").count().filter("count > 1").limit(1).count() > 0
    return (kept.dropDuplicates(["doc", "text_key"]) if repeated else kept).select("row.*")


def _no_id():
    return F.col("doc") == -(1 << 63)


def _classes(docs: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with words (doc, text_key, node), rows without, and of each node: the first row of its class (no_id, doc, text_key) and its links."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "near-duplicates")
    _sets(docs).write.parquet(f"{folder}/sets")
    sets = spark.read.parquet(f"{folder}/sets")
    full = sets.filter("sketch is not null")
    # Documents of equal sets are one node: its size and least document are pre-aggregated.
    full.groupBy("node").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"), F.min(F.struct(_no_id().alias("no_id"), "doc", "text_key")).alias("first")).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    found, some = [], nodes
    # What pairs may be missed is shared by all depths: however deep the large parts go, the sum is 1 - recall.
    each = 1 - (1 - recall) / (MAX_DEPTH - DEPTH + 1)
    for depth in range(DEPTH, MAX_DEPTH + 1):
        _paths(some, runs_at(each, similarity, depth), depth, similarity).write.parquet(f"{folder}/paths{depth}")
        paths = spark.read.parquet(f"{folder}/paths{depth}")
        sizes = paths.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        large = F.col("n") > 4 * BLOCK
        more = depth < MAX_DEPTH and sizes.filter(large).limit(1).count() > 0
        parts = paths.join(sizes.filter(~large) if more else sizes, "key").join(nodes.select("node", "sketch"), "node")
        found.append(_candidates(parts, similarity))
        if not more:
            break
        # The nodes of parts that are still large start anew, with the more runs that a deeper split asks for: a pair
        # that has met is in a part compared here or has both its nodes among them.  Where splitting ends, the grid of
        # blocks takes the large parts.
        hot = paths.join(sizes.filter(large).select("key"), "key").select("node").distinct()
        some = nodes.join(hot, "node", "left_semi")
    edges = found[0]
    for e in found[1:]:
        edges = edges.unionByName(e)
    groups = components(edges).withColumnRenamed("root", "grp")
    members = groups.join(nodes.select("node", "rep", "copies", "n_shingles"), "node")
    weight = F.greatest(F.count(F.lit(1)), F.floor(F.sum("n_shingles") / LONG)).cast("long")
    sized = members.join(members.groupBy("grp").agg(weight.alias("size")), "grp")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(key.alias("rep"), F.col("text").cast("string").alias("text"))
    _exact(sized.join(texts, "rep").select("grp", "size", "node", "copies", "text"), similarity).write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    roots = components(links)
    total = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "first", "copies").join(roots, "node", "left").join(total, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first").alias("first"))
    classes = known.drop("first").join(least, "root").select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return full, sets.filter("sketch is null"), classes
