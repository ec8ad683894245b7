"""Clusters by density: mutual reachability, a minimum spanning forest by Boruvka rounds, a condensed tree.

The neighbour graph (id, near, distance), as operators.neighbours makes it, is
all that is known of the rows.  Two rows that no path of it joins are never in
one cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import shared_dir

#: Edges of the forest that are merged in one run (24 bytes each); longer forests take several runs, in order.
EDGE_BLOCK = 500_000
#: Distances below this count as this: copies have no density of their own.
LEAST = 1e-9


def mutual_reachability(graph: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w) of a < b: the greatest of their distance and both rows' distance to their `min_samples`-th neighbour (or to their last, if they have fewer)."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "near"))
    core = graph.withColumn("_n", place).filter(F.col("_n") <= min_samples).groupBy("id").agg(F.max("distance").alias("core"))
    pairs = graph.groupBy(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).agg(F.min("distance").alias("distance")).filter("a <> b")
    both = pairs.join(core.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b", "left")
    return both.select("a", "b", F.greatest("distance", "ca", F.coalesce("cb", F.lit(0.0))).alias("w"))


def spanning_forest(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """The edges (a, b, w) of the minimum spanning forest; edges of one weight count in the order of a, then b.

    In each Boruvka round every tree takes its least outgoing edge, found by a
    minimum that is aggregated in each task first, and hooks onto the tree at
    its other end; of two trees that take the same edge the lesser is the
    root.  Paths to roots are halved until they are single steps.  Every step
    is a written table.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark, "forest")
    kind = edges.schema["a"].dataType.simpleString()
    edges.select("a", "b", "w", F.col("a").alias("ta"), F.col("b").alias("tb")).write.parquet(f"{folder}/open-0")
    taken = []
    for r in range(rounds):
        left = spark.read.schema(f"a {kind}, b {kind}, w double, ta {kind}, tb {kind}").parquet(f"{folder}/open-{r}")
        if left.isEmpty():
            break
        key = F.struct("w", "a", "b", "ta", "tb")
        least = left.select(F.col("ta").alias("t"), key.alias("e")).unionByName(left.select(F.col("tb").alias("t"), key.alias("e"))).groupBy("t").agg(F.min("e").alias("e"))
        hooks = least.select("t", F.when(F.col("t") == F.col("e.ta"), F.col("e.tb")).otherwise(F.col("e.ta")).alias("to"), "e.a", "e.b", "e.w")
        hooks.write.parquet(f"{folder}/hooks-{r}")
        hooks = spark.read.parquet(f"{folder}/hooks-{r}")
        taken.append(hooks.select("a", "b", "w"))
        back = hooks.select(F.col("t").alias("to"), F.col("to").alias("_back"))
        # Edges are in one strict order, so hooks form cycles of two trees at most.
        up = hooks.select("t", "to").join(back, "to", "left").select("t", F.when((F.col("_back") == F.col("t")) & (F.col("t") < F.col("to")), F.col("t")).otherwise(F.col("to")).alias("to"))
        for j in range(rounds):
            up.write.parquet(f"{folder}/up-{r}-{j}")
            up = spark.read.parquet(f"{folder}/up-{r}-{j}")
            longer = up.join(up.select(F.col("t").alias("to"), F.col("to").alias("_further")), "to").select("t", "to", "_further")
            if longer.filter("to <> _further").isEmpty():
                break
            up = longer.select("t", F.col("_further").alias("to"))
        for end in ("ta", "tb"):
            left = left.join(up.select(F.col("t").alias(end), F.col("to").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
        left.filter("ta <> tb").select("a", "b", "w", "ta", "tb").write.parquet(f"{folder}/open-{r + 1}")
    else:
        raise RuntimeError(f"the forest wasn't done within {rounds} rounds")
    if not taken:
        return edges.select("a", "b", "w").limit(0)
    whole = taken[0]
    for t in taken[1:]:
        whole = whole.unionByName(t)
    return whole.distinct()


@dataclass
class Tree:
    """A tree of the forest while edges are merged in ascending order: a group of fewer rows than a cluster, or a cluster."""

    size: int = 1
    cluster: int | None = None


@dataclass
class Cluster:
    """What is known of a cluster: density is one over distance; rows leave it at `sum_density` in all."""

    number: int
    size: int = 0
    sum_density: float = 0.0
    children: list[int] = field(default_factory=list)
    parent: int | None = None
    stability: float = 0.0
    best: float = 0.0
    own: bool = True


class Condenser:
    """Merges edges in ascending order, keeping sizes, clusters and their stabilities, but no rows."""

    def __init__(self, least: int):
        self.least = least
        self.clusters: list[Cluster] = []

    def _new(self, children: list[int], size: int, density: float) -> int:
        c = Cluster(len(self.clusters), size, size * density, children)
        for k in children:
            self.clusters[k].parent = c.number
        self.clusters.append(c)
        return c.number

    def _end(self, number: int, density: float) -> None:
        """A cluster's stability, when it meets another one; or it was the last."""
        c = self.clusters[number]
        c.stability = c.sum_density - c.size * density
        below = sum(self.clusters[k].best for k in c.children)
        c.own = not c.children or c.stability >= below
        c.best = c.stability if c.own else below

    def merge(self, a: Tree, b: Tree, w: float) -> tuple[Tree, list[tuple[Tree, int]]]:
        """The tree of both, and the groups whose rows have found their first cluster by this."""
        density = 1 / max(w, LEAST)
        out = Tree(a.size + b.size)
        found = []
        if a.cluster is not None and b.cluster is not None:
            self._end(a.cluster, density)
            self._end(b.cluster, density)
            out.cluster = self._new([a.cluster, b.cluster], out.size, density)
        elif a.cluster is None and b.cluster is None:
            if out.size >= self.least:
                out.cluster = self._new([], out.size, density)
                found = [(a, out.cluster), (b, out.cluster)]
        else:
            big, small = (a, b) if a.cluster is not None else (b, a)
            c = self.clusters[big.cluster]
            c.size += small.size
            c.sum_density += small.size * density
            out.cluster = big.cluster
            found = [(small, big.cluster)]
        return out, found

    def chosen(self, method: str) -> dict[int, int]:
        """Cluster -> the chosen cluster that it is in; clusters above all chosen ones are missing.  Call it once, at the end."""
        roots = [c for c in self.clusters if c.parent is None]
        for c in roots:
            self._end(c.number, 0.0)
        whole = roots[0].number if len(roots) == 1 else None  # all that is dense: no cluster of its own
        into: dict[int, int] = {}
        for c in reversed(self.clusters):  # parents come after their children
            if c.parent is not None and c.parent in into:
                into[c.number] = into[c.parent]
            elif c.number != whole and (c.own if method == "eom" else not c.children):
                into[c.number] = c.number
        return into


class _Run:
    """One run of edges: the trees that it touches, with their states, and the groups of earlier trees that they are made of."""

    def __init__(self, known: Condenser, fresh: int):
        self.known, self.fresh = known, fresh
        self.own: dict = {}  # rows that were in no tree before -> their tree
        self.trees: dict[int, Tree] = {}
        self.up: dict[int, int] = {}
        self.members: dict[int, list[int]] = {}  # of small trees, which have fewer parts than a cluster has rows
        self.found: dict[int, int] = {}

    def tree(self, row, tree: int | None, size: int | None, cluster: int | None) -> int:
        """The number of a row's tree now."""
        if tree is None:
            tree = self.own.get(row)
            if tree is None:
                tree = self.own[row] = self.fresh
                self.fresh += 1
                self.trees[tree] = Tree()
        elif tree not in self.trees and tree not in self.up:
            self.trees[tree] = Tree(size, cluster)
        return self._root(tree)

    def _root(self, t: int) -> int:
        while t in self.up:
            self.up[t] = self.up.get(self.up[t], self.up[t])
            t = self.up[t]
        return t

    def merge(self, a: int, b: int, w: float) -> None:
        parts = {t: self.members.pop(t, [t]) for t in (a, b) if self.trees[t].cluster is None}
        merged, done = self.known.merge(self.trees[a], self.trees[b], w)
        for tree, c in done:
            for t in parts[a if tree is self.trees[a] else b]:
                self.found[t] = c
        if merged.cluster is None:
            self.members[a] = parts[a] + parts[b]
        self.up[b] = a
        self.trees[a] = merged
        del self.trees[b]

    def moved(self) -> list[tuple]:
        """(tree before, tree after, its size, its cluster, the first cluster of the tree's rows if they found it now)."""
        out = []
        for t in [*self.trees, *self.up]:
            to = self._root(t)
            out.append((t, to, self.trees[to].size, self.trees[to].cluster, self.found.get(t)))
        return out


def cluster(graph: DataFrame, rows: DataFrame, min_cluster_size: int = 15, min_samples: int | None = None, method: str = "eom", block: int = EDGE_BLOCK) -> DataFrame:
    """(id, topic_id) for each id of `rows`: the cluster of its row, or -1.

    Rows are joined in the order of mutual reachability.  A cluster begins
    where a tree has `min_cluster_size` rows, and ends where it meets another;
    method "eom" chooses the clusters whose rows stay longest, by the sum of
    density beyond that at which the cluster ends, "leaf" those that no other
    is part of.  All rows together are no cluster.  Topics are numbered from 0, the largest first (ties: least id).
    Null ids are left out, repeated ones count once; `min_samples` is
    `min_cluster_size` where it isn't given, and the graph should have as many
    neighbours.

    The forest's edges come to the driver in ascending runs of `block`; of
    rows only the trees that a run touches, as numbers.  Rows get their
    cluster by joins.
    """
    if method not in ("eom", "leaf"):
        raise ValueError(f"no such method: {method}")
    if min_cluster_size < 2:
        raise ValueError("a cluster has two rows or more")
    spark = graph.sparkSession
    folder = shared_dir(spark, "density")
    kind = graph.schema["id"].dataType.simpleString()
    spanning_forest(mutual_reachability(graph, min_samples or min_cluster_size)).write.parquet(f"{folder}/forest")
    forest = spark.read.parquet(f"{folder}/forest")
    n = forest.count()
    runs = max(1, -(-n // block))
    forest.repartitionByRange(runs, "w", "a", "b").withColumn("run", F.spark_partition_id()).write.partitionBy("run").parquet(f"{folder}/runs")
    known = Condenser(min_cluster_size)
    trees = "tree long, size long, cluster long"
    names = spark.createDataFrame([], f"id {kind}, {trees}")  # rows met in earlier runs, with the state of their tree
    first = spark.createDataFrame([], f"id {kind}, into long")
    fresh = 0
    for r in range(runs):
        edges = spark.read.schema(f"a {kind}, b {kind}, w double, run int").parquet(f"{folder}/runs").filter(F.col("run") == r)
        for end in ("a", "b"):
            edges = edges.join(names.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("tree", "size", "cluster"))), end, "left")
        got = edges.orderBy("w", "a", "b").toArrow().to_pylist()
        run = _Run(known, fresh)
        for e in got:
            run.merge(run.tree(e["a"], e["tree_a"], e["size_a"], e["cluster_a"]), run.tree(e["b"], e["tree_b"], e["size_b"], e["cluster_b"]), e["w"])
        fresh = run.fresh
        started = spark.createDataFrame(list(run.own.items()) or [], f"id {kind}, tree long").select("id", "tree", F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster"))
        moved = spark.createDataFrame(run.moved(), "tree long, _tree long, _size long, _cluster long, into long")
        now = names.unionByName(started).join(moved, "tree", "left")
        now.select("id", F.coalesce("_tree", "tree").alias("tree"), F.coalesce("_size", "size").alias("size"), F.coalesce("_cluster", "cluster").alias("cluster"), "into").write.parquet(f"{folder}/names-{r}")
        now = spark.read.schema(f"id {kind}, {trees}, into long").parquet(f"{folder}/names-{r}")
        first = first.unionByName(now.filter("into is not null").select("id", "into"))
        names = now.drop("into")
    into = known.chosen(method)
    final = spark.createDataFrame(list(into.items()), "cluster long, chosen long")
    ids = rows.filter(F.col("id").isNotNull()).select("id").distinct()
    placed = ids.join(first.join(final, F.col("into") == F.col("cluster")).select("id", "chosen"), "id", "left")
    sizes = placed.filter("chosen is not null").groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    # At most one row for each `min_cluster_size` rows.
    numbered = sizes.withColumn("topic_id", (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).cast("int")).select("chosen", "topic_id")
    return placed.join(numbered, "chosen", "left").select("id", F.coalesce("topic_id", F.lit(-1)).alias("topic_id"))
