"""Labelled samples for fitting, and the held-out rule.

A row is held out when crc32 of its doc_id as text leaves 2 modulo 4; such
rows' labels are never read for a fit.  A fit uses at most `max_rows` labelled
rows, half of each class where both are plentiful, the first by hash of
doc_id; rows of more than `max_chars` characters are left out of it (they are
scored whole like all others).
"""

from __future__ import annotations

import gc
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS, MAX_CHARS = 4000, 20_000


def held_out(doc_id: str = "doc_id") -> Column:
    """A null doc_id isn't held out; it has no labels either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def release() -> None:
    """Give the memory of a fit back to the system: the driver lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def fit_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[pa.Table, float]:
    """Texts with their 0/1 label, and the log odds to add for the classes' true shares.

    Null labels are ignored; of several labels of one doc_id the highest
    counts, and of several texts the least: what comes to the driver is
    max_rows rows of max_chars characters at most.  Empty tables give an empty
    sample.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    shares = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id")
    some = [known.filter(F.col("y") == y).withColumn("_o", order).orderBy("_o", "doc_id").limit(max_rows // 2).select("doc_id", "y") for y in (0, 1)]
    chosen = some[0].unionByName(some[1])  # at most max_rows rows of two numbers
    rows = docs.filter(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    got = [sum(1 for v in rows.column("y").to_pylist() if v == y) for y in (0, 1)]
    shift = math.log((shares.get(1, 0) + 0.5) / (shares.get(0, 0) + 0.5)) - math.log((got[1] + 0.5) / (got[0] + 0.5))
    return rows, shift
