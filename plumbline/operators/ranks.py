"""Exact order statistics of a column of any size, without one task that holds it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values that come to the driver for one rank.
FEW = 10_000


def order_statistics(rows: DataFrame, column: str, places: list[int], n: int, few: int = FEW) -> dict[int, float]:
    """The values at some places (from 0) of the ascending order of `n` numbers, without null or NaN.

    A sketch proposes a range for each place, whose rows are counted: the
    place is in it or in one beside it.  Ranges are narrowed so, all in the
    same passes, until each holds `few` different values at most; these come
    with their counts.  A value that many rows share is one entry.
    """
    v = F.col(column).cast("double")
    ranges = {p: (-math.inf, math.inf) for p in places}  # of values, both ends within
    done: dict[int, float] = {}
    whole: set[tuple[float, float]] = set()  # ranges that no cut has narrowed
    while len(done) < len(ranges):
        open_ = {p: r for p, r in ranges.items() if p not in done}
        some = sorted(set(open_.values()))
        inside = {r: (v >= r[0]) & (v <= r[1]) for r in some}
        counts = rows.agg(*(x for i, r in enumerate(some) for x in (F.count_if(v < r[0]).alias(f"b{i}"), F.count_if(inside[r]).alias(f"m{i}"), F.approx_count_distinct(F.when(inside[r], v), 0.05).alias(f"d{i}")))).first()
        for i, r in enumerate(some):
            mine = [p for p, q in open_.items() if q == r]
            before, within, different = counts[f"b{i}"], counts[f"m{i}"], counts[f"d{i}"]
            part = rows.filter(inside[r]).select(v.alias("v"))
            if r[0] == r[1] or different <= few or r in whole:
                values = part.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
                for p in mine:
                    at = before
                    for value, k in values:
                        at += k
                        if p < at:
                            done[p] = value
                            break
                continue
            error = 0.002
            shares = sorted({min(1.0, max(0.0, (p - before) / max(within - 1, 1) + d)) for p in mine for d in (-2 * error, 2 * error)})
            cuts = sorted(set(part.approxQuantile("v", shares, error)))
            edges = [r[0], *cuts, r[1]]
            low = rows.agg(*(F.count_if(v < c).alias(f"l{j}") for j, c in enumerate(cuts)), *(F.count_if(v <= c).alias(f"u{j}") for j, c in enumerate(cuts))).first()
            for p in mine:
                # The last cut with no more than p rows below it, and the first with more than p up to it.
                a = max((c for j, c in enumerate(cuts) if low[f"l{j}"] <= p), default=edges[0])
                b = min((c for j, c in enumerate(cuts) if low[f"u{j}"] > p), default=edges[-1])
                if (a, b) == r:
                    whole.add(r)
                ranges[p] = (a, b)
    return done


def percentiles(rows: DataFrame, column: str, shares: list[float], few: int = FEW) -> dict[float, float | None]:
    """Interpolated percentiles of a column without null or NaN; null where it is empty."""
    n = rows.count()
    if not n:
        return dict.fromkeys(shares)
    at = {s: s * (n - 1) for s in shares}
    values = order_statistics(rows, column, sorted({k for x in at.values() for k in (math.floor(x), math.ceil(x))}), n, few)
    return {s: values[math.floor(x)] + (x - math.floor(x)) * (values[math.ceil(x)] - values[math.floor(x)]) for s, x in at.items()}
