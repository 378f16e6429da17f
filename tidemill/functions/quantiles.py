"""Exact quantiles of columns of numbers, in memory that doesn't grow with the column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Present values up to which Spark's percentile is asked, which holds all distinct ones.
IN_MEMORY = 1_000_000


def quantiles(rows: DataFrame, columns: list[str], shares: list[float], in_memory: int = IN_MEMORY, bins: int = 1024) -> dict[str, list[float] | None]:
    """The quantiles of each column of doubles, interpolated linearly; null for a column without a value.

    A column with more than in_memory values has its order statistics found by
    narrowing: a histogram over the range that holds one tells the bin it lies in,
    whose least and largest value are the next range, until they are the same. Each
    round is one aggregate for all columns, and a bin's row is all that is collected.
    """
    if not columns:
        return {}
    got = rows.agg(*(f for c in columns for f in (F.count(c), F.min(c), F.max(c)))).first()
    facts = {c: got[3 * i : 3 * i + 3] for i, c in enumerate(columns)}
    few = [c for c in columns if 0 < facts[c][0] <= in_memory]
    out: dict[str, list[float] | None] = dict.fromkeys(columns)
    if few:
        asked = F.array(*map(F.lit, shares))
        out |= dict(zip(few, rows.agg(*(F.percentile(c, asked) for c in few)).first()))
    many = [c for c in columns if facts[c][0] > in_memory]
    place = {(c, s): s * (facts[c][0] - 1) for c in many for s in shares}
    ranks = {(c, k) for (c, _), p in place.items() for k in (math.floor(p), math.ceil(p))}
    found = _order_statistics(rows, {t: (facts[t[0]][1], facts[t[0]][2], 0) for t in ranks}, bins)
    for c in many:
        out[c] = []
        for s in shares:
            p = place[c, s]
            low, high = found[c, math.floor(p)], found[c, math.ceil(p)]
            out[c].append(low + (high - low) * (p - math.floor(p)))
    return out


def _order_statistics(rows: DataFrame, ranges: dict[tuple[str, int], tuple[float, float, int]], bins: int) -> dict[tuple[str, int], float]:
    """The k-th value (from 0) of each column; ranges: the least and largest value it may be, and how many lie below."""
    found = {}
    while ranges:
        found |= {t: low for t, (low, high, _) in ranges.items() if low == high}
        ranges = {t: r for t, r in ranges.items() if r[0] != r[1]}
        if not ranges:
            break
        targets = [*ranges]
        cells = []
        for i, (c, k) in enumerate(targets):
            low, high, _ = ranges[c, k]
            bin_ = F.least(F.floor((F.col(c) / 2 - low / 2) / (high / 2 - low / 2) * bins), F.lit(bins - 1)).cast("int")
            cells.append(F.when(F.col(c).between(low, high), F.struct(F.lit(i).alias("t"), bin_.alias("bin"), F.col(c).cast("double").alias("v"))))
        each = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).select("e.*")
        counted = each.groupBy("t", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        below = {i: ranges[t][2] for i, t in enumerate(targets)}
        done: set[int] = set()
        for r in sorted(counted.collect(), key=lambda r: (r.t, r.bin)):  # bins for each target at most
            if r.t in done:
                continue
            if below[r.t] + r.n > targets[r.t][1]:
                ranges[targets[r.t]] = (r.low, r.high, below[r.t])
                done.add(r.t)
            below[r.t] += r.n
    return found
