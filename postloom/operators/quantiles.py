"""Exact quantiles and quantile classes at any table size.

While the number of distinct values is known to be bounded, order statistics
are read off the cumulative counts of the distinct values. Beyond that they are
found by narrowing: each round brackets every wanted rank with an approximate
quantile of guaranteed rank error, counts what lies below and inside each
bracket, and repeats inside the brackets. The driver only ever holds a few
numbers per probability.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DISTINCT_LIMIT = 200_000
ACCURACY = 1_000


def exact_quantiles(
    df: DataFrame, value: str | Column, probs: Sequence[float], distinct_limit: int = DISTINCT_LIMIT
) -> list[float] | None:
    """Linearly interpolated quantiles of a numeric column; None for no rows."""
    column = F.col(value) if isinstance(value, str) else value
    data = df.select(column.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n, distinct = data.agg(F.count("v"), F.approx_count_distinct("v", 0.02)).first()
    if n == 0:
        return None
    if distinct <= distinct_limit:
        return _from_counts(data, [], "v", probs)[()]
    spots = [(n - 1) * p for p in probs]
    ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
    found = order_statistics(data, ranks, n, distinct_limit)
    return [_between(found[math.floor(s)], found[math.ceil(s)], s - math.floor(s)) for s in spots]


def _between(low: float, high: float, t: float) -> float:
    """Linear interpolation, from the nearer end: equal ends give exactly that value."""
    return high - (high - low) * (1 - t) if t >= 0.5 else low + (high - low) * t


def _from_counts(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> dict[tuple, list[float]]:
    """Quantiles per group from cumulative counts of a bounded number of distinct values."""
    by = list(by)
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    group = W.partitionBy(*by)
    up_to = group.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(up_to)).withColumn("total", F.sum("n").over(group))

    def holds(p: Column) -> Column:
        """Whether a wanted rank falls on this value."""
        spot = (F.col("total") - 1) * p
        first = F.col("upto") - F.col("n")
        inside = lambda rank: (rank >= first) & (rank < F.col("upto"))
        return inside(F.floor(spot)) | inside(F.ceil(spot))

    wanted = F.array(*[F.lit(float(p)) for p in sorted(set(probs))])
    ends = (
        ranked.select(*by, "v", "total", F.explode(F.filter(wanted, holds)).alias("p"))
        .groupBy(*by, "p")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("total").alias("total"))
        .collect()
    )
    found: dict[tuple, dict[float, float]] = {}
    for r in ends:
        spot = (r.total - 1) * r.p
        found.setdefault(tuple(r[c] for c in by), {})[r.p] = _between(r.low, r.high, spot - math.floor(spot))
    return {key: [at[float(p)] for p in probs] for key, at in found.items()}


def order_statistics(data: DataFrame, ranks: Sequence[int], n: int, limit: int) -> dict[int, float]:
    """Values at zero-based ranks of column ``v``, by narrowing open brackets.

    A bracket is ordered once it holds at most ``limit`` rows. Ties at a bracket
    edge are counted apart, so every round leaves a strictly smaller bracket.
    """
    v = F.col("v")
    found: dict[int, float] = {}
    todo = {(None, None, 0, n): sorted(ranks)}  # (low, high, rows below, rows inside) -> ranks
    while todo:
        (low, high, below, inside), members = todo.popitem()
        part = data
        if low is not None:
            part = part.filter(v > F.lit(low))
        if high is not None:
            part = part.filter(v < F.lit(high))
        if inside <= limit:
            found.update(_ordered_pick(part, members, below))
            continue
        slack = 2.0 / ACCURACY
        cuts = set()
        for rank in members:
            p = (rank - below) / (inside - 1)
            cuts |= {max(p - slack, 0.0), min(p + slack, 1.0)}
        edges = sorted(set(part.agg(F.percentile_approx("v", sorted(cuts), ACCURACY)).first()[0]))
        counts = part.agg(
            *[F.count_if(v < F.lit(e)) for e in edges], *[F.count_if(v == F.lit(e)) for e in edges]
        ).first()
        under, ties = counts[: len(edges)], counts[len(edges) :]
        for rank in members:
            i = sum(rank >= below + u for u in under)  # edges with fewer rows below than the rank
            if i and rank < below + under[i - 1] + ties[i - 1]:
                found[rank] = edges[i - 1]
                continue
            start = below + (under[i - 1] + ties[i - 1] if i else 0)
            stop = below + (under[i] if i < len(edges) else inside)
            bracket = (edges[i - 1] if i else low, edges[i] if i < len(edges) else high, start, stop - start)
            todo.setdefault(bracket, []).append(rank)
    return found


def _ordered_pick(part: DataFrame, ranks: Sequence[int], below: int) -> dict[int, float]:
    """Order statistics of a bracket already known to hold few rows."""
    values = part.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v")
    out, wanted, seen = {}, sorted(ranks), below
    for row in values.toLocalIterator():
        seen += row.n
        while wanted and wanted[0] < seen:
            out[wanted.pop(0)] = row.v
    return out


def bin_index(value: Column, inner_edges: Sequence[float]) -> Column:
    """Number of inner edges below the value: the class of right-closed bins."""
    total = F.lit(0)
    for edge in inner_edges:
        total = total + (value > F.lit(edge)).cast("int")
    return F.when(value.isNotNull(), total)


def bin_edges(edges: Sequence[float], duplicates: str = "drop") -> list[float]:
    """Inner edges of quantile bins after the rule for equal edges."""
    kept = sorted(set(edges))
    if duplicates == "raise" and len(kept) < len(edges):
        raise ValueError("quantile edges are not unique")
    return kept[1:-1]


def quantile_class(df: DataFrame, value: str, q: int, name: str, duplicates: str = "drop", source: DataFrame | None = None) -> DataFrame:
    """Equal-frequency class of ``value`` over the whole table, as 0..q-1.

    ``source`` has the same values and is cheaper to read, such as the table before a join that keeps its rows.
    """
    edges = exact_quantiles(df if source is None else source, value, [i / q for i in range(q + 1)])
    inner = bin_edges(edges, duplicates) if edges else []
    return df.withColumn(name, bin_index(F.col(value).cast("double"), inner))
