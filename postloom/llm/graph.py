"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import settle


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Every round hooks the larger neighbours of a node, then the smaller ones,
    to the smallest node around it. Both are one aggregate, combined before the
    shuffle, and one join whose large keys adaptive execution splits. The work
    of a round is linear in the edges, and the table of edges is written each
    time. Null ends are left out; an empty table gives an empty result.
    """
    edges = settle(edges.filter("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settle(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = settle(small.filter("a <> b").distinct(), "small-star")
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
