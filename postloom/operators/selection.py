"""Order statistics of any number of groups, a few jobs for all of them.

Open searches are a table: the group, the wanted rank, and the bracket it lies
in. A round cuts every bracket by edges, counts all brackets in one job, and
keeps the piece that holds the rank; searches whose bracket holds few rows are
ended by ordering that bracket. How many rounds there are hangs on the largest
group, not on the number of groups, and no group passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postloom.operators.joins import lookup_join
from postloom.session import settle

PICK_ROWS = 10_000
SLICE = 3
EDGES = 128


def group_key(by: Sequence[str]) -> Column:
    """Group columns as one string that is never null, so that null is a group of its own."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in by]), {"ignoreNullFields": "false"})


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def digest_cuts(rows: DataFrame, wanted: DataFrame, pick_rows: int = PICK_ROWS) -> DataFrame:
    """``(g, place, cut)``: the ``need``-th smallest digest ``h`` of each group.

    ``rows(g, h)`` holds uniform hex digests, ``wanted(g, place, need, inside)`` the ranks, counted from one, and the
    size of the group. Digests that begin alike are one slice, and a round makes the slices finer by ``SLICE`` characters.
    """
    open_ = settle(wanted.withColumn("slice", F.lit("")), "open-cuts")
    done, width = [], 0
    while True:
        mine = rows.withColumn("slice", F.substring("h", 1, width) if width else F.lit(""))
        small, large = open_.filter(F.col("inside") <= pick_rows), open_.filter(F.col("inside") > pick_rows)
        lists = lookup_join(mine, small.select("g", "slice").distinct(), ["g", "slice"], "inner")
        lists = lists.groupBy("g", "slice").agg(F.sort_array(F.collect_list("h")).alias("all"))
        done.append(settle(small.join(lists, ["g", "slice"]).select("g", "place", F.get("all", (F.col("need") - 1).cast("int")).alias("cut")), "cuts"))
        if large.isEmpty():
            return _union(done)
        finer = F.substring("h", 1, width + SLICE)
        counts = lookup_join(mine, large.select("g", "slice").distinct(), ["g", "slice"], "inner")
        counts = counts.groupBy("g", "slice", finer.alias("next")).agg(F.count(F.lit(1)).alias("n"))
        # at most 16 ** SLICE pieces of a slice
        up_to = F.sum("n").over(W.partitionBy("g", "slice").orderBy("next").rowsBetween(W.unboundedPreceding, 0))
        pieces = counts.withColumn("before", up_to - F.col("n"))
        held = large.join(pieces, ["g", "slice"]).filter((F.col("need") > F.col("before")) & (F.col("need") <= F.col("before") + F.col("n")))
        open_ = settle(held.select("g", "place", (F.col("need") - F.col("before")).alias("need"), F.col("n").alias("inside"), F.col("next").alias("slice")), "open-cuts")
        width += SLICE


def value_ranks(data: DataFrame, wanted: DataFrame, pick_rows: int = PICK_ROWS, edges: int = EDGES) -> DataFrame:
    """``(g, rank, value)``: the value at each zero-based rank of the numbers ``v`` of a group.

    ``data(g, v)`` has no null and no NaN, ``wanted(g, rank, inside)`` the ranks and the size of the group. Brackets are
    open intervals; their edges are approximate quantiles of what they hold, and a rank whose value is an edge is found
    there and then, so ties never stay in a bracket.
    """
    bound = lambda x: F.lit(x).cast("double")
    open_ = settle(wanted.select("g", "rank", bound(None).alias("low"), bound(None).alias("high"), F.lit(0).cast("long").alias("below"), "inside"), "open-ranks")
    grid = [i / edges for i in range(edges + 1)]
    done = []
    within = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    name = ["g", "bracket"]

    def inside(brackets: DataFrame, *more: str) -> DataFrame:
        """Rows of the groups with their brackets; a group has at most as many as ranks are wanted of it."""
        held = brackets.groupBy("g").agg(F.collect_list(F.struct("bracket", "low", "high", *more)).alias("b"))
        met = lookup_join(data, held, "g", "inner").select("g", "v", F.explode("b").alias("b")).select("g", "v", "b.*")
        return met.filter(within)

    while True:
        # searches in the same bracket share it
        open_ = open_.withColumn("bracket", F.to_json(F.struct("low", "high")))
        small, large = open_.filter(F.col("inside") <= pick_rows), open_.filter(F.col("inside") > pick_rows)
        lists = inside(small.select("g", "bracket", "low", "high").distinct()).groupBy(*name).agg(F.sort_array(F.collect_list("v")).alias("all"))
        done.append(settle(small.join(lists, name).select("g", "rank", F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("value")), "ranks"))
        if large.isEmpty():
            return _union(done)
        wide = large.select("g", "bracket", "low", "high").distinct()
        cut = inside(wide).groupBy(*name).agg(F.percentile_approx("v", grid, 4 * edges).alias("e"))
        cut = settle(wide.join(cut, name).withColumn("e", F.array_sort(F.array_distinct("e"))), "bracket-edges")
        # 2 k is the open piece below edge k, 2 k + 1 the edge itself
        piece = 2 * F.size(F.filter("e", lambda e: e < F.col("v"))) + F.array_contains("e", F.col("v")).cast("int")
        counts = inside(cut, "e").groupBy(*name, piece.alias("piece")).agg(F.count(F.lit(1)).alias("n"))
        up_to = F.sum("n").over(W.partitionBy(*name).orderBy("piece").rowsBetween(W.unboundedPreceding, 0))
        counts = counts.withColumn("before", up_to - F.col("n")).join(cut.select(*name, "e"), name)
        at = F.col("rank") - F.col("below")
        held = large.join(counts, name).filter((at >= F.col("before")) & (at < F.col("before") + F.col("n")))
        held = settle(held.withColumn("edge", F.floor(F.col("piece") / 2).cast("int")), "held-ranks")
        on_edge = F.col("piece") % 2 == 1
        done.append(held.filter(on_edge).select("g", "rank", F.get("e", F.col("edge")).alias("value")))
        open_ = settle(
            held.filter(~on_edge).select(
                "g", "rank", F.coalesce(F.when(F.col("edge") > 0, F.get("e", F.col("edge") - 1)), F.col("low")).alias("low"),
                F.coalesce(F.get("e", F.col("edge")), F.col("high")).alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("inside"),
            ),
            "open-ranks",
        )


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], pick_rows: int = PICK_ROWS) -> DataFrame:
    """``by`` columns and ``edges``: linearly interpolated quantiles of every group, in the order of ``probs``.

    NaN and null are left aside; a group without other values has no row. Null is a group of its own.
    """
    by = list(by)
    v = F.col(f"`{value}`").cast("double")
    data = df.filter(v.isNotNull() & ~F.isnan(v))
    sizes = settle(data.groupBy(*by).agg(F.count(F.lit(1)).alias("_inside")).withColumn("_g", group_key(by)), "group-sizes")
    spots = F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p")
    ends = sizes.select(F.col("_g").alias("g"), F.col("_inside").alias("inside"), spots)
    ends = ends.withColumn("spot", (F.col("inside") - 1) * F.col("p"))
    ends = ends.select("g", "inside", "i", (F.col("spot") - F.floor("spot")).alias("t"), F.floor("spot").alias("first"), F.ceil("spot").alias("last"))
    wanted = ends.select("g", "inside", F.explode(F.array("first", "last")).alias("rank")).distinct()
    found = settle(value_ranks(data.select(group_key(by).alias("g"), v.alias("v")), wanted, pick_rows), "found-ranks")
    both = ends.join(found.select("g", F.col("rank").alias("first"), F.col("value").alias("low")), ["g", "first"])
    both = both.join(found.select("g", F.col("rank").alias("last"), F.col("value").alias("high")), ["g", "last"])
    # from the nearer end: equal ends give exactly that value
    low, high, t = F.col("low"), F.col("high"), F.col("t")
    between = F.when(t >= 0.5, high - (high - low) * (1 - t)).otherwise(low + (high - low) * t)
    edges = both.groupBy(F.col("g").alias("_g")).agg(F.sort_array(F.collect_list(F.struct("i", between.alias("x")))).alias("_e"))
    return sizes.join(edges, "_g").select(*by, F.col("_e.x").alias("edges"))


def stratified_cuts(df: DataFrame, digest: Column, label: str, shares: Sequence[float], pick_rows: int = PICK_ROWS) -> DataFrame:
    """``(g, cuts)``: for every class the digests below which the given shares of its rows lie; an empty share is ``""``."""
    rows = df.select(group_key([label]).alias("g"), digest.alias("h"))
    sizes = settle(rows.groupBy("g").agg(F.count(F.lit(1)).alias("inside")), "class-sizes")
    places = sizes.select("g", "inside", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("place", "share"))
    places = places.withColumn("need", F.bround(F.col("share") * F.col("inside")).cast("long")).select("g", "place", "need", "inside")
    found = digest_cuts(rows, places.filter("need > 0"), pick_rows)
    every = places.join(found, ["g", "place"], "left").withColumn("cut", F.coalesce("cut", F.lit("")))
    return every.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("place", "cut"))).alias("c")).select("g", F.col("c.cut").alias("cuts"))


def with_cuts(df: DataFrame, cuts: DataFrame, label: str, key: str, name: str, value) -> DataFrame:
    """Rows with a column computed from the cuts of their class; ``value`` makes it from the cuts."""
    columns = df.columns
    cuts = cuts.select(F.col("g").alias("_g"), F.col("cuts").alias("_cuts"))
    met = lookup_join(df.withColumn("_g", group_key([label])), cuts, "_g", "left", [key])
    return met.withColumn(name, value(F.col("_cuts"))).select(*columns, name)


def fold_shares(folds: int) -> list[float]:
    return [i / folds for i in range(1, folds)]


def rounds_for(rows: int, pick_rows: int = PICK_ROWS) -> int:
    """Rounds that :func:`digest_cuts` takes for a largest group of so many rows, when digests are uniform."""
    return 1 + max(0, math.ceil(math.log(max(1.0, rows / pick_rows), 16**SLICE) - 1e-9))


def dense_index(table: DataFrame) -> DataFrame:
    """``term, df, idf, idx``: dense positions 0..n-1, in an order spread evenly over slices of a digest."""
    sliced = table.withColumn("_h", F.md5("term")).withColumn("_s", F.substring("_h", 1, 3))
    sizes = sliced.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    # at most 4096 slices, whatever the size of the vocabulary
    before = sizes.select(
        "_s", (F.sum("_n").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before")
    )
    place = F.row_number().over(W.partitionBy("_s").orderBy("_h", "term")) - 1
    numbered = sliced.withColumn("_p", place).join(F.broadcast(before), "_s")
    return settle(numbered.select("term", "df", "idf", (F.col("_p") + F.col("_before")).alias("idx")), "vocabulary")
