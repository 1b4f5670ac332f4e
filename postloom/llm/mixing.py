"""Mixing sources to target weights over a tree of domains, languages and sources.

The budget flows down the tree by weight. A node takes no more than its leaves
can give in ``epochs`` passes; what it cannot take goes to its siblings in
proportion to their weights, and only what no sibling can take counts as a
shortage of their parent, which was settled one level up in the same way. The
share of a node follows from one sorted running sum per parent: children are
full in ascending order of capacity over weight.

A leaf gives whole epochs, then the longest prefix of one more epoch that stays
within its budget, in an order drawn from seed, epoch and key. Prefix sums run
over ``BINS`` bins of that order, and over rows only in the bin where the budget
ends, so a leaf with a third of all rows is no single window.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.session import settle

BINS = 1 << 14
LEVELS = ("domain", "lang", "source")


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")), F.lit(0)).cast("long")


def weight_of(level: str, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(pairs[F.col(level).cast("string")], F.lit(default)).cast("long")


def node(levels: Sequence[str]) -> Column:
    """A name for a node that tells nulls from texts."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in levels])) if levels else F.lit("[]")


def shares(children: DataFrame) -> DataFrame:
    """``budget`` of each row of ``(parent, node, cap, weight, parent_budget)``; whole numbers that use all that fits."""
    last = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy("parent").orderBy("_last", "node")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    out = children.withColumn("_last", last)
    out = out.withColumn("_left", F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    out = out.withColumn("_open", F.sum("weight").over(on))
    full = F.expr("weight > 0 and cap * _open <= weight * _left")
    whole = Window.partitionBy("parent")
    out = out.withColumn("_full", full)
    used = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0))
    out = out.withColumn("_rest", F.col("parent_budget") - used)
    out = out.withColumn("_weights", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole))
    out = out.withColumn("_part", F.expr("if(_full, cap, if(_weights > 0, (weight * _rest) div _weights, 0))"))
    extra = F.col("_rest") - F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_part"))).over(whole), F.lit(0))
    # what rounding left goes to the first open children that have a weight, one each
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.expr("if(_full or weight = 0, 1, 0)"), "_last", "node"))
    out = out.withColumn("_extra", extra).withColumn("_rank", rank)
    budget = F.col("_part") + F.expr("if(not _full and weight > 0 and _rank <= _extra, 1, 0)")
    return out.withColumn("budget", budget.cast("long")).select("parent", "node", "cap", "weight", "budget")


def leaf_budgets(
    leaves: DataFrame, budget: int | None, weights: Mapping[str, Mapping[str, int]], levels: Sequence[str], epochs: int, default_weight: int = 1
) -> DataFrame:
    """``(leaf, supply, budget)`` from the supply of each leaf; the budget of the root is all supply where it is null."""
    capped = leaves.withColumn("cap", F.col("supply") * epochs)
    at = capped.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("supply"), F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"))
    wanted = F.col("supply") if budget is None else F.lit(budget)
    parents = at.select(F.lit("[]").alias("parent"), F.least(wanted, F.col("cap")).cast("long").alias("parent_budget"))
    for depth in range(1, len(levels) + 1):
        names = levels[:depth]
        children = capped.groupBy(*names).agg(F.sum("cap").alias("cap"))
        children = children.select(
            node(names[:-1]).alias("parent"), node(names).alias("node"), "cap", weight_of(names[-1], weights.get(names[-1], {}), default_weight).alias("weight")
        )
        given = shares(children.join(parents, "parent"))
        parents = given.select(F.col("node").alias("parent"), F.col("budget").alias("parent_budget"))
    supply = capped.select(node(levels).alias("leaf"), "supply")
    return supply.join(parents.select(F.col("parent").alias("leaf"), F.col("parent_budget").alias("budget")), "leaf")


def mixture(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    budget: int | None = None,
    epochs: int = 2,
    seed: int = 0,
    key: str = "doc_id",
    tokens: str = "tokens",
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """``(key, tokens, copies)`` of the documents taken at least once.

    ``docs`` has the levels of the tree, a key and token counts; further columns
    are not read. Weights are whole numbers up to 1,000 for the names of a level,
    1 for the others; 0 takes nothing. A null name is a node of its own. Null
    token counts are 0. Documents without tokens come along in whole epochs
    only. Equal keys are ordered alike and kept as separate rows where they
    differ in nothing else. An empty table, or no budget, gives no row.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), node([f"`{c}`" for c in levels]).alias("leaf"), *[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(levels)],
        F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long").alias("tokens"),
    )
    rows = settle(rows, "mix-rows")
    leaves = rows.groupBy(*[f"l{i}" for i in range(len(levels))]).agg(F.sum("tokens").alias("supply"))
    names = [f"l{i}" for i in range(len(levels))]
    given = leaf_budgets(leaves, budget, {n: weights.get(c, {}) for n, c in zip(names, levels, strict=True)}, names, epochs)
    given = given.filter("budget > 0").select("leaf", F.expr("budget div supply").alias("whole"), F.expr("budget % supply").alias("rest"))
    given = settle(given, "mix-budgets")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "whole", "key")), 1, 13), 16, 10).cast("long")
    placed = rows.select("key", "leaf", "tokens").join(given, "leaf").withColumn("draw", draw)
    placed = placed.withColumn("bin", F.expr(f"draw div {16**13 // BINS}"))
    bins = placed.filter("rest > 0").groupBy("leaf", "bin").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    upto = F.sum("held").over(Window.partitionBy("leaf").orderBy("bin"))
    ends = bins.withColumn("upto", upto).filter("upto > rest and upto - held <= rest")
    ends = ends.select("leaf", F.col("bin").alias("end_bin"), (F.col("upto") - F.col("held")).alias("before"))
    # by leaf and bin: only the rows of the bins where budgets end meet in a window
    inside = placed.join(ends.withColumnRenamed("end_bin", "bin"), ["leaf", "bin"])
    placed = placed.join(ends.select("leaf", "end_bin"), "leaf", "left")
    run = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("draw", "key"))
    inside = inside.withColumn("run", run + F.col("before"))
    inside = inside.withColumn("more", F.expr("if(tokens > 0 and run <= rest, 1, 0)")).drop("run")
    outside = placed.filter("end_bin is null or bin <> end_bin").withColumn("more", F.expr("if(tokens > 0 and rest > 0 and bin < end_bin, 1, 0)"))
    copies = (F.col("whole") + F.col("more")).cast("int").alias("copies")
    out = inside.select("key", "tokens", "whole", "more").union(outside.select("key", "tokens", "whole", "more"))
    return out.select(F.col("key").alias(key), "tokens", copies).filter("copies > 0")
