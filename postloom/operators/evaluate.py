"""Metrics, calibration and bootstrap intervals on a long score table.

A score table has one row per (model, split, key) with the label ``y``, the
prediction ``pred`` and the probability ``p``; one job covers all models.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postloom.functions.columns import floor_to
from postloom.operators.joins import lookup_join
from postloom.operators.selection import group_key, group_quantiles

CONFUSION = ["tp", "fp", "fn", "tn"]


def confusion_counts(scores: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    yes, said = F.col(y) == 1, F.col(pred) == 1
    return scores.groupBy(*by).agg(
        F.count_if(yes & said).alias("tp"),
        F.count_if(~yes & said).alias("fp"),
        F.count_if(yes & ~said).alias("fn"),
        F.count_if(~yes & ~said).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    """Quotient that is 0 when there is nothing to divide by."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision and recall of the positive class, and F1 weighted by class size."""
    n = tp + fp + fn + tn
    f1_yes = _ratio(2 * tp, 2 * tp + fp + fn)
    f1_no = _ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "accuracy": _ratio(tp + tn, n),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_weighted": _ratio(f1_yes * (tp + fn) + f1_no * (tn + fp), n),
    }


def auroc(scores: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Exact AUROC per group, ties counted half; null with one class only.

    Rows are first reduced to distinct scores. These are range-partitioned, so
    that every partition is one stretch of the order; ranks are taken inside
    the stretches and the stretches of a group, a few per group, are chained.
    """
    values = scores.groupBy(*by, p).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")
    )
    stretch = values.repartitionByRange(*[F.col(c) for c in by], F.col(p)).withColumn("_part", F.spark_partition_id())
    inside = W.partitionBy(*by, "_part").orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    below = F.sum("neg").over(inside) - F.col("neg")
    parts = (
        stretch.withColumn("_below", below)
        .groupBy(*by, "_part")
        .agg(
            F.min(p).alias("_from"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("won"),
        )
    )
    chain = W.partitionBy(*by).orderBy("_from").rowsBetween(W.unboundedPreceding, 0)
    before = F.sum("neg").over(chain) - F.col("neg")
    total = F.sum(F.col("won") + F.col("pos") * F.col("_before"))
    return (
        parts.withColumn("_before", before)
        .groupBy(*by)
        .agg(total.alias("_won"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
        .select(
            *by, F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), F.col("_won") / (F.col("_pos") * F.col("_neg"))).alias("roc_auc")
        )
    )


def performance(scores: DataFrame, by: Sequence[str] = ("model", "split"), digits: int = 3) -> DataFrame:
    """All metrics per group, rounded half to even; groups without probabilities have no AUROC."""
    counts = confusion_counts(scores, by)
    parts = confusion_metrics(*[F.col(c) for c in CONFUSION])
    table = counts.select(*by, *[F.bround(v, digits).alias(k) for k, v in parts.items()])
    area = auroc(scores.filter(F.col("p").isNotNull()), by)
    return table.join(area.withColumn("roc_auc", F.bround("roc_auc", digits)), list(by), "left")


def class_report(scores: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    yes, said = F.col("y") == F.col("class"), F.col("pred") == F.col("class")
    both = scores.withColumn("class", F.explode(F.array(F.lit(0), F.lit(1))))
    counts = both.groupBy(*by, "class").agg(
        F.count_if(yes & said).alias("hit"), F.count_if(said).alias("said"), F.count_if(yes).alias("support")
    )
    per_class = counts.select(
        *by,
        F.col("class").cast("string").alias("row"),
        _ratio(F.col("hit"), F.col("said")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )
    measures = ["precision", "recall", "f1"]
    macro = per_class.groupBy(*by).agg(
        F.lit("macro avg").alias("row"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")
    )
    weighted = per_class.groupBy(*by).agg(
        F.lit("weighted avg").alias("row"),
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("total"),
    )
    return per_class.unionByName(macro).unionByName(weighted.withColumnRenamed("total", "support"))


def calibration(scores: DataFrame, by: Sequence[str] = ("model", "split"), bins: int = 20) -> DataFrame:
    """Mean probability and mean label per equal-frequency bin of the probability.

    Rows whose probability is NaN or null are in no bin; a group of them alone has no row.
    """
    scores = scores.filter(F.col("p").isNotNull() & ~F.isnan("p"))
    edges = group_quantiles(scores, by, "p", [i / bins for i in range(bins + 1)])
    kept = F.array_sort(F.array_distinct("edges"))
    # equal edges are one; the outer two are no edges of classes
    inner = edges.select(group_key(by).alias("_g"), F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 2, F.lit(0))).alias("inner"))
    index = F.size(F.filter("inner", lambda e: e < F.col("p").cast("double")))
    return (
        lookup_join(scores.withColumn("_g", group_key(by)), inner, "_g", "inner")
        .withColumn("bin", index)
        .groupBy(*by, "bin")
        .agg(F.avg("p").alias("model_prob"), F.avg("y").alias("true_label"), F.count(F.lit(1)).alias("n"))
    )


def calibration_range(curve: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """Axis range of a calibration plot, on a grid of 0.05."""
    return curve.groupBy(*by).agg(
        F.round(floor_to(F.min_by("model_prob", "bin"), 0.05), 2).alias("low"),
        F.round(floor_to(F.max_by("model_prob", "bin"), 0.05) + 0.05, 2).alias("high"),
    )


# Probabilities closer to 0 or 1 than the spacing of doubles count as that far from them.
LEAST_PROBABILITY = 2.0**-52


def monitoring(scores: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """Cross entropy with balanced class weights, and true and predicted positive rates.

    Every row with a probability counts: one that gives its own class 0 has the
    loss of ``LEAST_PROBABILITY``. NaN and null probabilities have no loss.
    """
    own = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    own = F.when(F.col("p").isNotNull() & ~F.isnan("p"), F.least(F.greatest(own, F.lit(LEAST_PROBABILITY)), F.lit(1.0)))
    loss = -F.log(own)
    return scores.groupBy(*by).agg(
        (
            F.coalesce(F.avg(F.when(F.col("y") == 1, loss)), F.lit(0.0)) / 2
            + F.coalesce(F.avg(F.when(F.col("y") == 0, loss)), F.lit(0.0)) / 2
        ).alias("entropy"),
        F.avg(F.col("y").cast("double")).alias("true_pos_rate"),
        F.avg(F.col("pred").cast("double")).alias("pred_pos_rate"),
    )


# --- bootstrap --------------------------------------------------------------

# Cumulative probabilities of a Poisson count with mean 1, and
# the constants of the 64-bit mixing function.
POISSON_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
MIX_STEP = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB


def row_seed(key: Column) -> Column:
    """A 60-bit number that depends only on the key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


def poisson_weights(seeds, replicates: int):
    """Weights (rows x replicates): how often each row is drawn in each replicate."""
    import numpy as np

    steps = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(MIX_STEP))[None, :]
    x = seeds.astype(np.uint64)[:, None] + steps
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    x = x ^ (x >> np.uint64(31))
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(np.array(POISSON_CDF), u, side="right")


def bootstrap_replicates(
    scores: DataFrame, key: str, by: Sequence[str] = ("model", "split"), replicates: int = 1000
) -> DataFrame:
    """Metrics of every replicate, rounded to 3 digits.

    A replicate draws each row a Poisson(1) number of times, from a hash of the
    row's key, so replicates are the same for all models and do not depend on
    the partitioning. Rows are never multiplied by the number of replicates:
    each task of a range partition turns its rows into one vector of weights at
    a time and hands on only sums. A score shared by many rows is spread over
    several partitions, so its sums are merged before ranks are chained.
    """
    by = list(by)
    kinds = dict(scores.dtypes)
    rows = scores.select(
        *by, F.col("p").cast("double").alias("p"), F.col("y").cast("int").alias("y"),
        F.col("pred").cast("int").alias("pred"), row_seed(F.col(key)).alias("seed"),
    )
    ranged = rows.repartitionByRange(*[F.col(c) for c in by], F.col("p"), F.col("seed"))
    ordered = ranged.sortWithinPartitions(*by, "p", "seed")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + (
        ", start double, tie boolean, pos array<long>, neg array<long>, won array<double>,"
        " tp array<long>, fp array<long>, fn array<long>, tn array<long>"
    )
    partial = ordered.mapInPandas(_partial_sums(by, replicates), schema)
    sums = partial.select(
        *by, "start", "tie",
        F.posexplode(F.arrays_zip("pos", "neg", "won", *CONFUSION)).alias("rep", "s"),
    ).select(*by, "start", "tie", "rep", "s.*")
    merged = sums.groupBy(*by, "rep", "start", "tie").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "won", *CONFUSION)]
    )
    won = F.when(F.col("tie"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("won"))
    chain = W.partitionBy(*by, "rep").orderBy("start", F.desc("tie")).rowsBetween(W.unboundedPreceding, 0)
    before = F.sum("neg").over(chain) - F.col("neg")
    totals = merged.withColumn("_w", won + F.col("pos") * before).groupBy(*by, "rep").agg(
        F.sum("_w").alias("_w"), *[F.sum(c).alias(c) for c in ("pos", "neg", *CONFUSION)]
    )
    metrics = confusion_metrics(*[F.col(c) for c in CONFUSION])
    metrics["roc_auc"] = F.when(
        (F.col("pos") > 0) & (F.col("neg") > 0), F.col("_w") / (F.col("pos") * F.col("neg"))
    )
    return totals.select(*by, "rep", *[F.bround(v, 3).alias(k) for k, v in metrics.items()])


def _partial_sums(by: list[str], replicates: int):
    """Sums over one sorted partition: per group its first and last score apart, the rest together."""

    def run(batches: Iterator):
        import numpy as np
        import pandas as pd

        zero = lambda: np.zeros(replicates, dtype=np.int64)
        out: list[dict] = []
        group, state = None, None

        def segment(start, tie, pos, neg, won, cells):
            return dict(
                zip(by, group), start=start, tie=tie, pos=pos, neg=neg, won=won,
                **dict(zip(CONFUSION, cells)),
            )

        def close():
            """Hand on the open group."""
            none = [zero() for _ in CONFUSION]
            if state["first"] is not None:
                out.append(segment(*state["first"][:1], True, *state["first"][1:], zero() * 0.0, none))
            if state["mid_start"] is not None:
                out.append(segment(state["mid_start"], False, state["pos"], state["neg"], state["won"], none))
            last = state["open"]
            out.append(segment(last[0], True, last[1], last[2], zero() * 0.0, state["cells"]))

        def shift():
            """The open score is complete: it becomes the first score or joins the middle."""
            if state["open"] is None:
                return
            if state["first"] is None:
                state["first"] = state["open"]
            else:
                start, pos, neg = state["open"]
                if state["mid_start"] is None:
                    state["mid_start"] = start
                state["won"] += pos * (state["neg"] + neg / 2.0)
                state["pos"] = state["pos"] + pos
                state["neg"] = state["neg"] + neg
            state["open"] = None

        for batch in batches:
            for lo in range(0, len(batch), 2000):
                chunk = batch.iloc[lo : lo + 2000]
                for name, rows in chunk.groupby(by, sort=False, dropna=False):
                    if group is None or name != group:
                        if group is not None:
                            close()
                        group = name
                        state = dict(first=None, mid_start=None, pos=zero(), neg=zero(), won=zero() * 0.0,
                                     open=None, cells=[zero() for _ in CONFUSION])
                    w = poisson_weights(rows["seed"].to_numpy(), replicates)
                    y, said, p = rows["y"].to_numpy() == 1, rows["pred"].to_numpy() == 1, rows["p"].to_numpy()
                    for i, mask in enumerate((y & said, ~y & said, y & ~said, ~y & ~said)):
                        state["cells"][i] += w[mask].sum(axis=0)
                    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                    pos = np.add.reduceat(w * y[:, None], starts, axis=0)
                    neg = np.add.reduceat(w * ~y[:, None], starts, axis=0)
                    if state["open"] is not None and state["open"][0] == p[0]:
                        state["open"] = (p[0], state["open"][1] + pos[0], state["open"][2] + neg[0])
                    else:
                        shift()
                        state["open"] = (p[0], pos[0], neg[0])
                    if len(starts) == 1:
                        continue
                    shift()
                    if len(starts) > 2:
                        between_pos, between_neg = pos[1:-1], neg[1:-1]
                        below = state["neg"] + np.cumsum(between_neg, axis=0) - between_neg
                        if state["mid_start"] is None:
                            state["mid_start"] = p[starts[1]]
                        state["won"] += (between_pos * (below + between_neg / 2.0)).sum(axis=0)
                        state["pos"] = state["pos"] + between_pos.sum(axis=0)
                        state["neg"] = state["neg"] + between_neg.sum(axis=0)
                    state["open"] = (p[starts[-1]], pos[-1], neg[-1])
            if len(out) > 50:
                yield pd.DataFrame(out)
                out = []
        if group is not None:
            close()
        if out:
            yield pd.DataFrame(out)

    return run


def confidence_intervals(
    scores: DataFrame, key: str, by: Sequence[str] = ("model", "split"), replicates: int = 1000
) -> DataFrame:
    """2.5th and 97.5th percentiles of every metric over the replicates."""
    measures = ["accuracy", "precision", "recall", "f1_weighted", "roc_auc"]
    long = bootstrap_replicates(scores, key, by, replicates).unpivot(
        [*by, "rep"], measures, "metric", "value"
    )
    # one value per replicate: the exact percentile holds at most that many
    pair = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy(*by, "metric").agg(pair.alias("q")).select(
        *by, "metric", F.bround(F.col("q")[0], 3).alias("low"), F.bround(F.col("q")[1], 3).alias("high")
    )


def evaluate_all(
    scores: DataFrame, key: str, by: Sequence[str] = ("model", "split"), replicates: int | None = 1000
) -> DataFrame:
    """Metrics of all models and splits with their intervals, one row per metric.

    A model without probabilities has intervals too; its AUROC is null.
    """
    measures = ["accuracy", "precision", "recall", "f1_weighted", "roc_auc"]
    table = performance(scores, by).unpivot(list(by), measures, "metric", "value")
    if not replicates:
        return table
    # rows without a probability share one score, so they cannot change another group's ranks
    guessed = F.max(F.col("p").isNull().cast("int")).alias("_none")
    bounds = confidence_intervals(scores.withColumn("p", F.coalesce("p", F.lit(0.5))), key, by, replicates)
    groups = scores.groupBy(*by).agg(guessed)
    bounds = bounds.join(groups, list(by)).filter("_none = 0 or metric <> 'roc_auc'").drop("_none")
    return table.join(bounds, [*by, "metric"], "left")
