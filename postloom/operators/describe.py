"""Distributions, weekly series, concentration, tabulations and table checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postloom.functions import fixed_values as fixed
from postloom.functions.columns import cap, remove_prefix_marker
from postloom.functions.dates import week_start
from postloom.operators.joins import lookup_join
from postloom.operators.labels import group_share
from postloom.operators.selection import group_quantiles
from postloom.session import local_table, settle


def capped(df: DataFrame, caps: dict[str, int] = fixed.DISPLAY_CAPS) -> DataFrame:
    """Engagement counts with their display caps, as new columns over the old ones."""
    return df.withColumns({c: cap(F.col(c), bound) for c, bound in caps.items() if c in df.columns})


def value_shares(df: DataFrame, value: str) -> DataFrame:
    """Percent of rows per distinct value; the rows are read once, the total is taken over the counts."""
    counts = settle(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")), "value-counts")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select(value, "n", (F.col("n") * 100.0 / total).alias("percent"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from minimum to maximum, in percent; the maximum is in the last bin."""
    x = F.col(value).cast("double")
    range_ = df.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")).alias("r")).scalar()
    width = (range_["high"] - range_["low"]) / bins
    place = F.when(width > 0, F.least(F.floor((x - range_["low"]) / width) + 1, F.lit(bins))).otherwise(F.lit(1))
    counts = df.filter(x.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin",
        (range_["low"] + width * (F.col("bin") - 1)).alias("left_edge"),
        "n",
        (F.col("n") * 100.0 / range_["n"]).alias("percent"),
    )


def metric_distribution(df: DataFrame, metric: str, caps: dict[str, int] = fixed.DISPLAY_CAPS) -> DataFrame:
    """Plot data of one engagement metric: a histogram for views, value shares otherwise."""
    df = capped(df.select(metric), caps)
    return histogram(df, metric) if metric == "num_views" else value_shares(df, metric)


def weekly_counts(df: DataFrame, date: str = "date", key: str = "post_id", name: str = "requests") -> DataFrame:
    """Rows per week without the first and last week, which may be partial.

    The bounds are taken over the weekly table, not over the rows.
    """
    weeks = df.groupBy(week_start(F.col(date)).alias("week")).agg(F.count(key).alias(name))
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bounded = weeks.filter("week is not null").withColumns(
        {"_first": F.min("week").over(everything), "_last": F.max("week").over(everything)}
    )
    return bounded.filter((F.col("week") > F.col("_first")) & (F.col("week") < F.col("_last"))).select("week", name)


def firm_activity(
    df: DataFrame, firm: str = "user_firm", key: str = "post_id", max_share: float = 0.10, excluded: Sequence[str] = ("New",)
) -> DataFrame:
    """Rows per firm, without firms above ``max_share`` of all rows and without excluded names."""
    counts = df.groupBy(remove_prefix_marker(F.col(firm)).alias("firm")).agg(F.count(key).alias("n"), F.count(F.lit(1)).alias("_rows"))
    counts = settle(counts, "firm-counts")
    total = counts.agg(F.sum("_rows")).first()[0] or 1
    kept = F.col("firm").isNotNull() & (F.col("n") / F.lit(float(total)) <= max_share) & ~F.col("firm").isin(list(excluded))
    return counts.filter(kept).drop("_rows")


def lorenz_curve(activity: DataFrame, digits: int = 3) -> DataFrame:
    """Cumulative share of firms and of activity, from the least active firm on.

    Firms with equal activity are ordered by a digest of their name. Positions
    come from three levels, none of which holds all firms in one task: totals
    per distinct activity (at most the square root of twice the rows), totals
    per digest slice within an activity, and the place within a slice.
    """
    firms = settle(
        activity.withColumn("_h", F.md5("firm")).withColumn("_s", F.substring("_h", 1, digits)), "firm-activity"
    )
    slices = firms.groupBy("n", "_s").agg(F.count(F.lit(1)).alias("_size"))
    levels = slices.groupBy("n").agg(F.sum("_size").alias("_firms"))
    up_to = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    levels = levels.select(
        "n",
        (F.sum("_firms").over(up_to) - F.col("_firms")).alias("_firms_below"),
        (F.sum(F.col("_firms") * F.col("n")).over(up_to) - F.col("_firms") * F.col("n")).alias("_activity_below"),
    )
    in_level = W.partitionBy("n").orderBy("_s").rowsBetween(W.unboundedPreceding, 0)
    slices = slices.withColumn("_before", F.sum("_size").over(in_level) - F.col("_size"))
    offsets = slices.join(levels, "n").select("n", "_s", "_before", "_firms_below", "_activity_below")
    totals = firms.agg(F.struct(F.count(F.lit(1)).alias("firms"), F.sum("n").alias("rows")).alias("t")).scalar()
    place = F.row_number().over(W.partitionBy("n", "_s").orderBy("_h", "firm"))
    placed = lookup_join(firms.withColumn("_place", place), offsets, ["n", "_s"], "inner", ["firm"])
    in_tie = F.col("_before") + F.col("_place")
    return placed.select(
        "firm",
        "n",
        ((F.col("_firms_below") + in_tie) / totals["firms"]).alias("cum_firms"),
        ((F.col("_activity_below") + in_tie * F.col("n")) / totals["rows"]).alias("cum_pct"),
    ).withColumn("equality", F.col("cum_firms"))


def gini_coefficient(activity: DataFrame) -> DataFrame:
    """Gini coefficient and number of firms, from the totals per distinct activity.

    The order inside a tie does not change the sums, so each tie is summed in
    closed form and no per-firm order is needed.
    """
    levels = activity.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    up_to = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    ties = levels.withColumns(
        {
            "below": F.sum(F.col("k") * F.col("n")).over(up_to) - F.col("k") * F.col("n"),
            "steps": F.col("k") * (F.col("k") + 1) / 2,
        }
    )
    sums = ties.agg(
        F.sum("k").alias("firms"),
        F.sum(F.col("k") * F.col("n")).alias("rows"),
        F.sum(F.col("k") * F.col("below") + F.col("n") * F.col("steps")).alias("area"),
    )
    equal = (F.col("firms") + 1) / 2
    return sums.select("firms", ((equal - F.col("area") / F.col("rows")) / equal).alias("gini"))


def five_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of numeric columns."""
    spark = df.sparkSession
    basics = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns
          for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    ).first()
    # all columns in one pass: a column is a group of the unpivoted table
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    found = {r.feature: r.edges for r in group_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75]).collect()}
    rows = []
    for c in columns:
        quartiles = found.get(c) or [None] * 3
        rows.append((c, *[basics[f"{n}_{c}"] for n in ("count", "mean", "std", "min")], *quartiles, basics[f"max_{c}"]))
    return local_table(
        spark, rows, "feature string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )


def flag_shares(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Share of true and false per flag, from one pass over the rows."""
    sums = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c)).alias(c) for c in flags]
    ).unpivot(["_n"], list(flags), "feature", "_true")
    both = F.explode(
        F.array(
            F.struct(F.lit(True).alias("value"), F.col("_true").alias("n")),
            F.struct(F.lit(False).alias("value"), (F.col("_n") - F.col("_true")).alias("n")),
        )
    )
    return sums.select("feature", "_n", both.alias("v")).filter("v.n > 0").select(
        "feature", "v.value", "v.n", (F.col("v.n") / F.col("_n")).alias("share")
    )


# --- checks -----------------------------------------------------------------


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, all rules in one pass; a null verdict counts as broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    return counts.unpivot([], list(checks), "check", "n_bad")


def post_checks(text_columns: Sequence[str], other_columns: Sequence[str]) -> dict[str, Column]:
    """Checks of the posts table: nothing missing, no empty strings, dates not after the scrape."""
    checks = {f"{c}_present": F.col(c).isNotNull() for c in (*text_columns, *other_columns)}
    checks |= {f"{c}_not_empty": F.col(c) != "" for c in text_columns if c not in ("text", "hashtags")}
    return checks | {"date_before_scrape": F.col("date") <= F.col("scrape_date")}


def label_checks() -> dict[str, Column]:
    """Checks of the labelled table: ranges, classes that agree with counts, a split of the requests."""
    checks = {f"num_{m}_range": F.col(f"num_{m}") >= 0 for m in ("views", "likes", "comments", "offers")}
    checks["class_views_range"] = F.col("class_views").isin(0, 1, 2, 3, 4)
    for m in ("likes", "comments", "offers"):
        checks[f"class_{m}_agrees"] = (F.col(f"num_{m}") > 0) == (F.col(f"class_{m}") == 1)
    checks["request_is_both"] = F.col("referral_request") == (F.col("is_referral") & F.col("is_request"))
    checks["one_split"] = ~(F.col("train") & F.col("test"))
    checks["requests_are_split"] = (F.col("train") | F.col("test")) == F.col("referral_request")
    return checks


def split_sizes(df: DataFrame) -> DataFrame:
    """Train, test and request counts, and whether train is the larger set."""
    sums = df.agg(
        F.count_if("train").alias("n_train"), F.count_if("test").alias("n_test"),
        F.count_if("referral_request").alias("n_requests"),
    )
    return sums.withColumn("train_is_larger", F.col("n_train") > F.col("n_test"))


def repeated_share(df: DataFrame, group: str, key: str, bound: float) -> DataFrame:
    """Rows of groups that hold at most ``bound`` of all rows."""
    return group_share(df, group, key).filter(F.col("pct_activity") <= bound)


def most_common(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value and its count; ties go to the smallest value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(1)
