"""Labels of posts and comments, the time split and firm encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import fixed_values as fixed
from postloom.functions.columns import remove_prefix_marker, text_or_empty
from postloom.functions.dates import day_name, micros
from postloom.functions.rules import offer_flag, offer_label, referral_flag, request_flag
from postloom.functions.text import hashtag_count
from postloom.operators.joins import lookup_join
from postloom.operators.quantiles import exact_quantiles, quantile_class
from postloom.operators.selection import PICK_ROWS, fold_shares, stratified_cuts, with_cuts
from postloom.session import settle


def flag_offers(comments: DataFrame, text: str = "text", **rules) -> DataFrame:
    """Comments with ``referral_offer``: one boolean column, no join and no shuffle."""
    return comments.withColumn("referral_offer", offer_flag(F.col(text), **rules))


def label_offers(comments: DataFrame, text: str = "text", **rules) -> DataFrame:
    """Comments with the name of the winning offer rule in ``patterns``."""
    return comments.withColumn("patterns", offer_label(F.col(text), **rules))


def rule_counts(labelled: DataFrame, label: str = "patterns") -> DataFrame:
    """How often each rule decided a candidate."""
    return labelled.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def flag_requests(posts: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Posts with ``is_referral``, ``is_request`` and their conjunction."""
    both = F.concat_ws(" ", text_or_empty(F.col(title)), text_or_empty(F.col(text)))
    return (
        posts.withColumn("_both", both)
        .withColumn("is_referral", referral_flag(F.col("_both")))
        .withColumn("is_request", request_flag(F.col("_both")))
        .withColumn("referral_request", F.col("is_referral") & F.col("is_request"))
        .drop("_both")
    )


def offers_per_post(comments: DataFrame, post: str = "post_id", flag: str = "referral_offer") -> DataFrame:
    """Number of flagged comments per post, combined before the shuffle."""
    return comments.groupBy(post).agg(F.sum(F.col(flag).cast("long")).alias("num_offers"))


def add_offer_counts(posts: DataFrame, comments: DataFrame, post: str = "post_id") -> DataFrame:
    """Posts with ``num_offers``, 0 where a post has no comment."""
    counts = offers_per_post(comments, post)
    return posts.join(counts, post, "left").withColumn("num_offers", F.coalesce("num_offers", F.lit(0)).cast("long"))


def class_labels(
    posts: DataFrame, views: str = "num_views", counts: Sequence[str] = ("num_likes", "num_comments", "num_offers"),
    source: DataFrame | None = None,
) -> DataFrame:
    """Five quantile classes of the views over all posts, and zero / positive for the other counts.

    ``source`` holds the views of the same posts where ``posts`` is costly to read.
    """
    posts = quantile_class(posts, views, 5, "class_views", source=source)
    for c in counts:
        posts = posts.withColumn(c.replace("num_", "class_"), (F.col(c) > 0).cast("int"))
    return posts


def mark_train_test(
    posts: DataFrame, date: str = "date", request: str = "referral_request", share: float = 0.80
) -> DataFrame:
    """Split requests at a quantile of their dates; other posts are in neither set."""
    when = micros(F.col(date))
    cut = exact_quantiles(posts.filter(F.col(request)), when, [share])
    point = F.lit(cut[0] if cut else None).cast("double")
    early = F.coalesce(when.cast("double") <= point, F.lit(False))
    late = F.coalesce(when.cast("double") > point, F.lit(False))
    return posts.withColumn("train", early & F.col(request)).withColumn("test", late & F.col(request))


def firm_rates(
    train: DataFrame,
    labels: Sequence[str] = ("class_likes", "class_comments", "class_offers"),
    firm: str = "user_firm",
    min_rows: int = fixed.SMALL_FIRM_ROWS,
) -> DataFrame:
    """Mean label per firm on train rows, with rare firms pooled.

    Rarity is counted on the name as written, the mean on the name without the
    former-employer marker. One aggregation reduces rows to firms before the
    shuffle; no window ever holds the rows of one firm.
    """
    recoded = F.coalesce(remove_prefix_marker(F.col(firm)), F.lit("nan"))
    names = train.groupBy(F.col(firm).alias("_raw"), recoded.alias("_recoded")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in labels]
    )
    rare = F.col("_raw").isNotNull() & (F.col("_n") < min_rows)
    return (
        names.withColumn("user_firm_recoded", F.when(rare, F.lit(fixed.SMALL_FIRM)).otherwise(F.col("_recoded")))
        .groupBy("user_firm_recoded")
        .agg(
            F.sum("_n").alias("firm_rows"),
            *[(F.sum(c) / F.sum("_n")).alias(c.replace("class_", "firm_prop_")) for c in labels],
        )
    )


def target_encoding(
    posts: DataFrame,
    labels: Sequence[str] = ("class_likes", "class_comments", "class_offers"),
    firm: str = "user_firm",
    train: str = "train",
    key: str = "post_id",
    min_rows: int = fixed.SMALL_FIRM_ROWS,
) -> DataFrame:
    """Posts with the train-only rate of each label for their firm.

    Firms without a rate get the pooled rate of rare firms, or the overall train
    rate when no firm is rare.
    """
    rates = settle(firm_rates(posts.filter(F.col(train)), labels, firm, min_rows), "firm-rates")
    names = [c.replace("class_", "firm_prop_") for c in labels]
    pooled = F.col("user_firm_recoded") == fixed.SMALL_FIRM
    fallback = rates.agg(
        *[
            F.coalesce(
                F.max(F.when(pooled, F.col(c))), F.sum(F.col(c) * F.col("firm_rows")) / F.sum("firm_rows")
            ).alias(c)
            for c in names
        ]
    ).first()
    posts = posts.withColumn("user_firm_recoded", F.coalesce(remove_prefix_marker(F.col(firm)), F.lit("nan")))
    posts = lookup_join(posts, rates.drop("firm_rows"), "user_firm_recoded", "left", [key], materialise=False)
    return posts.withColumns({c: F.coalesce(F.col(c), F.lit(fallback[c]).cast("double")) for c in names})


def nontext_features(posts: DataFrame, date: str = "date", hashtags: str = "hashtags", **encoding) -> DataFrame:
    """Day of week, hashtag count and firm rates."""
    posts = posts.withColumn("day_of_week", day_name(F.col(date))).withColumn(
        "num_hashtags", hashtag_count(F.col(hashtags))
    )
    return target_encoding(posts, **encoding)


BASIC_COLUMNS = [
    "post_id", "num_offers", "class_offers", "class_comments", "class_likes", "class_views",
    "is_referral", "is_request", "referral_request", "train", "test",
    "day_of_week", "num_hashtags", "firm_prop_likes", "firm_prop_comments", "firm_prop_offers",
]


def format_columns(posts: DataFrame, columns: Sequence[str] = BASIC_COLUMNS, key: str = "post_id") -> DataFrame:
    """Final column order, requests first; the key makes the order reproducible."""
    return posts.select(*columns).orderBy(F.desc("is_referral"), F.desc("is_request"), key)


def rename_rare_flags(df: DataFrame, flags: Sequence[str], threshold: float = 0.05, marker: str = "below5_") -> DataFrame:
    """Mark flags that are true in less than ``threshold`` of the rows and move them last."""
    rates = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in flags]).first()
    rare = [c for c in flags if rates[c] is not None and rates[c] < threshold]
    kept = [F.col(c) for c in df.columns if c not in rare]
    return df.select(*kept, *[F.col(c).alias(marker + c) for c in rare])


def group_share(df: DataFrame, group: str, key: str, name: str = "pct_activity") -> DataFrame:
    """Rows with their group's share of all rows.

    The group sizes are aggregated first and looked up, so a dominant group
    never lands in one window partition.
    """
    sizes = settle(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    shares = sizes.select(group, (F.col("_n") / F.lit(float(total or 1))).alias(name))
    return lookup_join(df, shares, group, "left", [key], materialise=False)


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible random order of keys, as a uniform hex digest."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def stratified_split(
    df: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 95, slice_rows: int = PICK_ROWS
) -> DataFrame:
    """Exact ``share`` of every label class in a reproducible random order, as boolean ``fit``.

    Digests are uniform. The cut of every class is found for all classes at once,
    and a row is decided by comparing its digest with the cut of its class. The
    table itself is not ordered. Null is a class of its own.
    """
    order = hash_order(F.col(key), seed)
    cuts = stratified_cuts(df, order, label, [share], slice_rows)
    return with_cuts(df, cuts, label, key, "fit", lambda c: order <= F.get(c, F.lit(0)))


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42, name: str = "fold", slice_rows: int = PICK_ROWS
) -> DataFrame:
    """Fold of each row, 0 to ``folds - 1``: every class is dealt evenly, its folds differ by one row at most."""
    order = hash_order(F.col(key), seed)
    cuts = stratified_cuts(df, order, label, fold_shares(folds), slice_rows)
    return with_cuts(df, cuts, label, key, name, lambda c: F.size(F.filter(c, lambda x: x < order)))
