"""Data preparation: posts and comments to labels, masks and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.labels import (
    add_offer_counts,
    class_labels,
    flag_offers,
    flag_requests,
    format_columns,
    mark_train_test,
    nontext_features,
    rename_rare_flags,
)
from postloom.operators.lexicons import company_lexicon, location_lexicon, role_lexicon, stopwords
from postloom.operators.linguistic import FLAG_FEATURES, linguistic_features
from postloom.operators.masking import mask_posts, process_tokens
from postloom.session import settle
from postloom.sources.pages import attach_text, extract_posts


def posts_from_pages(pages: DataFrame, fulltext: DataFrame, base_url: str, scrape_date: str) -> DataFrame:
    """Scraped pages and full texts to the posts table."""
    listed = extract_posts(pages, base_url, scrape_date).drop("page_id", "position")
    posts = attach_text(listed, fulltext)
    last = ["post_preview", "hashtags", "title", "text", "combined"]
    return posts.select(*[c for c in posts.columns if c not in last], *last)


def label_posts(posts: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments with offer flags, and the labelled table of posts.

    The labelled posts are written once between the steps that need statistics
    of the whole table, so that no step repeats the text rules.
    """
    comments = flag_offers(comments.drop("referral_offer"))
    flagged = flag_requests(posts).select(
        "post_id", "user_firm", "date", "hashtags", "num_views", "num_likes", "num_comments",
        "is_referral", "is_request", "referral_request",
    )
    counted = settle(add_offer_counts(flagged, comments), "labelled-posts")
    split = mark_train_test(class_labels(counted))
    return comments, format_columns(nontext_features(split))


def mask_and_tokenise(posts: DataFrame, comments: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Masked text and token text of every post."""
    spark = posts.sparkSession
    masked = mask_posts(posts, role_lexicon(spark), company_lexicon(comments), location_lexicon(spark, gazetteer))
    return process_tokens(masked, "combined_mask", "combined_tokens", stopwords())


def describe_language(masked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Linguistic features with rare flags marked."""
    feats = settle(linguistic_features(masked, dictionary), "linguistic")
    return rename_rare_flags(feats, FLAG_FEATURES)


def prepare(posts: DataFrame, comments: DataFrame, dictionary: DataFrame, out: str, gazetteer: DataFrame | None = None) -> None:
    """The whole preparation, one table per step below ``out``."""
    spark = posts.sparkSession
    comments, basic = label_posts(posts, comments)
    comments.write.mode("overwrite").parquet(f"{out}/comments")
    basic.write.mode("overwrite").parquet(f"{out}/posts_basic")
    mask_and_tokenise(posts, comments, gazetteer).write.mode("overwrite").parquet(f"{out}/posts_mask")
    masked = spark.read.parquet(f"{out}/posts_mask")
    describe_language(masked, dictionary).write.mode("overwrite").parquet(f"{out}/posts_linguistic")


def requests(posts: DataFrame, basic: DataFrame) -> DataFrame:
    """Posts that are requests, with their labels."""
    return posts.join(basic.filter("referral_request"), "post_id").orderBy(F.col("post_id"))
