"""Training: feature sets, classifiers, scores and exported probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.features import Encoder, assemble, encode_text, prepare_features
from postloom.operators.lexicons import stopwords
from postloom.operators.linguistic import NUMERIC_FEATURES
from postloom.operators.models import Registry, random_baseline, score_table, train_grid
from postloom.operators.tfidf import Vocabulary, fit_vocabulary, term_counts, tfidf_vectors, tfidf_weights
from postloom.session import settle

LABEL = "class_offers"
KEEP = ["train", "test", LABEL]


def domain_features(requests: DataFrame, linguistic: DataFrame) -> DataFrame:
    """Scaled linguistic features as one vector."""
    table, columns = prepare_features(requests, linguistic, nums=NUMERIC_FEATURES)
    return assemble(table, columns).select("post_id", *KEEP, "features")


def ngram_features(requests: DataFrame, tokens: DataFrame, text: str = "combined_tokens", min_df: int = 5) -> tuple[DataFrame, Vocabulary]:
    """TF-IDF vectors over a vocabulary fitted on train rows."""
    docs = requests.select("post_id", "train").join(tokens.select("post_id", text), "post_id")
    counts = settle(term_counts(docs, "post_id", text, stopwords(kept=())), "term-counts")
    train_ids = requests.filter("train").select("post_id")
    vocabulary = fit_vocabulary(
        counts.join(train_ids, "post_id", "left_semi"), train_ids.count(), min_df=min_df, indexed=True
    )
    # a post without any known term keeps its row, with a vector of zeros
    vectors = tfidf_vectors(tfidf_weights(counts, vocabulary, "post_id"), vocabulary, "post_id", requests)
    return requests.select("post_id", *KEEP).join(vectors, "post_id"), vocabulary


def embedding_features(requests: DataFrame, embeddings: DataFrame) -> DataFrame:
    table, columns = prepare_features(requests, embeddings)
    return assemble(table, columns).select("post_id", *KEEP, "features")


def mixed_features(requests: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embeddings with hashtag count, firm rate and day of week."""
    nums, categs = ["num_hashtags", "firm_prop_offers"], ["day_of_week"]
    feats = embeddings.join(requests.select("post_id", *nums, *categs), "post_id", "left")
    table, columns = prepare_features(requests, feats, nums, categs)
    return assemble(table, columns).select("post_id", *KEEP, "features")


def feature_sets(
    basic: DataFrame, masked: DataFrame, linguistic: DataFrame, encoder: Encoder | dict[str, Encoder | DataFrame | None] | None = None
) -> dict[str, DataFrame]:
    """All feature sets of the requests, by name.

    ``encoder`` may name several encoders (a base one, and those tuned on soft and hard pairs), or tables of vectors
    made elsewhere; each gives a set of its vectors alone and a set mixed with other columns.
    """
    requests = basic.filter("referral_request")
    texts = masked.join(requests.select("post_id"), "post_id", "left_semi")
    out = {"domain_full": domain_features(requests, linguistic), "ngram": ngram_features(requests, masked)[0]}
    for name, made in (encoder if isinstance(encoder, dict) else {"base": encoder}).items():
        vectors = made if isinstance(made, DataFrame) else encode_text(texts, "post_id", "combined_mask", made)
        vectors = settle(vectors.select("post_id", "embedding"), "embeddings")
        out[f"bert_sent_{name}"] = embedding_features(requests, vectors)
        out[f"bertmix_sent_{name}"] = mixed_features(requests, vectors)
    return out


def train(registry: Registry, sets: dict[str, DataFrame], classifiers: Sequence[str] = ("logit", "xgb"), **options) -> DataFrame:
    """Fit all models and return their scores on both splits, the random baseline included."""
    names = train_grid(registry, sets, LABEL, classifiers, **options)
    if "domain_full" in sets:
        names += train_grid(registry, {"domain_full": sets["domain_full"]}, LABEL, ["logit_base"], **options)
    scores = score_table(registry, names, "post_id", LABEL)
    rows = registry.features(next(iter(sets)))
    split = F.when(F.col("train"), "train").when(F.col("test"), "test")
    guess = random_baseline(rows, "post_id", LABEL).withColumn("split", split).filter("split is not null")
    baseline = guess.select(
        "post_id", "split", F.col(LABEL).cast("int").alias("y"), F.lit(None).cast("double").alias("p"),
        F.col("prediction").alias("pred"), F.lit("baseline").alias("model"),
    )
    return scores.unionByName(baseline)
