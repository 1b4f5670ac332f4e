"""A corpus pipeline: quality rules, near duplicates, repeated passages, mixing, and token ids.

Each stage takes the documents its predecessor has kept, written as Parquet and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import bpe, jaccard, mixing, quality, substrings
from postloom.llm.catalog import EPOCHS, MIX, SEED, with_domain
from postloom.session import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def passing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    kept = quality.quality_rules(docs, keep=COLUMNS[1:])
    return kept.filter("kept").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id, unchanged."""
    found = jaccard.jaccard_components(docs)
    return docs.select(*COLUMNS).join(found.filter("doc_id <> component").select("doc_id"), "doc_id", "left_anti")


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of repeated passages; a text that loses none stays as it is, one that loses all goes."""
    out = substrings.without_repeats(docs, keep=COLUMNS[1:]).filter("n_removed = 0 or kept_text <> ''")
    cut = F.col("n_removed") > 0
    n_chars = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, dealt out by the target weights; a document taken twice stands there twice."""
    taken = mixing.mixture(with_domain(docs), MIX, epochs=EPOCHS, seed=SEED).select("doc_id", "copies")
    out = docs.select(*COLUMNS).join(taken, "doc_id")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of every document."""
    out = bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["source"])
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", passing),
    ("n-gram Jaccard join", distinct),
    ("substring dedup", unrepeated),
    ("mixing to target weights", mixed),
    ("BPE encoding", token_ids),
]

# Byte-pair encoding and the divergence rules have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
