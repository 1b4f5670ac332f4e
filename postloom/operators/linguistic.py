"""Linguistic features of posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions import fixed_values as fixed
from postloom.functions.columns import UNICODE, text_or_empty, words
from postloom.functions.rules import literature_flags, platform_flags
from postloom.functions.text import kincaid_grade, type_token_ratio, word_count
from postloom.operators.joins import lookup_join

NUMERIC_FEATURES = ["type_token_ratio", "post_length", "kincaid_grade", "spell_errors"]
FLAG_FEATURES = [name for name, _ in fixed.PLATFORM_CUES] + [name for name, _ in fixed.LITERATURE_CUES]


def distinct_words(docs: DataFrame, key: str, text: str, jargon: Sequence[str] = fixed.JARGON) -> DataFrame:
    """One row per text and distinct lower-case word, without punctuation and jargon.

    Duplicates go inside the row, before anything is exploded or shuffled.
    """
    plain = F.regexp_replace(F.lower(text_or_empty(F.col(text))), UNICODE + r"[^\w\s]", " ")
    plain = F.regexp_replace(plain, UNICODE + rf"\b({'|'.join(jargon)})\b", "") if jargon else plain
    return docs.select(key, F.explode(F.array_distinct(words(plain))).alias("word"))


def unknown_words(
    docs: DataFrame, dictionary: DataFrame, key: str, text: str, word: str = "word", jargon: Sequence[str] = fixed.JARGON
) -> DataFrame:
    """Number of distinct words of each text that a dictionary does not hold; texts without any are absent."""
    known = dictionary.select(F.lower(F.col(word)).alias("word")).filter("word is not null").distinct()
    missing = lookup_join(distinct_words(docs, key, text, jargon), known, "word", "left_anti", [key])
    return missing.groupBy(key).agg(F.count(F.lit(1)).alias("spell_errors"))


def semantic_features(
    docs: DataFrame, dictionary: DataFrame, key: str = "post_id", text: str = "combined_mask"
) -> DataFrame:
    """Type-token ratio, length in words, grade level and unknown words."""
    measured = docs.withColumns(
        {
            "type_token_ratio": type_token_ratio(F.col(text)),
            "post_length": word_count(F.col(text)),
            "kincaid_grade": kincaid_grade(F.col(text)),
        }
    )
    missing = unknown_words(docs, dictionary, key, text)
    return measured.join(missing, key, "left").withColumn(
        "spell_errors", F.coalesce("spell_errors", F.lit(0)).cast("long")
    )


def linguistic_features(
    docs: DataFrame, dictionary: DataFrame, key: str = "post_id", text: str = "combined_mask", compat: bool = False
) -> DataFrame:
    """The four measures and all cue flags, keyed by post."""
    flags = [*platform_flags(F.col(text), compat), *literature_flags(F.col(text))]
    measured = semantic_features(docs.select(key, text), dictionary, key, text)
    return measured.select(key, *NUMERIC_FEATURES, *flags)
