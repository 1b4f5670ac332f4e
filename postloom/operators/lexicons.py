"""Lexicons as DataFrames: ``phrase``, ``tag`` and ``priority`` (lower wins)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import fixed_values as fixed
from postloom.functions.columns import remove_prefix_marker, without_accents, words
from postloom.session import local_table


def long_first(phrase: Column) -> Column:
    """Priority by number of words, then by length, both descending."""
    return -(F.size(words(phrase)).cast("long") * F.lit(100_000) + F.length(phrase))


def trimmed(phrase: Column) -> Column:
    """A phrase without white space around it."""
    return F.regexp_replace(phrase, r"^\s+|\s+$", "")


def lexicon_of(df: DataFrame, phrase: str, tag: str) -> DataFrame:
    """A lexicon from a table of phrases; long phrases win."""
    kept = df.select(trimmed(F.lower(F.col(phrase))).alias("phrase")).filter("phrase is not null and phrase <> ''")
    return kept.distinct().select("phrase", F.lit(tag).alias("tag"), long_first(F.col("phrase")).alias("priority"))


def phrase_table(spark: SparkSession, phrases: Iterable[str]) -> DataFrame:
    return local_table(spark, [(p,) for p in phrases], "phrase string")


def ordered_lexicon(spark: SparkSession, phrases: Iterable[str], tag: str) -> DataFrame:
    """A lexicon from a list: more words win, then the earlier entry."""
    ordered = sorted(dict.fromkeys(q for p in phrases if (q := p.lower().strip())), key=lambda p: -len(p.split()))
    rows = [(p, tag, i) for i, p in enumerate(ordered)]
    return local_table(spark, rows, "phrase string, tag string, priority long")


def company_lexicon(
    comments: DataFrame,
    firm: str = "user_firm",
    extra: Iterable[str] = fixed.EXTRA_FIRMS,
    exclude: Iterable[str] = fixed.FIRM_EXCEPTIONS,
    tag: str = "[ORG]",
) -> DataFrame:
    """Firm names found in the data, their spellings without spaces, and curated names.

    Names are reduced to distinct values before the variants are made.
    """
    spark = comments.sparkSession
    names = (
        comments.filter(F.col(firm).isNotNull())
        .select(F.lower(remove_prefix_marker(F.col(firm))).alias("name"))
        .distinct()
    )
    variants = names.select(F.explode(F.array("name", F.replace("name", F.lit(" "), F.lit("")))).alias("phrase"))
    curated = phrase_table(spark, (p.lower() for p in extra))
    excluded = phrase_table(spark, exclude)
    kept = variants.unionByName(curated).distinct().join(F.broadcast(excluded), "phrase", "left_anti")
    return lexicon_of(kept, "phrase", tag)


def location_lexicon(
    spark: SparkSession,
    gazetteer: DataFrame | None = None,
    name: str = "name",
    extra: Iterable[str] = (*fixed.EXTRA_PLACES, *fixed.STATE_CODES, *fixed.PLACE_CODES),
    tag: str = "[GPE]",
) -> DataFrame:
    """Place names without accents, with hyphenated and joined spellings."""
    places = phrase_table(spark, extra)
    if gazetteer is not None:
        places = places.unionByName(gazetteer.select(F.col(name).alias("phrase")))
    plain = places.select(F.lower(without_accents(F.col("phrase"))).alias("p")).distinct()
    variants = plain.select(
        F.explode(
            F.array("p", F.replace("p", F.lit(" "), F.lit("-")), F.replace("p", F.lit(" "), F.lit("")))
        ).alias("phrase")
    )
    return lexicon_of(variants, "phrase", tag)


def without_phrases(lexicon: DataFrame, *exceptions: DataFrame | Iterable[str]) -> DataFrame:
    """Lexicon minus exception phrases, given as tables or lists."""
    for e in exceptions:
        table = e if isinstance(e, DataFrame) else phrase_table(lexicon.sparkSession, (p.lower() for p in e))
        lexicon = lexicon.join(table.select("phrase").distinct(), "phrase", "left_anti")
    return lexicon


def union_lexicons(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct union; a phrase kept by several lexicons has its best priority."""
    for o in others:
        first = first.unionByName(o)
    return first.groupBy("phrase", "tag").agg(F.min("priority").alias("priority"))


def role_phrases() -> list[str]:
    """Job titles: stems joined with endings, as bare, comma-ended and bracketed spellings."""

    def ended(stems: list[str], endings: list[str]) -> list[str]:
        return [f"{s} {e}" for e in endings for s in stems if e not in s]

    managers = fixed.MANAGER_CODES + [
        f"{s} {e}" for e in fixed.MANAGER_ENDINGS for s in fixed.MANAGER_STEMS + fixed.MANAGER_CODES
    ]
    managers = managers + [f"{lead} {m}" for lead in fixed.MANAGER_LEADS for m in managers]
    stems = fixed.ENGINEER_STEMS
    engineers = [s for s in stems if s not in fixed.ENGINEER_NOT_ALONE] + ended(stems, fixed.ENGINEER_ENDINGS)
    for shape in ("{}/", "/{}", "{}-", "({})"):
        engineers += [shape.format(s) for s in stems]
    engineers += [f"{code}{grade}" for code in fixed.GRADED_CODES for grade in range(1, 11)]
    scientists = ended(fixed.SCIENCE_STEMS, fixed.SCIENCE_ENDINGS)
    analysts = fixed.ANALYST_STEMS + [f"{s} {e}" for e in fixed.ANALYST_ENDINGS for s in fixed.ANALYST_STEMS]
    roles = managers + engineers + scientists + analysts + fixed.OTHER_ROLES
    return [r for r in roles if r != "python"] + [f"{r}," for r in roles]


def role_lexicon(spark: SparkSession, tag: str = "[ROLE]") -> DataFrame:
    return ordered_lexicon(spark, role_phrases(), tag)


def stopwords(language: str = "english", kept: Iterable[str] = fixed.KEPT_STOPWORDS, extra: Iterable[str] = ()) -> list[str]:
    """Spark's stop-word list without the words that carry meaning here."""
    base = set(StopWordsRemover.loadDefaultStopWords(language)) | set(extra)
    return sorted(base - set(kept))
