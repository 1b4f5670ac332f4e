"""Registration of queries, and the test tables seen as posts and comments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.columns import hash_unit
from postloom.session import spread
from postloom.sources.tables import read_table


class Book(dict):
    """Name to (query, SQL)."""

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def keep(fn: Callable) -> Callable:
            self[name or fn.__name__] = (fn, sql)
            return fn

        return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def ascii_text(c: Column) -> Column:
    """Letters outside ASCII become ``q``, so that word rules mean the same in every regex engine."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "q")


ASCII = r"regexp_replace({}, '[^\x00-\x7F]', 'q', 'g')"


def plain_documents(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """Documents as ``post_id, text`` with ASCII text."""
    docs = table(spark, folder, "documents")
    docs = spread((docs if where is None else docs.filter(where)).select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("post_id"), ascii_text(F.col("text")).alias("text"))


PLAIN_DOCUMENTS = f"docs AS (SELECT doc_id AS post_id, {ASCII.format('text')} AS text FROM documents)"


def comments_table(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as comments of the post that has the conversation's number."""
    turns = spread(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    return turns.select(
        F.col("conv_id").alias("post_id"),
        F.concat_ws("-", "conv_id", "turn").alias("comment_id"),
        ascii_text(F.col("text")).alias("text"),
        F.col("role").alias("user_firm"),
    )


COMMENTS = f"""comments AS (SELECT conv_id AS post_id, conv_id || '-' || turn AS comment_id,
  {ASCII.format('text')} AS text, role AS user_firm FROM conversations)"""

# Cue words that occur in the test texts.
CUE_INCLUDE = [("starts the", r"^\s*the\b"), ("for the", r"\bfor\s+the\b"), ("the of", r"\bthe\s+of\b"), ("der", r"\bder\b")]
CUE_EXCLUDE = [("that the", r"\bthat\s+the\b"), ("are", r"\bare\b")]
CUE_CANDIDATE = r"\b(?:the|der)\b"
CUES = dict(include=CUE_INCLUDE, exclude=CUE_EXCLUDE, candidate=CUE_CANDIDATE)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_match(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {sql_text('(?i)' + pattern)}), false)"


def sql_any(column: str, rules) -> str:
    return "(" + " OR ".join(sql_match(column, p) for _, p in rules) + ")"


CUE_FLAG = (
    f"({sql_match('text', CUE_CANDIDATE)} AND {sql_any('text', CUE_INCLUDE)} AND NOT {sql_any('text', CUE_EXCLUDE)})"
)


def score_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Long score table of two score columns for the labelled documents."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    both = docs.join(table(spark, folder, "labels"), "doc_id")
    split = F.when(F.col("lang") == "en", "train").otherwise("test")
    length = (F.col("n_chars") % 997) / F.lit(997.0)
    digest = F.floor(hash_unit(F.col("doc_id")) * 50) / F.lit(50.0)
    models = F.explode(
        F.array(
            F.struct(F.lit("length").alias("model"), length.alias("p")),
            F.struct(F.lit("digest").alias("model"), digest.alias("p")),
        )
    )
    rows = both.select(F.col("doc_id").alias("post_id"), split.alias("split"), F.col("quality").alias("y"), models.alias("m"))
    return rows.select("post_id", "split", "y", "m.model", "m.p", (F.col("m.p") >= 0.5).cast("int").alias("pred"))


SCORES = """base AS (SELECT d.doc_id AS post_id, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split,
    quality AS y, (n_chars % 997) / 997.0::DOUBLE AS p1,
    floor(('0x' || substr(md5(d.doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 50) / 50.0::DOUBLE AS p2
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
scores AS (SELECT post_id, split, y, 'length' AS model, p1 AS p, (p1 >= 0.5)::INTEGER AS pred FROM base
  UNION ALL SELECT post_id, split, y, 'digest', p2, (p2 >= 0.5)::INTEGER FROM base)"""


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
