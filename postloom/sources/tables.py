"""Tables on storage: explicit schemas, CSV and Parquet, rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS = (
    "post_id string, user_name string, user_firm string, date date, scrape_date date, num_likes int, "
    "num_comments int, num_views int, post_preview string, hashtags string, title string, text string, combined string"
)
POSTS_FULLTEXT = "post_id string, full_text string"
COMMENTS = "url string, post_id string, comment_id string, text string, user_firm string, referral_offer boolean"
EMBEDDINGS = "post_id string, embedding array<float>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted line breaks, read under a declared schema."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"', encoding="UTF-8").csv(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recompute_column(df: DataFrame, column: str, value, target: str) -> DataFrame:
    """Drop a derived column, compute it again and write the table to a new path."""
    return write_table(df.drop(column).withColumn(column, value), target)


def write_embeddings(df: DataFrame, path: str, key: str = "post_id", vector: str = "embedding") -> DataFrame:
    """Vectors as one array column, sorted by key inside each file for selective reads."""
    out = df.select(key, F.col(vector).cast("array<float>").alias(vector))
    out.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add metric rows to a report table laid out by split and model."""
    metrics.write.mode("append").partitionBy("split", "model").parquet(path)


def read_metrics(spark: SparkSession, path: str, split: str | None = None, model: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    if split is not None:
        table = table.filter(F.col("split") == split)
    if model is not None:
        table = table.filter(F.col("model") == model)
    return table
