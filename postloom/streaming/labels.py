"""Offer and request flags on a stream of new comments or posts.

The flags are stateless columns, so the batch operators apply unchanged; only
the source and the sink differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postloom.operators.labels import flag_offers, flag_requests


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def stream_offers(comments: DataFrame) -> DataFrame:
    return flag_offers(comments)


def stream_requests(posts: DataFrame) -> DataFrame:
    return flag_requests(posts)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, exactly once per file, and stop."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
