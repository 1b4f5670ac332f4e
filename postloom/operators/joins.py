"""Lookups that stay balanced when a key is hot, and key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import settle

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a lookup side: both its rows and its serialised bytes must be bounded.

    One parallel aggregate; a task hands on two numbers.
    """
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    salt_by: Sequence[str | Column] = (),
    tasks: int | None = None,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    materialise: bool = True,
) -> DataFrame:
    """Join many rows to a table that is unique in ``on``.

    The lookup side is written out once and measured. When it is small it is
    broadcast and ``left`` is not shuffled. Otherwise keys that hold more than a
    task's share of ``left`` are spread, see :func:`spread_join`.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if materialise:
        right = settle(right, "lookup")
    if fits_broadcast(right, max_rows, max_bytes):
        return left.join(F.broadcast(right), keys, how)
    return spread_join(left, right, keys, how, salt_by, tasks)


# A sketch of frequent items: counts are exact up to a TRACKED-th of the rows.
TRACKED = 16_384


def hot_keys(df: DataFrame, keys: Sequence[str], tasks: int, tracked: int = TRACKED) -> DataFrame:
    """``_key, _salts``: hashes of keys with more rows than a task's share, and the tasks that each asks for.

    One pass over the keys with a sketch of bounded size; fewer than ``tasks`` keys can be hot.
    """
    rows = df.filter(_no_null(keys)).select(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("h"))
    most = min(tasks, tracked // 2)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {most}, {tracked})").alias("top"))
    hot = found.select("n", F.explode("top").alias("t")).select(F.col("t.item").alias("_key"), F.ceil(F.col("t.count") * tasks / F.col("n")).alias("_salts"))
    return settle(hot.filter("_salts > 1"), "hot-keys")


def _no_null(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"`{k}`").isNotNull()
    return out


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", salt_by: Sequence[str | Column] = (), tasks: int | None = None
) -> DataFrame:
    """Join on keys of which some may hold a large part of ``left``; ``right`` is unique in them.

    The keys of ``left`` are counted by a sketch. A hot key gets as many salts as its share asks for, taken from
    ``salt_by`` (a row identity), and only its lookup row is copied, once per salt. Rows with a null key match nothing
    and are spread as they come.
    """
    keys = list(on)
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(left, keys, tasks))  # fewer rows than tasks
    identity = list(salt_by) or [c for c in left.columns if c not in keys] or keys
    whole = _no_null(keys)
    marked = left.withColumn("_key", F.xxhash64(*[F.col(f"`{k}`") for k in keys])).join(hot, "_key", "left")
    salts = F.when(whole, F.coalesce("_salts", F.lit(1))).otherwise(F.lit(tasks))
    marked = marked.withColumn("_salt", F.pmod(F.xxhash64(*identity), salts)).drop("_key", "_salts")
    # the hash of a key has to be that of the other side's type
    kinds = dict(left.dtypes)
    key = F.xxhash64(*[F.col(f"`{k}`").try_cast(kinds[k]) for k in keys])
    copied = right.withColumn("_key", key).join(hot, "_key", "left")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1)
    copied = copied.withColumn("_salt", F.explode(copies)).drop("_key", "_salts")
    return marked.join(copied, [*keys, "_salt"], how).drop("_salt")


def repeated_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; empty means unique."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def flag_from_subset(df: DataFrame, flagged: DataFrame, key: str, flag: str) -> DataFrame:
    """Left join a flagged subset on its key; rows without a match get false."""
    hit = flagged.select(key, F.col(flag).cast("boolean").alias("_hit"))
    return df.join(hit, key, "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")


def fill_by_key(df: DataFrame, other: DataFrame, key: str, target: str, source: str) -> DataFrame:
    """Fill nulls of ``target`` from ``other.source`` on the row with the same key."""
    fill = other.select(key, F.col(source).alias("_fill"))
    return df.join(fill, key, "left").withColumn(target, F.coalesce(F.col(target), F.col("_fill"))).drop("_fill")


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keep the rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")
