"""Features without leakage: everything is fitted on train rows only."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.functions.columns import words
from postloom.functions.vectors import unit
from postloom.operators.joins import lookup_join
from postloom.operators.selection import dense_index
from postloom.session import scratch_path, settle


def standard_scale(df: DataFrame, columns: Sequence[str], train: str = "train") -> DataFrame:
    """Zero mean and unit population variance by train statistics; constants are only centred."""
    stats = df.filter(F.col(train)).agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).alias("stats")
    )
    fitted = stats.scalar()

    def scaled(c: str):
        spread = fitted[f"s_{c}"]
        return (F.col(c) - fitted[f"m_{c}"]) / F.when(spread > 0, spread).otherwise(F.lit(1.0))

    return df.withColumns({c: scaled(c) for c in columns})


MAX_COLUMNS = 1_000


def category_index(df: DataFrame, column: str, train: str = "train") -> DataFrame:
    """``category, idx`` of the categories of train rows but the most frequent one, as a table.

    The first in order wins among equally frequent ones; ``idx`` runs from 0 without gaps.
    """
    known = df.filter(F.col(train) & F.col(f"`{column}`").isNotNull())
    counts = settle(known.groupBy(F.col(f"`{column}`").cast("string").alias("term")).agg(F.count(F.lit(1)).alias("df")), "categories")
    top = counts.orderBy(F.desc("df"), "term").limit(1)
    kept = counts.join(F.broadcast(top.select("term")), "term", "left_anti").withColumn("idf", F.lit(0.0))
    return dense_index(kept).select(F.col("term").alias("category"), "idx")


def one_hot(df: DataFrame, column: str, train: str = "train") -> DataFrame:
    """Indicator columns for train categories, without the most frequent one.

    For categories that can be columns, ``MAX_COLUMNS`` at most; any number of them is one sparse vector by
    :func:`one_hot_vectors`.
    """
    index = category_index(df, column, train)
    n = index.count()
    if n > MAX_COLUMNS:
        raise ValueError(f"{column} has {n + 1} categories; use one_hot_vectors")
    kept = sorted(r.category for r in index.select("category").collect())
    flags = {f"{column}_{c}": F.coalesce((F.col(f"`{column}`").cast("string") == F.lit(c)).cast("int"), F.lit(0)) for c in kept}
    return df.withColumns(flags).drop(column)


def one_hot_entries(df: DataFrame, column: str, key: str, train: str = "train") -> DataFrame:
    """``key, features`` where ``features`` holds size, indices and values of a sparse vector; other categories have no entry."""
    index = category_index(df, column, train)
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").cast("string").alias("category"))
    met = lookup_join(rows, index, "category", "left", [key], materialise=False)
    known = F.col("idx").isNotNull()
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(index.count()).cast("int").alias("size"),
        F.when(known, F.array(F.col("idx").cast("int"))).otherwise(F.expr("cast(array() as array<int>)")).alias("indices"),
        F.when(known, F.array(F.lit(1.0))).otherwise(F.expr("cast(array() as array<double>)")).alias("values"),
    )
    return met.select(key, parts.alias("features"))


def one_hot_vectors(df: DataFrame, column: str, key: str, train: str = "train") -> DataFrame:
    """One sparse ML vector per row for any number of categories, read back from its storage layout."""
    return as_vectors(one_hot_entries(df, column, key, train))


PARTS = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def as_vectors(df: DataFrame, column: str = "features") -> DataFrame:
    """A column of vector parts as ML vectors: written out, and read back as what it is stored as."""
    return _stored(df, column, VectorUDT())


def vector_parts(df: DataFrame, column: str = "features") -> DataFrame:
    """ML vectors as their parts: type (0 sparse, 1 dense), size, indices and values; nothing is filled with zeros."""
    return _stored(df, column, T.StructType.fromDDL(f"x {PARTS}")["x"].dataType)


def _stored(df: DataFrame, column: str, kind: T.DataType) -> DataFrame:
    path = scratch_path(df.sparkSession, "vectors")
    df.write.parquet(path)
    fields = [T.StructField(f.name, kind if f.name == column else f.dataType) for f in df.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def balanced_weights(df: DataFrame, label: str, name: str = "w") -> DataFrame:
    """Row weights ``n / (k * n_class)``; they sum to the number of rows."""
    counts = settle(df.filter(F.col(label).isNotNull()).groupBy(label).count(), "class-sizes")
    n, k = counts.agg(F.sum("count"), F.count(F.lit(1))).first()
    weights = counts.select(label, (F.lit(float(n or 0)) / (F.col("count") * F.lit(float(k)))).alias(name))
    columns = df.columns
    return lookup_join(df, weights, label, "left", materialise=False).select(*columns, name)


def prepare_features(
    posts: DataFrame,
    feats: DataFrame,
    nums: Sequence[str] = (),
    categs: Sequence[str] = (),
    key: str = "post_id",
    train: str = "train",
    keep: Sequence[str] = ("train", "test", "class_offers"),
) -> tuple[DataFrame, list[str]]:
    """Posts joined with one feature table, scaled and encoded; also the feature names in order."""
    df = posts.select(key, *keep).join(feats, key, "left")
    if nums:
        df = standard_scale(df, nums, train)
    for c in categs:
        df = one_hot(df, c, train)
    return df, [c for c in df.columns if c not in (key, *keep)]


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one ML vector; missing values become 0, arrays become vectors.

    A missing array becomes zeros of the length of the others.
    """
    from pyspark.ml.functions import array_to_vector

    ready, filled = [], {}
    for c in columns:
        kind = dict(df.dtypes)[c]
        if kind.startswith("array"):
            size = df.agg(F.coalesce(F.max(F.size(c)), F.lit(0)).alias("n")).first().n
            held = F.transform(F.col(c), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
            filled[f"_v_{c}"] = array_to_vector(F.coalesce(held, F.array_repeat(F.lit(0.0), max(size, 0))))
            ready.append(f"_v_{c}")
        elif kind == "boolean":
            filled[f"_v_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            ready.append(f"_v_{c}")
        else:
            filled[f"_v_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            ready.append(f"_v_{c}")
    df = df.withColumns(filled)
    return VectorAssembler(inputCols=ready, outputCol=out).transform(df).drop(*ready)


Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


def encode_text(
    df: DataFrame, key: str, text: str, encoder: Encoder | None = None, size: int = 256, out: str = "embedding"
) -> DataFrame:
    """Texts as unit vectors, ``key`` and ``array<float>``.

    ``encoder`` maps a list of texts to vectors and runs on Arrow batches, once
    per batch; a model it needs is loaded on first use in the worker. Without
    one, hashed word counts are used and nothing leaves the JVM.
    """
    if encoder is None:
        tokens = df.select(key, words(F.lower(text)).alias("_t"))
        hashed = HashingTF(numFeatures=size, inputCol="_t", outputCol="_h").transform(tokens)
        scaled = Normalizer(p=2.0, inputCol="_h", outputCol="_n").transform(hashed)
        return scaled.select(key, vector_to_array("_n", "float32").alias(out))

    def run(batches: Iterator):
        for batch in batches:
            vectors = encoder(batch[text].fillna("").tolist())
            yield batch[[key]].assign(**{out: [[float(x) for x in v] for v in vectors]})

    schema = f"{key} {dict(df.dtypes)[key]}, {out} array<float>"
    raw = df.select(key, text).mapInPandas(run, schema)
    return raw.withColumn(out, unit(F.col(out)).cast("array<float>"))
