"""Vector columns: arrays of numbers handled in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    return F.transform(
        F.array(F.struct(v.alias("v"), l2_norm(v).alias("n"))),
        lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(F.lit(0.0))),
    )[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def positive_probability(score: Column) -> Column:
    """Probability of the positive class from a two-class score difference."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def predicted(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= F.lit(threshold)).cast("int")


def vector_columns(v: Column, size: int, prefix: str = "enc") -> list[Column]:
    """The entries of a vector as columns ``enc1``, ``enc2`` and so on."""
    return [F.get(v, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(size)]
