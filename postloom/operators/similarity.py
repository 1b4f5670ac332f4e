"""Similar posts, and comparison of two sets of probabilities."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postloom.operators.quantiles import bin_edges, bin_index, exact_quantiles

QUERY_BLOCK = 4_096


def most_similar(
    queries: DataFrame, corpus: DataFrame, k: int = 5, query_key: str = "query_id", key: str = "post_id",
    vector: str = "embedding", block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` corpus rows of highest cosine with each query, exact.

    Queries come in blocks of ``block``, each broadcast and met by one scan of the
    corpus, which is never shuffled. A task keeps the best ``k`` per query over
    all its batches and hands them on once; the best of the tasks are merged as
    bounded lists, before and after the shuffle.
    """
    spark = queries.sparkSession
    kinds = {**dict(queries.dtypes), **{f"c_{c}": t for c, t in corpus.dtypes}}
    schema = f"{query_key} {kinds[query_key]}, {key} {kinds['c_' + key]}, cosine double"
    rows = corpus.filter(F.col(vector).isNotNull()).select(key, vector)
    found = None
    held: list = []

    def meet(part: list) -> DataFrame:
        return rows.mapInPandas(_best_of_task(spark.sparkContext.broadcast(part), k, query_key, key, vector), schema)

    for r in queries.filter(F.col(vector).isNotNull()).select(query_key, vector).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:
            found = meet(held) if found is None else found.unionByName(meet(held))
            held = []
    if held or found is None:
        found = meet(held) if found is None else found.unionByName(meet(held))
    # the hash of the row deals each query over some groups first, so no task gets more than its share of the tasks' lists
    spread_over = F.pmod(F.xxhash64(key), F.lit(16)).alias("_part")
    parts = found.select("*", spread_over)
    first = F.row_number().over(W.partitionBy(query_key, "_part").orderBy(F.desc("cosine"), key))
    parts = parts.withColumn("rank", first).filter(F.col("rank") <= k).drop("rank", "_part")
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("cosine"), key))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best_of_task(shared, k: int, query_key: str, key: str, vector: str):
    def best(batches: Iterator):
        import numpy as np
        import pandas as pd

        if not shared.value:
            return
        names = [n for n, _ in shared.value]
        matrix = np.array([v for _, v in shared.value], dtype=np.float64)
        scale = np.linalg.norm(matrix, axis=1, keepdims=True)
        unit = np.divide(matrix, scale, out=np.zeros_like(matrix), where=scale > 0)
        top_ids = top_cosines = None
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                rows = np.vstack(part[vector].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                cosines = unit @ np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0).T
                ids = np.broadcast_to(part[key].to_numpy(), cosines.shape)
                if top_ids is not None:
                    ids, cosines = np.hstack([top_ids, ids]), np.hstack([top_cosines, cosines])
                # by cosine, then by id, so that ties do not depend on the batches
                order = np.lexsort((ids, -cosines), axis=1)[:, :k]
                top_ids, top_cosines = np.take_along_axis(ids, order, 1), np.take_along_axis(cosines, order, 1)
        if top_ids is not None:
            n = top_ids.shape[1]
            for q in range(0, len(names), 1024):
                block = slice(q, q + 1024)
                yield pd.DataFrame(
                    {query_key: np.repeat(names[block], n), key: top_ids[block].ravel(), "cosine": top_cosines[block].ravel()}
                )

    return best


def relate_probabilities(wide: DataFrame, first: str, second: str, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """Correlation of two models' probabilities, and means of both per bin of the first."""
    both = wide.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    link = both.agg(F.corr(first, second).alias("correlation"), F.count(F.lit(1)).alias("n"))
    edges = exact_quantiles(both, first, [i / bins for i in range(bins + 1)])
    index = bin_index(F.col(first).cast("double"), bin_edges(edges) if edges else [])
    curve = both.groupBy(index.alias("bin")).agg(
        F.avg(first).alias("first_prob"), F.avg(second).alias("second_prob"), F.count(F.lit(1)).alias("n")
    )
    return link, curve


def revision_effect(before: DataFrame, after: DataFrame, key: str = "post_id", p: str = "p") -> DataFrame:
    """Mean probability before and after a revision, mean change and share improved."""
    both = _paired(before, after, key, p)
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("p_before").alias("mean_before"),
        F.avg("p_after").alias("mean_after"),
        F.avg(F.col("p_after") - F.col("p_before")).alias("mean_change"),
        F.avg((F.col("p_after") > F.col("p_before")).cast("double")).alias("share_improved"),
    )


def improvement_by_initial(before: DataFrame, after: DataFrame, key: str = "post_id", p: str = "p", bins: int = 20) -> DataFrame:
    """Share of improved posts per equal-frequency bin of the initial probability."""
    both = _paired(before, after, key, p)
    edges = exact_quantiles(both, "p_before", [i / bins for i in range(bins + 1)])
    index = bin_index(F.col("p_before").cast("double"), bin_edges(edges) if edges else [])
    return both.groupBy(index.alias("bin")).agg(
        F.avg("p_before").alias("mean_before"),
        F.avg((F.col("p_after") > F.col("p_before")).cast("double")).alias("share_improved"),
        F.count(F.lit(1)).alias("n"),
    )


def revision_histogram(before: DataFrame, after: DataFrame, p: str = "p", bins: int = 20) -> DataFrame:
    """Posts per equal-width bin of [0, 1] before and after."""
    place = F.least(F.floor(F.col(p) * bins) + 1, F.lit(bins)).cast("int")
    both = before.select(place.alias("bin"), F.lit("before").alias("stage")).unionByName(
        after.select(place.alias("bin"), F.lit("after").alias("stage"))
    )
    return both.groupBy("bin").agg(
        F.count_if(F.col("stage") == "before").alias("n_before"), F.count_if(F.col("stage") == "after").alias("n_after")
    )


def _paired(before: DataFrame, after: DataFrame, key: str, p: str) -> DataFrame:
    return before.select(key, F.col(p).alias("p_before")).join(after.select(key, F.col(p).alias("p_after")), key)
