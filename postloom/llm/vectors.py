"""Near-duplicate vectors by tiled comparison in principal-component order.

Vectors are scaled to length one and turned into the basis of their principal
components, largest first. Two unit vectors with a cosine of at least ``c``
differ by at most ``sqrt(2 - 2c)`` in every direction, so the leading components
cut each label into cells of that width, and a cell meets itself and its
neighbours only. Cells are cut into chunks of about ``CHUNK`` vectors; a tile is a pair
of chunks, and a task holds one tile. In a tile products are summed over the
leading dimensions first; the rest is at most the product of the norms of what
remains, and pairs that cannot reach the threshold are dropped there. Pairs that
get through are compared in double precision as they were given.

Equal vectors of a label are one row with a weight. A tile gives one row for each
vector, its links and the smallest vector it is joined with in the tile, never
its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.graph import components
from postloom.session import settle

THRESHOLD = 0.98
CHUNK = 1024
GRID = 2
STEPS = (4, 8, 16, 32)
STRIP = 64
SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled by the largest entry first, so that no square overflows or vanishes
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_width(values: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length as one matrix, with their places."""
    lengths = np.diff(values.offsets.to_numpy())
    flat, begin = values.values.to_numpy(zero_copy_only=False).astype(np.float64), values.offsets.to_numpy()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[begin[at][:, None] + np.arange(d)]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of components of unit vectors, by width."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            for _, x in _by_width(batch.column("v").slice(at, 4096)):
                x = _unit(x)
                d = x.shape[1]
                sums[d] = sums.get(d, 0) + x.T @ x
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(s.ravel())], ["d", "i", "s"])


def _cells(bases, width: float, grid: int):
    """Components in principal order, and the cell of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cells: list = [None] * part.num_rows
                for rows, x in _by_width(part.column("v")):
                    lead = np.floor((_unit(x) @ bases.value[x.shape[1]])[:, :grid] / width).astype(np.int64)
                    for row, cell in zip(rows.tolist(), lead.tolist(), strict=True):
                        cells[row] = cell + [0] * (grid - len(cell))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.list_(pa.int64()))], [*part.schema.names, "cell"])

    return run


def linked(x: np.ndarray, basis: np.ndarray, split: int, threshold: float) -> np.ndarray:
    """Which of the first ``split`` rows link with which of all rows (or of the others, if ``split`` is not all)."""
    n, d = x.shape
    turned = _unit(x) @ basis
    tails = np.sqrt(np.maximum(0, np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]))
    scale = np.abs(x).max(axis=1, keepdims=True)
    plain = x / scale
    norms = np.sqrt(np.einsum("ij,ij->i", plain, plain))
    out = np.zeros((n, n), bool)
    left, right = (np.arange(n), np.arange(n)) if split == n else (np.arange(split), np.arange(split, n))
    stops = [s for s in STEPS if s < d]
    for at in range(0, len(left), STRIP):
        a = left[at : at + STRIP]
        done, partial = 0, np.zeros((len(a), len(right)))
        alive = np.ones((len(a), len(right)), bool)
        pairs = None
        for stop in stops:
            partial += turned[a, done:stop] @ turned[right, done:stop].T
            done = stop
            alive &= partial + np.outer(tails[a, stop], tails[right, stop]) >= threshold - SLACK
            if alive.sum() * 16 < alive.size:
                pairs = np.nonzero(alive)
                break
        if pairs is not None:
            i, j = pairs
            partial = partial[i, j]
            for stop in [s for s in stops if s > done] + [d]:
                partial = partial + np.einsum("ij,ij->i", turned[a[i], done:stop], turned[right[j], done:stop])
                bound = partial + (tails[a[i], stop] * tails[right[j], stop] if stop < d else 0)
                keep = bound >= threshold - SLACK
                i, j, partial, done = i[keep], j[keep], partial[keep], stop
        else:
            i, j = np.nonzero(alive & (partial + turned[a, done:] @ turned[right, done:].T >= threshold - SLACK))
        i, j = a[i], right[j]
        for cut in range(0, len(i), 1 << 15):
            p, q = i[cut : cut + (1 << 15)], j[cut : cut + (1 << 15)]
            hit = np.einsum("ij,ij->i", plain[p], plain[q]) / (norms[p] * norms[q]) >= threshold
            out[p[hit], q[hit]] = True
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """The smallest row each row is joined with."""
    root = np.arange(len(links))
    open_ = links.any(axis=1)
    for start in np.flatnonzero(open_):
        if not open_[start]:
            continue
        group = np.zeros(len(links), bool)
        front = np.array([start])
        while len(front):
            group[front] = True
            front = np.flatnonzero(links[front].any(axis=0) & ~group)
        open_[group] = False
        root[group] = start
    return root


def _tile(bases, threshold: float):
    def run(tile: tuple, table: pa.Table) -> pa.Table:
        _, _, a, b, i, j = (x.as_py() for x in tile)
        table = table.combine_chunks().sort_by([("side", "ascending"), ("id", "ascending")])
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        ((_, x),) = _by_width(table["v"].combine_chunks())
        split = int((side == 0).sum())
        within = a == b and i == j
        links = np.zeros((len(ids), len(ids)), bool)
        if within or 0 < split < len(ids):  # a chunk may have no partner
            links = linked(x, bases.value[x.shape[1]], split, threshold)
        weight = table["w"].to_numpy()
        order = np.argsort(ids, kind="stable")
        root = np.empty(len(ids), np.int64)
        root[order] = ids[order][roots(links[np.ix_(order, order)])]
        n = links @ weight
        keep = n > 0
        return pa.table({"id": ids[keep], "n": n[keep].astype(np.int64), "root": root[keep]})

    return run


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, chunk: int = CHUNK, grid: int = GRID
) -> DataFrame:
    """``(key, n_links, component)`` for every vector.

    Vectors of one label, not null, and of one length link when their cosine in
    double precision is at least ``threshold`` (above 0). Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing. Links to equal vectors
    count. The component is the smallest key reachable by links. Keys are unique
    integers. Further columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(fine)
    # one row for equal vectors of a label
    known = settle(usable.withColumn("same", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)), "vectors")
    classes = settle(known.groupBy("label", "same").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("w")), "vector-classes")
    members = settle(known.select("id", "label", "same").join(classes, ["label", "same"]).select("id", "node", "w"), "members")
    single = known.join(members.filter("id = node").select("id", "w"), "id").select("id", "label", "v", "w", F.size("v").alias("d"))

    sums: dict[int, np.ndarray] = {}
    for r in single.select("v").mapInArrow(_products, "d int, i int, s double").groupBy("d", "i").agg(F.sum("s").alias("s")).toLocalIterator():
        sums.setdefault(r.d, np.zeros(r.d * r.d))[r.i] = r.s
    bases = spark.sparkContext.broadcast({d: np.linalg.eigh(s.reshape(d, d))[1][:, ::-1] for d, s in sums.items()})

    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in single.schema)
    placed = settle(single.mapInArrow(_cells(bases, width, grid), f"{fields}, cell array<bigint>"), "cells")
    sizes = placed.groupBy("label", "d", "cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("k"))
    sizes = settle(sizes, "cell-sizes")
    placed = placed.join(sizes, ["label", "d", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))

    # tiles inside a cell: chunk i with every chunk j, the smaller one first
    own = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    own = own.select(
        "label", "d", F.col("cell").alias("a"), F.col("cell").alias("b"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "v", "w",
    )
    # tiles between a cell and its neighbours, each pair of cells once
    moves = np.array(np.meshgrid(*[[-1, 0, 1]] * grid, indexing="ij")).reshape(grid, -1).T.tolist()
    signed = [(m, 1 if m > [0] * grid else -1) for m in moves if m != [0] * grid]
    steps = F.array(*[F.struct(F.array(*[F.lit(x).cast("bigint") for x in m]).alias("m"), F.lit(s).alias("s")) for m, s in signed])
    near = placed.withColumn("step", F.explode(steps))
    near = near.withColumn("next", F.zip_with("cell", "step.m", lambda x, y: x + y))
    beside = sizes.select("label", "d", F.col("cell").alias("next"), F.col("k").alias("next_k"))
    near = near.join(beside, ["label", "d", "next"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("next_k") - 1)))
    up = F.col("step.s") > 0
    near = near.select(
        "label", "d", F.when(up, F.col("cell")).otherwise(F.col("next")).alias("a"), F.when(up, F.col("next")).otherwise(F.col("cell")).alias("b"),
        F.when(up, F.col("part")).otherwise(F.col("other")).alias("i"), F.when(up, F.col("other")).otherwise(F.col("part")).alias("j"),
        F.when(up, 0).otherwise(1).alias("side"), "id", "v", "w",
    )
    tiles = own.union(near).groupBy("label", "d", "a", "b", "i", "j").applyInArrow(_tile(bases, threshold), "id bigint, n bigint, root bigint")
    tiles = settle(tiles, "tile-links")
    counts = tiles.groupBy("id").agg(F.sum("n").alias("n"))
    found = components(tiles.select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = rows.select("id").join(members, "id", "left").join(counts.select(F.col("id").alias("node"), "n"), "node", "left")
    out = out.join(found, "node", "left")
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))
    return out.select(F.col("id").alias(key), links.alias("n_links"), F.coalesce("component", "node", "id").alias("component"))
