"""Boosted trees of the second order: L1 and L2 on leaves, Hessian weight of children, row and column sampling.

Values become bins between quantiles once. A tree grows level by level: one pass
over the table gives the sums of gradients and Hessians in every bin of every
feature for all nodes of the level, added up by Spark. The tasks that add up a
stretch of features hand on its best cut for each node, and the driver picks
among those. Absent entries of sparse vectors are zeros and
lie in the bin of zero; they are counted as what is missing from a node's sum.
Margins of finished trees are written with the rows now and then, so a pass
walks a bounded number of trees.

The driver holds the edges (features by bins) and one level's best cuts (nodes
by stretches of features), never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.features import balanced_weights, vector_parts
from postloom.operators.penalty import Table, sigmoid
from postloom.operators.selection import value_ranks
from postloom.session import local_table, settle

BINS = 64
KEEP_TREES = 10
ROWS = 2048
LEAST_GAIN = 1e-6
# entries that one task may hold to grow all trees in one job
SMALL = 4_000_000
ROW_FIELDS = "h bigint, y int, w double, margin double, indices array<int>, bins array<smallint>"


@dataclass
class Settings:
    trees: int = 100
    depth: int = 4
    rate: float = 0.01
    child_weight: float = 5.0
    alpha: float = 0.1
    ridge: float = 1.0
    gain: float = 0.0
    rows: float = 0.8
    columns: float = 0.8
    bins: int = BINS
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order from 1: the feature (-1: a leaf), the last bin that goes left, and the value of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(hashes: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree reads: a hash of the row, the tree and the seed, whatever the partitioning."""
    with np.errstate(over="ignore"):
        salt = mix(np.array([tree * 1_000_003 + seed], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (mix(hashes.view(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / 2.0**53 < share


def drawn_columns(width: int, tree: int, seed: int, share: float) -> np.ndarray:
    """The columns a tree may cut: an exact share of them, by a hash."""
    with np.errstate(over="ignore"):
        order = np.argsort(mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree * 7919 + seed)), kind="stable")
    out = np.zeros(width, bool)
    out[order[: max(1, round(share * width))]] = True
    return out


def quantile_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Sorted different edges of every feature: exact quantiles of its entries, and zero where entries are absent."""
    places = F.when(F.col("features.type") == 1, F.sequence(F.lit(0), F.size("features.values") - 1)).otherwise(F.col("features.indices"))
    entry = F.explode(F.arrays_zip(places.alias("i"), F.col("features.values").alias("v"))).alias("e")
    entries = rows.filter(F.size("features.values") > 0).select(entry).select(F.col("e.i").alias("g"), F.col("e.v").alias("v"))
    sizes = settle(entries.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("v")).alias("inside")), "feature-sizes")
    wanted = sizes.filter("inside > 0").select("g", "inside", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("k"))
    wanted = wanted.select("g", "inside", F.expr(f"(k * inside + {bins - 1}) div {bins} - 1").alias("rank")).distinct()
    found = value_ranks(entries.filter(~F.isnan("v")), wanted).groupBy("g").agg(F.collect_set("value").alias("edges"))
    n = rows.count()
    out = [np.zeros(1)] * width
    for r in sizes.join(found, "g", "left").toLocalIterator():
        edges = np.unique(np.array(r.edges or [], float))
        out[r.g] = np.unique(np.append(edges, 0.0)) if r.n < n else edges
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


class Bins:
    """Binned entries of a batch; a row without indices is dense.

    Where all rows are dense and whole, ``dense`` holds them as a matrix, and no entry is looked at on its own.
    """

    def __init__(self, part: pa.RecordBatch, zero: np.ndarray):
        bins, indices = part.column("bins"), part.column("indices")
        sizes = np.diff(bins.offsets.to_numpy())
        self.n, self.zero, self.dense = part.num_rows, zero, None
        flat = bins.flatten().to_numpy()
        if indices.null_count == self.n and (sizes == len(zero)).all():
            self.dense = flat.reshape(self.n, len(zero))
            return
        self.bin = flat.astype(np.int64)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.column = np.arange(len(self.bin)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sparse = indices.is_valid().to_numpy(zero_copy_only=False)
        self.column[sparse[self.row]] = indices.flatten().to_numpy()

    def of(self, features: np.ndarray) -> np.ndarray:
        """Bins of some features, one column each."""
        if self.dense is not None:
            return self.dense[:, features].astype(np.int64)
        places = np.full(len(self.zero), -1)
        places[features] = np.arange(len(features))
        out = np.repeat(self.zero[features][None], self.n, axis=0)
        at = places[self.column]
        keep = at >= 0
        out[self.row[keep], at[keep]] = self.bin[keep]
        return out


def leaves(held: Bins, tree: Tree, level: int | None = None) -> np.ndarray:
    """The node of every row after ``level`` cuts (all, without one)."""
    used = np.unique(tree.feature[tree.feature >= 0])
    node = np.ones(held.n, np.int64)
    if not len(used):
        return node
    bins = held.of(used)
    place = np.searchsorted(used, np.maximum(tree.feature, used[0]))
    for _ in range(level if level is not None else len(tree.feature).bit_length() - 2):
        inner = tree.feature[node] >= 0
        right = bins[np.arange(held.n), np.minimum(place[node], len(used) - 1)] > tree.cut[node]
        node = np.where(inner, 2 * node + right, node)
    return node


def margins(held: Bins, trees: Sequence[Tree]) -> np.ndarray:
    out = np.zeros(held.n)
    for tree in trees:
        out += tree.value[leaves(held, tree)]
    return out


def _soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _worth(g, h, s: Settings):
    return _soft(g, s.alpha) ** 2 / (h + s.ridge)


def best_cuts(sums: np.ndarray, allowed: np.ndarray, n_bins: np.ndarray, s: Settings) -> list[tuple[int, int, float] | None]:
    """Feature, bin and gain of the best cut of each node from ``sums[g or h, node, feature, bin]``; the first among equals."""
    out = []
    last = np.arange(sums.shape[3])[None] >= n_bins[:, None] - 1
    for g, h in zip(sums[0], sums[1], strict=True):
        left_g, left_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
        all_g, all_h = left_g[:, -1:], left_h[:, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = (_worth(left_g, left_h, s) + _worth(right_g, right_h, s) - _worth(all_g, all_h, s)) / 2 - s.gain
        gain[(left_h < s.child_weight) | (right_h < s.child_weight) | last | ~allowed[:, None]] = -np.inf
        # sums of one node differ in the last digits from feature to feature
        at = int(np.argmax(np.round(gain, 10)))
        f, b = divmod(at, gain.shape[1])
        out.append((f, b, float(gain[f, b])) if gain[f, b] > LEAST_GAIN else None)
    return out


def grow(table: Table, tree_number: int, done: Sequence[Tree], zero: np.ndarray, n_bins: np.ndarray, s: Settings) -> Tree:
    """One tree; a pass over the table for each of its levels."""
    size, width, most = 1 << (s.depth + 1), table.width, int(n_bins.max(initial=1))
    tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
    allowed = drawn_columns(width, tree_number, s.seed, s.columns)
    sums_of: dict[int, tuple[float, float]] = {}
    for level in range(s.depth):
        nodes = np.arange(1 << level, 2 << level)
        nodes = nodes if level == 0 else nodes[[tree.feature[n // 2] >= 0 for n in nodes]]
        if not len(nodes):
            break
        place = np.full(size, -1)
        place[nodes] = np.arange(len(nodes))

        def run(batches, shared):
            tree, done, zero, place, count = shared
            out = np.zeros((2, count * width * most))
            node_sums = np.zeros((2, count))
            entries = np.zeros((2, count * width))
            for part in _batches(batches):
                held = Bins(part, zero)
                take = drawn(part.column("h").to_numpy(), tree_number, s.seed, s.rows)
                node = place[leaves(held, tree, level)]
                p = sigmoid(part.column("margin").to_numpy() + margins(held, done))
                w, y = part.column("w").to_numpy(), part.column("y").to_numpy()
                take &= node >= 0
                if held.dense is not None:
                    # every entry is there, so nothing of the node's sum is missing
                    rows = np.flatnonzero(take)
                    at = ((node[rows, None] * width + np.arange(width)) * most + held.dense[rows]).ravel()
                    for k, v in enumerate((w * (p - y), w * p * (1 - p))):
                        out[k] += np.bincount(at, weights=np.repeat(v[rows], width), minlength=out.shape[1])
                    continue
                for k, v in enumerate((w * (p - y), w * p * (1 - p))):
                    v = np.where(take, v, 0.0)
                    node_sums[k] += np.bincount(node[take], weights=v[take], minlength=count)
                    keep = take[held.row]
                    at = node[held.row[keep]] * width + held.column[keep]
                    out[k] += np.bincount(at * most + held.bin[keep], weights=v[held.row[keep]], minlength=out.shape[1])
                    entries[k] += np.bincount(at, weights=v[held.row[keep]], minlength=entries.shape[1])
            # what is missing from a node's sum are zeros
            rest = np.repeat(node_sums, width, axis=1) - entries
            at = np.arange(count * width) * most + np.tile(zero, count)
            out[:, at] += rest
            out = out.reshape(2, count, width, most)
            return {i: out[:, :, at : at + step] for i, at in enumerate(range(0, width, step))}

        def chosen(i, sums, shared):
            """For every node whether a stretch of features has a cut, and feature, bin, gain, sums to the left and sums of all."""
            at, count = i * step, shared[4]
            sums = sums.reshape(2, count, -1, most)
            best = best_cuts(sums, allowed[at : at + step], n_bins[at : at + step], s)
            made = [(1, at + c[0], *c[1:], *sums[:, m, c[0], : c[1] + 1].sum(axis=1), *sums[:, m, c[0]].sum(axis=1)) if c else (0,) * 6 + tuple(sums[:, m, 0].sum(axis=1)) for m, c in enumerate(best)]
            return np.array(made, float)

        step = max(1, STRETCH // (len(nodes) * most))
        found = table.sums(run, (tree, list(done), zero, place, len(nodes)), chosen)
        made = np.stack([found[i].reshape(len(nodes), 8) for i in sorted(found)]) if found else np.zeros((1, len(nodes), 8))
        if level == 0:
            sums_of[1] = tuple(made[0, 0, 6:])
        for i, n in enumerate(nodes):
            # the first among equals, as within a stretch
            cuts = made[made[:, i, 0] == 1, i]
            if not len(cuts):
                continue
            _, f, b, _, *left = cuts[int(np.argmax(np.round(cuts[:, 3], 10)))]
            tree.feature[n], tree.cut[n] = int(f), int(b)
            sums_of[2 * n], sums_of[2 * n + 1] = tuple(left[:2]), (left[2] - left[0], left[3] - left[1])
    for n, (g, h) in sums_of.items():
        if tree.feature[n] < 0:
            tree.value[n] = -s.rate * float(_soft(np.array(g), s.alpha)) / (h + s.ridge)
    return tree


STRETCH = 1 << 16


def _binned(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))):
            values, indices = part.column("values"), part.column("indices")
            sizes = np.diff(values.offsets.to_numpy())
            v = values.flatten().to_numpy()
            row = np.repeat(np.arange(part.num_rows), sizes)
            column = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            sparse = indices.is_valid().to_numpy(zero_copy_only=False)
            column[sparse[row]] = indices.flatten().to_numpy()
            out = np.zeros(len(v), np.int16)
            order = np.argsort(column, kind="stable")
            cuts = np.flatnonzero(np.diff(column[order], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                at = order[a:b]
                out[at] = np.searchsorted(edges[column[at[0]]], v[at], "left")
            bins = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out))
            names = ["h", "y", "w", "margin"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], indices, bins], [*names, "indices", "bins"])

    return run


def _advanced(trees, zero):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            margin = part.column("margin").to_numpy() + margins(Bins(part, zero), trees.value)
            columns = [pa.array(margin) if name == "margin" else part.column(name) for name in part.schema.names]
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return run


@dataclass
class BoostedModel:
    """Edges of the bins and trees; scores vectors of the width it was fitted on."""

    edges: list[np.ndarray]
    trees: list[Tree]

    @property
    def zero(self) -> np.ndarray:
        return np.array([np.searchsorted(e, 0.0, "left") for e in self.edges], np.int64)

    def scores(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        """``keep`` columns, probability ``p`` and prediction ``pred`` of every row."""
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast(self)
        parts = vector_parts(df.select(*keep, F.col(features).alias("features")))
        fixed = parts.select(
            F.struct(*keep).alias("kept"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("margin"),
            F.when(F.col("features.type") == 0, F.col("features.indices")).alias("indices"), F.col("features.values").alias("values"),
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    (binned,) = _binned(model.edges)(iter([part]))
                    p = sigmoid(margins(Bins(binned, model.zero), model.trees))
                    yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(p)], ["kept", "p"])

        kind = fixed.schema["kept"].dataType.simpleString()
        out = fixed.mapInArrow(run, f"kept {kind}, p double")
        return out.select("kept.*", "p", (F.col("p") > 0.5).cast("int").alias("pred"))

    def save(self, spark: SparkSession, path: str) -> None:
        """As two tables: the edges of every feature, and the nodes of every tree."""
        edges = [(i, [float(x) for x in e]) for i, e in enumerate(self.edges)]
        local_table(spark, edges, "idx int, edges array<double>").write.mode("overwrite").parquet(f"{path}/edges")
        nodes = [(t, n, int(x.feature[n]), int(x.cut[n]), float(x.value[n])) for t, x in enumerate(self.trees) for n in range(len(x.feature))]
        local_table(spark, nodes, NODES).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        edges = [np.array(r.edges) for r in spark.read.parquet(f"{path}/edges").orderBy("idx").toLocalIterator()]
        return cls(edges, _trees_of(spark.read.parquet(f"{path}/nodes").toPandas()))


def fit_trees(train: DataFrame, label: str, key: str, settings: Settings | None = None) -> BoostedModel:
    """Balanced boosted trees on a column ``features``; rows without a label or features are left aside."""
    s = settings or Settings()
    columns = train.select(F.xxhash64(F.col(key)).alias("h"), F.col(label).cast("int").alias("y"), "features").filter("y is not null and features is not null")
    rows = vector_parts(balanced_weights(columns, "y"))
    width = F.max(F.when(F.col("features.type") == 1, F.size("features.values")).otherwise(F.col("features.size")))
    n, widest = rows.agg(F.count(F.lit(1)), width).first()
    edges = quantile_edges(rows, widest or 0, s.bins)
    model = BoostedModel(edges, [])
    if not n or not widest:
        return model
    flat = rows.select(
        "h", "y", "w", F.lit(0.0).alias("margin"), F.when(F.col("features.type") == 0, F.col("features.indices")).alias("indices"), F.col("features.values").alias("values")
    )
    held = settle(flat.mapInArrow(_binned(edges), ROW_FIELDS), "binned")
    n_bins = np.array([len(e) + 1 for e in edges])
    if n * widest <= SMALL:
        zero = model.zero

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = _boosted(Held(list(batches), widest), zero, n_bins, s)
            rows = [(t, n, int(x.feature[n]), int(x.cut[n]), float(x.value[n])) for t, x in enumerate(trees) for n in range(len(x.feature))]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "node", "feature", "cut", "value"])

        # the same steps in one task, which holds the rows
        nodes = held.coalesce(1).sortWithinPartitions("h").mapInArrow(grown, NODES).toPandas()
        model.trees = _trees_of(nodes)
    else:
        model.trees = _boosted(Table(held, n, widest), model.zero, n_bins, s)
    return model


NODES = "tree int, node int, feature int, cut int, value double"


def _trees_of(nodes) -> list[Tree]:
    nodes = nodes.sort_values(["tree", "node"])
    return [Tree(x.feature.to_numpy(), x.cut.to_numpy().astype(np.int64), x.value.to_numpy()) for _, x in nodes.groupby("tree")]


@dataclass
class Held:
    """Binned rows in the memory of one task, with the sums of :class:`Table`."""

    parts: list[pa.RecordBatch]
    width: int

    def sums(self, run, shared, finish) -> dict[int, np.ndarray]:
        return {i: finish(i, x, shared) for i, x in run(iter(self.parts), shared).items()}

    def advanced(self, trees: list[Tree], zero: np.ndarray) -> Held:
        class Shared:
            value = trees

        return Held(list(_advanced(Shared, zero)(iter(self.parts))), self.width)


def _boosted(table: Table | Held, zero: np.ndarray, n_bins: np.ndarray, s: Settings) -> list[Tree]:
    """All trees, one after another; margins of finished ones are kept with the rows every ``KEEP_TREES`` trees."""
    out, recent = [], []
    for number in range(s.trees):
        tree = grow(table, number, recent, zero, n_bins, s)
        out.append(tree)
        recent.append(tree)
        if len(recent) == KEEP_TREES and number + 1 < s.trees:
            if isinstance(table, Held):
                table = table.advanced(recent, zero)
            else:
                shared = table.rows.sparkSession.sparkContext.broadcast(list(recent))
                table = Table(settle(table.rows.mapInArrow(_advanced(shared, zero), ROW_FIELDS), "margins"), table.n, table.width)
            recent = []
    return out
