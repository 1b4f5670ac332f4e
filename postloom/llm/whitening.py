"""Whitening of embeddings with eigenpairs from contour integrals (FEAST).

Vectors are turned into integers, so sums over the table are exact whatever the
partitioning. The covariance is a table of at most ``width ** 2`` sums, centred
at the rounded mean before products are taken. Its leading eigenpairs come from
a rational filter: solves with complex shifts along a circle around an interval
of eigenvalues project a random block onto its eigenspace, a Rayleigh-Ritz step
takes the pairs out, and the block goes round again until residuals vanish. How
many eigenvalues lie in an interval is known beforehand from the inertia of the
shifted matrix (Sylvester's law), which cuts the spectrum into intervals of a few
eigenvalues each and shows that none is missed.

Results for special rows: vectors that are null, empty, or hold null or
non-finite entries, or entries of 2 ** 40 and more in size, are left out, and so
are vectors of another length than most (of the longer one on a tie). Null and
repeated keys are rows like any other. Components whose eigenvalue is not above
``LEAST`` of the largest have no whitened value and no row, so a table without
spread gives an empty result, as an empty table does. ``deviation`` is null
where it does not fit a long. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import settle

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
LARGEST = float(1 << 40)
NODES = 8
IN_INTERVAL = 6
LEAST = 1e-12
TOLERANCE = 1e-13
ROUNDS = 40
# rows of one product: entries up to 2 ** 20 from the centre give exact sums of products in double precision
ROWS = 4096
BLOCK = 1 << 20


def below(v: np.ndarray, sigma: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below ``sigma``: negative pivots of its block elimination."""
    a = v - sigma * np.eye(len(v))
    count = 0
    alpha = (1 + np.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[p] >= alpha * off[r, s]:
            pivot = a[p, p]
            if pivot == 0:
                return count
            count += int(pivot < 0)
            a = np.delete(np.delete(a - np.outer(a[:, p], a[p]) / pivot, p, 0), p, 1)
        else:
            # a two by two pivot has one negative and one positive eigenvalue here
            count += 1
            pair = [r, s]
            a = a - a[:, pair] @ np.linalg.solve(a[np.ix_(pair, pair)], a[pair])
            a = np.delete(np.delete(a, pair, 0), pair, 1)
        a = (a + a.T) / 2
    return count


def intervals(v: np.ndarray, count: int, most: int = IN_INTERVAL) -> list[tuple[float, float, int]]:
    """Intervals with the ``count`` largest eigenvalues and perhaps a few more, largest first, and how many each holds.

    An interval of more than ``most`` is halved until it is as narrow as rounding allows.
    """
    n = len(v)
    radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
    low, high = float((np.diag(v) - radius).min()), float((np.diag(v) + radius).max())
    margin = 1e-3 * (high - low) + 1e-300
    low, high = low - margin, high + margin
    narrow = 64 * np.finfo(float).eps * max(abs(low), abs(high))
    out, todo = [], [(low, high, 0, n)]
    while todo:
        a, b, under_a, under_b = todo.pop()
        if under_b == under_a or n - under_b >= count:
            continue
        if under_b - under_a <= most or b - a <= narrow:
            out.append((a, b, under_b - under_a))
            continue
        middle = (a + b) / 2
        under = below(v, middle)
        todo += [(a, middle, under_a, under), (middle, b, under, under_b)]
    return sorted(out, reverse=True)


def feast(v: np.ndarray, a: float, b: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of a symmetric matrix in ``[a, b)``, by contour integration."""
    n = len(v)
    size = np.abs(v).sum(axis=1).max()
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 - nodes)
    width = min(n, 2 * count + 2)
    block = np.random.default_rng(seed).normal(size=(n, width))
    centre, radius = (a + b) / 2, (b - a) / 2
    # the circle is a little wider than the interval, so that no eigenvalue sits on it
    radius = max(1.05 * radius, 1e-14 * size)
    for turn in range(1, ROUNDS + 1):
        filtered = np.zeros((n, width))
        for x, w in zip(angle, weights, strict=True):
            z = centre + radius * np.exp(1j * x)
            solved = np.linalg.solve(z * np.eye(n) - v, block.astype(complex))
            filtered += w / 2 * (radius * np.exp(1j * x) * solved).real
        # directions that the filter has put out carry nothing but rounding
        u, s, _ = np.linalg.svd(filtered, full_matrices=False)
        basis = u[:, s > 1e-13 * max(s[0], 1e-300)]
        small = basis.T @ v @ basis
        values, turned = np.linalg.eigh((small + small.T) / 2)
        vectors = basis @ turned
        near = np.argsort(np.abs(values - centre), kind="stable")[:count]
        near = near[np.argsort(-values[near], kind="stable")]
        left = np.linalg.norm(v @ vectors[:, near] - vectors[:, near] * values[near], axis=0)
        inside = np.abs(values[near] - centre) <= radius + TOLERANCE * size
        if len(near) == count and inside.all() and left.max() <= TOLERANCE * size * np.sqrt(n):
            return values[near], vectors[:, near]
        # eigenvalues just outside the circle fade slowly; a wider block takes them along
        width = min(n, 2 * width) if turn % 4 == 0 else width
        block = np.concatenate([vectors, np.random.default_rng(seed + turn).normal(size=(n, width - vectors.shape[1]))], axis=1)
    raise ArithmeticError(f"the filter did not settle on {count} eigenvalues between {a} and {b}")


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors; the largest entry of a vector is positive.

    The number in each interval is checked against the inertia, so none is missed.
    """
    scale = np.abs(v).max() if v.size else 0.0
    if not scale > 0:
        return np.empty(0), np.empty((len(v), 0))
    v = v / scale
    found = [feast(v, a, b, k) for a, b, k in intervals(v, count)]
    # vectors of neighbouring intervals are made orthogonal together
    basis, _ = np.linalg.qr(np.concatenate([x for _, x in found], axis=1))
    values, turned = np.linalg.eigh(basis.T @ v @ basis)
    values, vectors = values[::-1][:count], (basis @ turned)[:, ::-1][:, :count]
    keep = values > LEAST * values[0]
    values, vectors = values[keep], vectors[:, keep]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values * scale, vectors * signs


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches and their vectors as integers, a bounded number of entries at a time."""
    rows = max(1, min(ROWS, BLOCK // width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(-1, width)


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for _, x in _matrices(batches, width):
            total += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "s"])

    return run


def _products(centre: np.ndarray):
    width = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, large = np.zeros((width, width), np.int64), np.zeros((width, width))
        for _, x in _matrices(batches, width):
            y = (x - centre).astype(float)
            part = y.T @ y
            if np.abs(y).max(initial=0) <= 1 << 20 and np.abs(total).max() < 1 << 61:
                total += part.astype(np.int64)
            else:
                large += part
        i = np.arange(width * width, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel()), pa.array(large.ravel())], ["i", "s", "f"])

    return run


def _whitened(n: int, sums: list[int], axes: np.ndarray):
    """``axes`` are unit vectors over the root of their eigenvalue."""
    width = len(sums)

    def deviations(y: np.ndarray) -> pa.Array:
        if float(np.abs(y).max(initial=0)) ** 2 * width < 2.0**62:
            y = y.astype(np.int64)
            return pa.array((y * y).sum(axis=1))
        exact = [sum(int(e) ** 2 for e in row) for row in y]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, dtype=object)
        narrow = max(map(abs, sums), default=0) < 1 << 62
        for part, x in _matrices(batches, width):
            if narrow and float(n) * max(1.0, float(np.abs(x).max(initial=0))) < 2.0**62:
                y = n * x - np.array(sums, np.int64)
            else:
                y = n * x.astype(object) - total
            w = (y.astype(float) / n) @ axes
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * axes.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key"), deviations(y), values], ["key", "deviation", "w"])

    return run


def _moments(width: int):
    """Sums of whitened values and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += w.sum(axis=0)
            products += w.T @ w
        both = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)], ["i", "s"])

    return run


def _gathered(parts: DataFrame, *columns: str) -> list[np.ndarray]:
    """Sums of the parts of all tasks, by place; as many numbers as a vector or a matrix has."""
    kind = lambda c: "decimal(38,0)" if parts.schema[c].dataType.simpleString() == "bigint" else "double"
    rows = parts.groupBy("i").agg(*[F.sum(F.col(c).cast(kind(c))).alias(c) for c in columns]).collect()
    rows.sort(key=lambda r: r.i)
    return [np.array([int(r[c]) if kind(c) != "double" else r[c] for r in rows], dtype=float if kind(c) == "double" else object) for c in columns]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, v)``: vectors as integers, those of the most common length."""
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.coalesce(fine, F.lit(False)))
    rows = rows.select("key", F.transform("v", lambda x: F.floor(x * SCALE) + SHIFT).alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (size.d if size else 0))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """Whitened vectors ``(key, deviation, w)`` and what they were made with.

    ``x = floor(64 c) + 1000000`` for every entry; means and covariance are over all usable vectors. ``w`` holds the
    centred ``x`` along each component over the root of its eigenvalue; ``deviation`` is the squared distance from the
    mean, times the square of their number. The second part has ``n``, ``values``, ``vectors``, ``explained`` (shares
    of all variance) and ``identity_error`` (largest entry of the covariance of ``w`` less the identity).
    """
    spark = vectors.sparkSession
    rows = settle(usable(vectors, key, vector), "integer-vectors")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, deviation bigint, w array<double>"
    first = rows.select(F.count(F.lit(1)).alias("n"), F.first(F.size("v")).alias("d")).first()
    n, width = first.n, first.d
    values, axes, trace = np.empty(0), np.empty((width or 0, 0)), 0.0
    if n:
        (sums,) = _gathered(rows.select("v").mapInArrow(_sums(width), "i int, s bigint"), "s")
        sums = [int(s) for s in sums]
        centre = np.array([round(s / n) for s in sums], np.int64)
        exact, large = _gathered(rows.select("v").mapInArrow(_products(centre), "i int, s bigint, f double"), "s", "f")
        rest = np.array([s - n * int(c) for s, c in zip(sums, centre.tolist(), strict=True)], dtype=object)
        second = exact.reshape(width, width) * n - np.outer(rest, rest)
        v = np.array([[e / (n * n) for e in row] for row in second.tolist()]) + large.reshape(width, width) / n
        v = (v + v.T) / 2
        values, axes = leading(v, min(components, width))
        trace = float(np.trace(v))
    made = {"n": n, "values": values, "vectors": axes, "explained": values / trace if trace else values, "identity_error": None}
    if not len(values):
        return spark.createDataFrame([], schema).withColumnRenamed("key", key), made
    out = settle(rows.mapInArrow(_whitened(n, sums, axes / np.sqrt(values)), schema), "whitened")
    k = len(values)
    (moments,) = _gathered(out.select("w").mapInArrow(_moments(k), "i int, s double"), "s")
    mean = moments[:k] / n
    spread = moments[k:].reshape(k, k) / n - np.outer(mean, mean)
    made["identity_error"] = float(np.abs(spread - np.eye(k)).max())
    return out.withColumnRenamed("key", key), made


def whitened_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``, one row for each vector and component."""
    out, made = whiten(vectors, key, vector, components)
    shares = F.array(*[F.lit(float(x)) for x in made["explained"]]).cast("array<double>")
    error = F.lit(made["identity_error"]).cast("double")
    out = out.select(key, "deviation", F.posexplode("w").alias("place", "whitened"))
    component = (F.col("place") + 1).cast("int")
    n = F.lit(made["n"]).cast("long")
    return out.select(
        key, component.alias("component"), n.alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), error.alias("identity_error")
    )
