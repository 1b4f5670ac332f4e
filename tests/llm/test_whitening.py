import math
import random

import numpy as np
import pytest

from postloom.llm.catalog import op11_feast_whitening
from postloom.llm.whitening import below, feast, intervals, leading, whiten, whitened_rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, component int, w string"


def plain(rows):
    """Integers of the usable rows, exact sums, and eigenpairs by the library."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) and abs(x) < 2**40 for x in v)]
    sizes = {}
    for _, v in kept:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    width = max(sizes, key=lambda d: (sizes[d], d))
    kept = [(i, v) for i, v in kept if len(v) == width]
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in kept]
    n = len(x)
    sums = [sum(row[j] for row in x) for j in range(width)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return [i for i, _ in kept], deviation, y, v, e[::-1], u[:, ::-1]


def check(found, rows, components):
    ids, deviation, y, v, e, u = plain(rows)
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    assert len(found) == len(ids) * k
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        mine = sorted(by[c], key=lambda r: (r.vec_id is not None, r.vec_id, r.deviation, r.whitened))
        want = y @ u[:, c - 1] / math.sqrt(e[c - 1])
        assert [r.n for r in mine] == [len(ids)] * len(ids)
        assert math.isclose(mine[0].explained, e[c - 1] / np.trace(v), rel_tol=1e-9)
        assert mine[0].identity_error < 1e-9
        if len(set(ids)) == len(ids):
            mine.sort(key=lambda r: ids.index(r.vec_id))
            got = np.array([r.whitened for r in mine])
            assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
            assert [r.deviation for r in mine] == deviation


def gauss(n, width, seed, spread=0.2):
    rng = random.Random(seed)
    scale = [spread * 0.9**j for j in range(width)]
    return [(i, [rng.gauss(0.3, s) for s in scale]) for i in range(n)]


@pytest.mark.parametrize("n, width, components", [(400, 8, 4), (300, 40, 32), (5, 3, 32), (2, 4, 3)])
def test_against_the_library(spark, n, width, components):
    rows = gauss(n, width, n)
    rows += [(9000, None), (9001, []), (9002, [math.nan] * width), (9003, [None] * width), (9004, [math.inf] * width), (9005, [1.0] * (width + 1)), (9006, [1e30] * width)]
    table = spark.createDataFrame([(i, v, 1, 3, "w") for i, v in rows], SCHEMA)
    check(whitened_rows(table, components=components).collect(), rows, components)


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = op11_feast_whitening(spark, sf).collect()
    check(found, rows, 32)


def test_null_and_repeated_keys(spark):
    rows = [(None, v) for _, v in gauss(30, 4, 1)] + [(7, v) for _, v in gauss(30, 4, 2)] * 2
    table = spark.createDataFrame([(i, v, 1, 3, "w") for i, v in rows], SCHEMA)
    found = whitened_rows(table).collect()
    assert len(found) == 90 * 4
    w = np.array([r.whitened for r in sorted(found, key=lambda r: r.component)]).reshape(4, -1)
    assert np.allclose((w**2).mean(axis=1), 1)


def test_no_spread_and_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(5)]):
        table = spark.createDataFrame([(i, v, 1, 3, "w") for i, v in rows], SCHEMA)
        assert whitened_rows(table).collect() == []


def test_far_entries_stay_exact(spark):
    """Sums of products that no double holds, and deviations beyond a long."""
    rows = [(i, [float(2**30 * (i % 3)), float(i)]) for i in range(50)]
    table = spark.createDataFrame([(i, v, 1, 3, "w") for i, v in rows], SCHEMA)
    out, made = whiten(table)
    _, deviation, _, _, e, _ = plain(rows)
    assert np.allclose(made["values"], e[:1] if len(made["values"]) == 1 else e, rtol=1e-9)
    got = {r.vec_id: r.deviation for r in out.collect()}
    assert all(got[i] == (d if d < 2**63 else None) for (i, _), d in zip(rows, deviation))


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 50, 30), np.geomspace(1e-6, 1e3, 24), np.r_[np.ones(20), 5.0, 5.0, 5.0], np.r_[np.zeros(10), 1, 2, 3], np.ones(9), np.r_[1.0, 1 + 1e-9, 2, 2 + 1e-13]],
)
def test_spectra_with_ties_clusters_and_zeros(values):
    v = symmetric(np.asarray(values, float), 3)
    v = (v + v.T) / 2
    want = np.sort(values)[::-1]
    found, vectors = leading(v, len(values))
    keep = want > 1e-12 * want[0]
    assert len(found) == keep.sum() and np.allclose(found, want[keep], rtol=1e-9, atol=1e-12 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-10)
    assert np.allclose(v @ vectors, vectors * found, atol=1e-11 * want[0])


def test_inertia_counts_every_eigenvalue():
    v = symmetric(np.r_[np.linspace(-3, 3, 13), 2.0, 2.0], 5)
    v = (v + v.T) / 2
    e = np.linalg.eigvalsh(v)
    for sigma in np.linspace(-4, 4, 37) + 0.0123:
        assert below(v, sigma) == (e < sigma).sum()
    parts = intervals(v, 6)
    assert sum(k for _, _, k in parts) >= 6
    for a, b, k in parts:
        values, _ = feast(v, a, b, k)
        assert len(values) == ((e >= a) & (e < b)).sum()
    hollow = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert below(hollow, 0.0) == 1
