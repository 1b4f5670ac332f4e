import math
import random

import numpy as np
import pytest

from postloom.llm.vectors import linked, near_vectors


def rows(seed=4):
    rng = random.Random(seed)
    gauss = lambda n=6: [rng.gauss(0, 1) for _ in range(n)]
    base = gauss()
    out = [(i, i % 3, gauss()) for i in range(150)]
    out += [(200 + i, 1, [x + rng.gauss(0, 0.12) for x in base]) for i in range(60)]
    out += [(300 + i, i % 2, list(base)) for i in range(10)] + [(320, 1, [3 * x for x in base]), (321, 1, [-x for x in base])]
    out += [(330, None, list(base)), (331, 1, None), (332, 1, []), (333, 1, [0.0] * 6), (334, 1, [math.nan, *base[1:]]), (335, 1, [math.inf, *base[1:]])]
    out += [(336, 1, [None, *base[1:]]), (337, 1, base[:3]), (338, 1, base[:3]), (339, 1, [1e-30 * x for x in base]), (340, 2, [2.0]), (341, 2, [5.0]), (342, 2, [-5.0])]
    return out


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(table, threshold):
    links, group = {i: 0 for i, _, _ in table}, {i: i for i, _, _ in table}
    for a, la, va in table:
        for b, lb, vb in table:
            if a < b and la is not None and la == lb and usable(va) and usable(vb) and len(va) == len(vb):
                x, y = np.array(va, float) / np.abs(va).max(), np.array(vb, float) / np.abs(vb).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    old, new = max(group[a], group[b]), min(group[a], group[b])
                    group = {k: new if g == old else g for k, g in group.items()}
    return {i: (links[i], group[i]) for i in links}


@pytest.mark.parametrize("threshold, chunk, grid", [(0.98, 1024, 2), (0.98, 7, 1), (0.9, 16, 3)])
def test_links_of_all_pairs(spark, threshold, chunk, grid):
    table = [(i, label, v, 1, [0]) for i, label, v in rows()]
    vectors = spark.createDataFrame(table, "vec_id bigint, label int, embedding array<double>, node int, cell array<int>")
    found = near_vectors(vectors, threshold=threshold, chunk=chunk, grid=grid).collect()
    assert {r.vec_id: (r.n_links, r.component) for r in found} == plain(rows(), threshold)
    assert len(found) == len(table)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")).count() == 0


def test_dropping_by_tails_loses_no_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 64)) * np.linspace(3, 0.1, 64)
    x[150:] = x[:150] + rng.normal(size=(150, 64)) * 0.05
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    basis = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    exact = unit @ unit.T >= 0.98
    np.fill_diagonal(exact, False)
    assert (linked(x, basis, 300, 0.98) == exact).all()
    halves = linked(x, basis, 100, 0.98)
    assert (halves[:100, 100:] == exact[:100, 100:]).all() and not halves[:100, :100].any()
