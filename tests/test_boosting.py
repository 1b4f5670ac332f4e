"""Boosted trees against a plain version that looks at every cut, and their way to disk and back."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from postloom.operators import boosting as b
from postloom.operators.models import Registry, fit_boosted, score


def table(spark, x, y, sparse=False):
    width = x.shape[1]
    vector = (lambda v: SparseVector(width, {i: float(e) for i, e in enumerate(v) if e})) if sparse else Vectors.dense
    return spark.createDataFrame([(i, int(t), vector(v)) for i, (v, t) in enumerate(zip(x, y))], ["post_id", "t", "features"])


def made(sparse=False, n=300, width=6, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    if sparse:
        x = np.where(rng.random((n, width)) < 0.4, x, 0.0)
    z = 2 * (x[:, 0] > 0.3) - 2 * (x[:, 1] * x[:, 2] > 0.2) + x[:, 3]
    return x, (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)


def plain(x, y, edges, s):
    """Probabilities of the train rows, by recursion over rows."""
    w = len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    soft = lambda g: np.sign(g) * max(abs(g) - s.alpha, 0)
    worth = lambda g, h: soft(g) ** 2 / (h + s.ridge)
    margin = np.zeros(len(y))
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        add = np.zeros(len(y))

        def split(at, depth):
            best = (b.LEAST_GAIN, None, None)
            if depth:
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left = at & (x[:, f] <= e)
                        right = at & ~left
                        if h[left].sum() >= s.child_weight and h[right].sum() >= s.child_weight:
                            gain = round((worth(g[left].sum(), h[left].sum()) + worth(g[right].sum(), h[right].sum()) - worth(g[at].sum(), h[at].sum())) / 2, 10)
                            if gain > best[0]:
                                best = (gain, f, e)
            if best[1] is None:
                add[at] = -s.rate * soft(g[at].sum()) / (h[at].sum() + s.ridge)
                return
            split(at & (x[:, best[1]] <= best[2]), depth - 1)
            split(at & (x[:, best[1]] > best[2]), depth - 1)

        split(np.ones(len(y), bool), s.depth)
        margin += add
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("sparse, small", [(False, 4_000_000), (True, 4_000_000), (True, 0)])
def test_every_tree(spark, monkeypatch, sparse, small):
    """In one task, and by sums over many."""
    monkeypatch.setattr(b, "SMALL", small)
    x, y = made(sparse)
    s = b.Settings(trees=4 if small else 2, depth=3, rate=0.3, rows=1.0, columns=1.0, bins=16)
    df = table(spark, x, y, sparse).repartition(5)
    model = b.fit_trees(df, "t", "post_id", s)
    got = {r.post_id: r.p for r in score(model, df, ["post_id"]).collect()}
    assert np.allclose([got[i] for i in range(len(y))], plain(x, y, model.edges, s), atol=1e-9)


def test_one_task_and_many_tasks_grow_the_same_trees(spark, monkeypatch):
    x, y = made()
    s = b.Settings(trees=3, depth=2, rate=0.3, bins=8)
    models = []
    for small in (4_000_000, 0):
        monkeypatch.setattr(b, "SMALL", small)
        models.append(b.fit_trees(table(spark, x, y).repartition(3), "t", "post_id", s))
    for one, two in zip(*(m.trees for m in models), strict=True):
        assert (one.feature == two.feature).all() and (one.cut == two.cut).all() and np.allclose(one.value, two.value)


def test_ranking_is_that_of_first_order_trees_or_better(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    x, y = made(n=600)
    train, rest = table(spark, x[:400], y[:400]), table(spark, x[400:], y[400:])
    model = fit_boosted(train, "t", trees=30, rate=0.1)
    first = GBTClassifier(labelCol="t", maxIter=30, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=5, seed=1).fit(train)

    def area(rows):
        z, t = np.array([r.p for r in rows]), np.array([r.t for r in rows])
        return np.mean((z[t == 1][:, None] > z[t == 0]) + (z[t == 1][:, None] == z[t == 0]) / 2)

    ours = area(score(model, rest, ["post_id", "t"]).collect())
    theirs = area(first.transform(rest).select("t", vector_to_array("probability")[1].alias("p"), F.lit(0)).collect())
    assert ours >= theirs


def test_saved_and_loaded(spark, tmp_path):
    x, y = made()
    df = table(spark, x, y)
    registry = Registry(spark, str(tmp_path))
    model = fit_boosted(df, "t", trees=3)
    registry.save_features("set", df)
    registry.save_model("set_xgb", "set", model)
    loaded, features = registry.load("set_xgb")
    one, two = (sorted(map(tuple, score(m, features, ["post_id"]).collect())) for m in (model, loaded))
    assert one == two and len(one) == 300


def test_odd_tables(spark):
    x, y = made()
    none = fit_boosted(table(spark, x, y).limit(0), "t", trees=2)
    assert none.trees == []
    same = fit_boosted(table(spark, x * 0, y), "t", trees=2)
    (only,) = {r.p for r in score(same, table(spark, x * 0, y), ["post_id"]).collect()}
    assert abs(only - 0.5) < 0.01
    rows = table(spark, x, y)
    far = score(fit_boosted(rows, "t", trees=2), table(spark, x * 1e300, y), ["post_id"])
    assert far.count() == 300


def test_samples_have_their_share():
    h = np.arange(20000, dtype=np.int64) * 7919
    taken = [b.drawn(h, t, 42, 0.8) for t in range(2)]
    assert all(abs(t.mean() - 0.8) < 0.02 for t in taken) and (taken[0] != taken[1]).any()
    assert b.drawn_columns(10, 1, 42, 0.8).sum() == 8 and b.drawn_columns(1, 1, 42, 0.5).sum() == 1


def test_edges_are_exact_quantiles(spark):
    """Bins of a table beyond the accuracy of a sketch, with a feature that is absent in places."""
    n, bins = 40_000, 8
    rows = spark.range(n, numPartitions=8).select(
        F.expr("pmod(xxhash64(id), 1000003) / 1000d").alias("a"), F.expr("case when id % 3 > 0 then pmod(xxhash64(id, 7), 50021) / 100d end").alias("b")
    )
    parts = rows.selectExpr(
        "named_struct('type', cast(0 as tinyint), 'size', 2, 'indices', if(b is null, array(0), array(0, 1)), 'values', if(b is null, array(a), array(a, b))) as features"
    )
    found = b.quantile_edges(parts, 2, bins)
    for i, name in enumerate("ab"):
        v = np.sort([r[0] for r in rows.select(name).filter(f"{name} is not null").collect()])
        exact = [v[-(-k * len(v) // bins) - 1] for k in range(1, bins)]
        assert list(found[i]) == sorted({*exact, *([0.0] if len(v) < n else [])})


@pytest.mark.parametrize("stretch", [b.STRETCH, 1])
def test_only_best_cuts_reach_the_driver(spark, monkeypatch, stretch):
    """Passes over a large table hand on eight numbers for each node and stretch; the trees are those of one task."""
    x, y = made()
    df = table(spark, x, y)
    model = lambda: fit_boosted(df, "t", trees=2, depth=3)
    expected = model()
    sent, sums = [], b.Table.sums
    monkeypatch.setattr(b, "SMALL", 0)
    monkeypatch.setattr(b, "STRETCH", stretch)
    monkeypatch.setattr(b.Table, "sums", lambda *a, **k: sent.append(sums(*a, **k)) or sent[-1])
    found = model()
    assert sent and max(v.size for s in sent for v in s.values()) <= 8 * 4
    for a, c in zip(expected.trees, found.trees, strict=True):
        assert list(a.feature) == list(c.feature) and list(a.cut) == list(c.cut) and np.allclose(a.value, c.value, atol=1e-12)


def test_dense_rows_are_read_as_a_matrix():
    """Whole dense batches give the trees of the same rows with places, without a look at single entries."""
    rng = np.random.default_rng(3)
    n, width, bins = 700, 6, 9
    held = rng.integers(0, bins, (n, width)).astype(np.int16)
    y = (held[:, 2] + held[:, 4] + rng.integers(0, 4, n) > 9).astype(np.int32)
    lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(v, kind))
    columns = [pa.array(np.arange(n) * 7919), pa.array(y), pa.array(np.ones(n)), pa.array(np.zeros(n))]
    names = ["h", "y", "w", "margin", "indices", "bins"]
    dense = pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(pa.int32())), lists(held.ravel(), pa.int16())], names)
    sparse = pa.RecordBatch.from_arrays([*columns, lists(np.tile(np.arange(width), n), pa.int32()), lists(held.ravel(), pa.int16())], names)
    zero, n_bins = np.full(width, 3), np.full(width, bins)
    one, other = b.Bins(dense, zero), b.Bins(sparse, zero)
    assert one.dense is not None and other.dense is None
    assert np.array_equal(one.of(np.array([1, 4])), other.of(np.array([1, 4]))) and np.array_equal(one.of(np.array([4])), held[:, [4]])
    s = b.Settings(trees=12, child_weight=1.0)
    one, other = (b._boosted(b.Held([x], width), zero, n_bins, s) for x in (dense, sparse))
    assert any((t.feature >= 0).any() for t in one)
    for t, u in zip(one, other, strict=True):
        assert np.array_equal(t.feature, u.feature) and np.array_equal(t.cut, u.cut) and np.allclose(t.value, u.value, rtol=1e-9)
    # a dense batch with a row that is too short is not a matrix
    short = pa.RecordBatch.from_arrays([*[c.slice(0, 2) for c in columns], pa.nulls(2, pa.list_(pa.int32())), pa.array([[1] * 6, [1] * 5], pa.list_(pa.int16()))], names)
    assert b.Bins(short, zero).dense is None
