"""The path of L1 penalties against a plain solver, one model at a time."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors

from postloom.operators import penalty as p
from postloom.operators.models import search_l1_penalty


def table(spark, x, y, sparse=False):
    width = x.shape[1]
    vector = (lambda v: SparseVector(width, {i: float(e) for i, e in enumerate(v) if e})) if sparse else Vectors.dense
    return spark.createDataFrame([(i, int(t), vector(v)) for i, (v, t) in enumerate(zip(x, y))], ["id", "t", "features"])


def made(kind, n=240, width=30, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    if kind == "sparse":
        x = np.where(rng.random((n, width)) < 0.1, np.abs(x), 0.0)
    z = 2.5 * x[:, 0] - 2 * x[:, 1] + x[:, 2] - 0.8
    return x, (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)


def plain(x, y, w, c, rounds=30000):
    """Accelerated proximal steps with a restart, in one process."""
    a = np.c_[x, np.ones(len(x))]
    size = np.linalg.eigvalsh((a * w[:, None]).T @ a)[-1] / 4
    b = ahead = np.zeros(a.shape[1])
    pace = 1.0
    for _ in range(rounds):
        moved = ahead - a.T @ (w * (1 / (1 + np.exp(-a @ ahead)) - y)) / size
        new = moved.copy()
        new[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - 1 / (c * size), 0)
        if np.abs(new - b).max() < 1e-13:
            break
        back = (ahead - new) @ (new - b) > 0
        then = 1.0 if back else (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = new + (0 if back else (pace - 1) / then) * (new - b)
        b, pace = new, then
    return b


def held(found):
    rows = found.rows.toPandas()
    x = np.zeros((len(rows), found.width))
    for i, r in rows.reset_index(drop=True).iterrows():
        x[i, range(found.width) if r.plain else r["indices"]] = r["values"]
    return x, rows.y.to_numpy(), rows.w.to_numpy(), rows.fold.to_numpy()


def area(z, y):
    up, down = z[y == 1], z[y == 0]
    return np.mean((up[:, None] > down) + (up[:, None] == down) / 2)


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_every_model_of_the_path(spark, kind):
    x, y = made(kind)
    grid = [0.001, 0.02, 0.05, 0.3]
    best, scores, path, found = p.search(table(spark, x, y, kind == "sparse"), "t", "id", grid, folds=3, tolerance=1e-6)
    x, y, w, fold = held(found)
    coefs = {}
    for c, f, i, v in path.entries:
        coefs.setdefault((c, f), np.zeros(found.width + 1))[i] = v
    exact = {}
    for c in grid:
        for f in range(3):
            out = fold != f
            want = plain(x[out], y[out], w[out], c)
            assert np.abs(coefs[c, f] - want).max() < 1e-4
            exact[c, f] = area(x[~out] @ coefs[c, f][:-1], y[~out])
    facts = {(r.c, r.fold): r for r in scores.collect()}
    assert facts.keys() == exact.keys()
    assert all(abs(facts[k].auroc - exact[k]) <= facts[k].slack + 1e-12 and facts[k].violation <= 1e-6 * 1.01 for k in exact)
    means = {c: np.mean([exact[c, f] for f in range(3)]) for c in grid}
    assert best == max(grid, key=lambda c: (means[c], -c))
    assert facts[0.001, 0].n_features == 0 and facts[0.001, 0].auroc == 0.5
    assert all(facts[best, f].slack == 0 for f in range(3))


def test_screening_changes_no_result(spark):
    """A path in one block without screening, and in many blocks with it."""
    x, y = made("sparse", width=60, seed=5)
    found = p.prepared(table(spark, x, y, True), "t", "id", 2)
    grid = np.geomspace(0.05, 0.6, 5)
    paths = [p.penalty_path(found, grid, 2, ratio, 1e-6) for ratio in (1.8, 1e9)]
    one, many = ({(c, f, i): v for c, f, i, v in path.entries} for path in paths)
    for k in one.keys() | many.keys():
        assert abs(one.get(k, 0) - many.get(k, 0)) < 1e-4


def test_wide_sums_take_the_same_values_by_many_partitions(spark):
    x, y = made("dense")
    one = p.prepared(table(spark, x, y), "t", "id", 2)
    many = p.Table(one.rows.repartition(p.PLAIN_PARTS + 3), one.n, one.width)
    assert not many.few
    a, b = (p.gradients(t, np.array([0, 3]), np.full((3, 2), 0.1), np.array([0, 1]), every=True) for t in (one, many))
    assert np.allclose(a, b) and a.shape == (31, 2)


def test_one_model_on_all_rows(spark):
    x, y = made("dense", n=400)
    found = p.prepared(table(spark, x, y), "t", "id", 0)
    x, y, w, _ = held(found)
    for c in (0.2, None):
        coefs, intercept = p.fit_one(found, c, 1e-7)
        assert np.abs(np.r_[coefs, intercept] - plain(x, y, w, c or 1e12)).max() < 1e-4


def test_odd_tables(spark):
    x, y = made("dense", n=40, width=3)
    same = table(spark, x, np.ones(40))
    best, scores = search_l1_penalty(same, "t", "id", [0.1, 1.0], folds=2)
    assert best is None and scores.count() == 2
    best, scores = search_l1_penalty(same.limit(0), "t", "id", [0.1], folds=2)
    assert best is None
    ties = table(spark, np.repeat(x, 3, axis=0) * 0 + 1.0, np.repeat(y, 3))
    best, scores = search_l1_penalty(ties, "t", "id", [0.1, 1.0], folds=2)
    assert best == 0.1 and {r.auroc for r in scores.collect()} == {0.5}


def test_counts_of_scores_stay_on_the_executors(spark, monkeypatch):
    """No pass over the table hands an array on that is as long as the bins of a score."""
    from postloom.operators import penalty

    rng = np.random.default_rng(5)
    rows = [(i, int(v[0] + rng.normal() > 0), Vectors.dense(v)) for i, v in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, ["post_id", "t", "features"])
    sent, sums = [], penalty.Table.sums
    monkeypatch.setattr(penalty.Table, "sums", lambda *a, **k: sent.append(sums(*a, **k)) or sent[-1])
    found = penalty.penalty_path(penalty.prepared(df, "t", "post_id", 2), [0.1, 1.0], 2)
    assert len(found.facts) == 4 and all(0.5 < f[4] <= 1 for f in found.facts)
    assert max(v.size for s in sent for v in s.values()) < penalty.BINS


@pytest.mark.parametrize(("kind", "c", "working"), [("dense", 0.2, p.WORKING), ("sparse", 1.0, 20)])
def test_wide_model_meets_every_condition(spark, kind, c, working):
    x, y = made(kind, 300, 120)
    x[:, 7] = x[:, 5]  # equal features
    found = p.prepared(table(spark, x, y, kind == "sparse"), "t", "id", 0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    coefs, intercept = p.fit_wide(found, c, working=working)
    r = w * (1 / (1 + np.exp(-x @ coefs - intercept)) - y)
    assert p.violation(coefs, x.T @ r, np.full(120, 1 / c)).max() < 2e-8 / c and abs(r.sum()) < 2e-8 / c
    expected, near = plain(x, y, w, c), np.setdiff1d(np.arange(120), [5, 7])
    assert np.allclose(coefs[near], expected[near], atol=1e-5)
    assert np.isclose(coefs[5] + coefs[7], expected[5] + expected[7], atol=1e-5)


def test_only_texts_with_a_label_become_vectors(spark, tmp_path, monkeypatch):
    """The join with the labels drops all others, so their vectors are not made; the vocabulary is that of all English texts."""
    from postloom.catalog import features

    docs = [(i, f"w{i % 3} common w{i % 5}", "en", "s", 9) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, 12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, made = [], features.text_vectors

    def spied(docs, vocabulary, *rest):
        seen.append((docs.count(), {r.term: r.df for r in vocabulary.table.collect()}))
        return made(docs, vocabulary, *rest)

    monkeypatch.setattr(features, "text_vectors", spied)
    features.ranked_term_coefficients(spark, str(tmp_path)).collect()
    assert seen[0][0] == 12 and seen[0][1]["w0"] == 14 + 8 - 3
