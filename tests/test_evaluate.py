"""Metrics, calibration, bootstrap and reports."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postloom.operators import describe, evaluate, similarity
from postloom.operators.selection import group_quantiles


def scores(spark, rows, model="m", split="test"):
    df = spark.createDataFrame([(i, int(y), float(p), int(p >= 0.5)) for i, (y, p) in enumerate(rows)], "post_id int, y int, p double, pred int")
    return df.withColumn("model", F.lit(model)).withColumn("split", F.lit(split))


def pairwise(rows):
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])


RNG = np.random.default_rng(3)
RANDOM = [(int(y), float(np.round(p, 2))) for y, p in zip(RNG.integers(0, 2, 400), RNG.random(400))]


@pytest.mark.parametrize(
    "rows, area",
    [
        ([(0, 0.5), (1, 0.5), (1, 0.5)], 0.5),
        ([(0, 0.1), (0, 0.2), (1, 0.8)], 1.0),
        ([(1, 0.1), (0, 0.9)], 0.0),
        ([(1, 0.1), (1, 0.9)], None),
        (RANDOM, pairwise(RANDOM)),
    ],
)
def test_area(spark, rows, area):
    got = evaluate.auroc(scores(spark, rows), ["model"]).first().roc_auc
    assert got == (None if area is None else pytest.approx(area))


def test_area_across_many_stretches(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        both = scores(spark, RANDOM, "a").unionByName(scores(spark, [(1 - y, p) for y, p in RANDOM], "b"))
        got = {r.model: r.roc_auc for r in evaluate.auroc(both, ["model"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {"a": pytest.approx(pairwise(RANDOM)), "b": pytest.approx(1 - pairwise(RANDOM))}


def test_performance(spark):
    rows = [(1, 0.9), (1, 0.6), (1, 0.2), (0, 0.7), (0, 0.1), (0, 0.3), (0, 0.2)]
    r = evaluate.performance(scores(spark, rows)).first()
    assert (r.accuracy, r.precision, r.recall) == (0.714, 0.667, 0.667)
    assert r.f1_weighted == round((2 / 3) * 3 / 7 + 0.75 * 4 / 7, 3)


def test_no_positive_prediction(spark):
    r = evaluate.performance(scores(spark, [(1, 0.1), (0, 0.2)])).first()
    assert (r.precision, r.recall) == (0.0, 0.0)


def weights_of(spark, ids, b):
    seeds = spark.createDataFrame([(i,) for i in ids], "id int").select(evaluate.row_seed(F.col("id")).alias("s"))
    return evaluate.poisson_weights(np.array([r.s for r in seeds.collect()]), b)


def test_weights_look_like_draws(spark):
    w = weights_of(spark, range(2000), 50)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05


@pytest.mark.parametrize("hot", [False, True])
def test_bootstrap_replicates(spark, hot):
    """Each replicate equals the metrics of the weighted rows; a third of the rows may share one score."""
    rows = [(y, 0.5 if hot and i % 3 == 0 else p) for i, (y, p) in enumerate(RANDOM)]
    b = 8
    out = evaluate.bootstrap_replicates(scores(spark, rows), "post_id", ["model", "split"], b).collect()
    w = weights_of(spark, range(len(rows)), b)
    assert len(out) == b
    for r in out:
        drawn = [row for row, k in zip(rows, w[:, r.rep]) for _ in range(k)]
        assert r.roc_auc == pytest.approx(pairwise(drawn), abs=6e-4)
        assert r.accuracy == pytest.approx(np.mean([(p >= 0.5) == bool(y) for y, p in drawn]), abs=6e-4)


def test_bootstrap_ignores_partitions(spark):
    df = scores(spark, RANDOM)
    one, many = [
        sorted(map(tuple, evaluate.confidence_intervals(df.repartition(n), "post_id", replicates=5).collect())) for n in (1, 6)
    ]
    assert one == many and len(one) == 5


@pytest.mark.parametrize("limit", [200_000, 5])
def test_calibration(spark, limit, monkeypatch):
    from postloom.operators import selection

    monkeypatch.setattr(selection.group_quantiles, "__defaults__", (limit,))
    got = evaluate.calibration(scores(spark, RANDOM), ["model"]).orderBy("bin").collect()
    df = pd.DataFrame(RANDOM, columns=["y", "p"])
    df["bin"] = pd.qcut(df.p, 20, labels=False, duplicates="drop")
    want = df.groupby("bin").mean()
    assert [r.bin for r in got] == want.index.tolist()
    assert [r.model_prob for r in got] == pytest.approx(want.p.tolist())
    assert [r.true_label for r in got] == pytest.approx(want.y.tolist())


def test_class_report(spark):
    rows = {r.row: r for r in evaluate.class_report(scores(spark, [(1, 0.9), (1, 0.1), (0, 0.2)])).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].support) == (1.0, 0.5, 2)
    assert rows["macro avg"].recall == 0.75 and rows["weighted avg"].recall == pytest.approx(2 / 3)


def firms(spark, sizes, extra=()):
    rows = [(f"f{i}", k) for i, n in enumerate(sizes) for k in range(n)] + [(name, k) for name, n in extra for k in range(n)]
    return spark.createDataFrame([(i, f) for i, (f, _) in enumerate(rows)], "post_id int, user_firm string")


def gini(sizes):
    pct = np.sort(np.array(sizes)) / sum(sizes)
    equal = np.arange(1, len(sizes) + 1) / len(sizes)
    return (equal - pct.cumsum()).sum() / equal.sum()


@pytest.mark.parametrize("sizes", [[3] * 12, [1] * 20 + [2] * 5 + [4, 4, 4], list(range(1, 25))])
def test_gini_and_lorenz(spark, sizes):
    activity = describe.firm_activity(firms(spark, sizes, [("New", 2), ("ex-f0", 1)]))
    kept = activity.collect()
    assert "New" not in {r.firm for r in kept} and max(r.n for r in kept) <= 0.1 * (sum(sizes) + 3)
    row = describe.gini_coefficient(activity).first()
    assert row.firms == len(kept) and row.gini == pytest.approx(gini([r.n for r in kept]))
    curve = sorted((r.cum_firms, r.cum_pct, r.n) for r in describe.lorenz_curve(activity).collect())
    assert [c[0] for c in curve] == pytest.approx([(i + 1) / len(kept) for i in range(len(kept))])
    assert [c[1] for c in curve] == pytest.approx((np.cumsum(sorted(r.n for r in kept)) / sum(r.n for r in kept)).tolist())


def test_dominant_firm_is_left_out(spark):
    kept = describe.firm_activity(firms(spark, [50] + [1] * 40)).collect()
    assert len(kept) == 40


def test_weekly_counts_drop_partial_weeks(spark):
    df = spark.createDataFrame([(i, f"2024-01-{d:02d}") for i, d in enumerate([1, 8, 9, 15, 16, 16, 22])], "post_id int, d string")
    out = describe.weekly_counts(df.select("post_id", F.to_date("d").alias("date"))).orderBy("week").collect()
    assert [(str(r.week), r.requests) for r in out] == [("2024-01-08", 2), ("2024-01-15", 3)]


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(5,), (5,)], "num_views int")
    assert [(r.bin, r.n, r.percent) for r in describe.metric_distribution(df, "num_views").collect()] == [(1, 2, 100.0)]


def test_violations(spark):
    df = spark.createDataFrame([(1, None), (-2, "")], "n int, s string")
    out = describe.violations(df, {"range": F.col("n") >= 0, "filled": F.col("s") != ""})
    assert {r.check: r.n_bad for r in out.collect()} == {"range": 1, "filled": 2}


def test_most_similar_is_exact(spark):
    rng = np.random.default_rng(0)
    corpus, drafts = rng.normal(size=(300, 6)), rng.normal(size=(4, 6))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "post_id int, embedding array<float>").repartition(7)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drafts)], "query_id int, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.post_id for r in similarity.most_similar(q, c, 5).collect()}
    cosine = (drafts / np.linalg.norm(drafts, axis=1, keepdims=True)) @ (corpus / np.linalg.norm(corpus, axis=1, keepdims=True)).T
    assert got == {(i, k + 1): int(j) for i in range(4) for k, j in enumerate(np.argsort(-cosine[i])[:5])}
    blocks = {(r.query_id, r["rank"]): r.post_id for r in similarity.most_similar(q, c, 5, block=3).collect()}
    assert blocks == got
    assert similarity.most_similar(q.limit(0), c, 5).count() == 0


@pytest.mark.parametrize("limit", [1, 200_000])
def test_quantiles_of_groups_do_not_hang_on_size(spark, limit):
    """NaN and null are left aside, and groups of them alone have no row, at any size."""
    rows = [("a", float(i % 7)) for i in range(50)] + [("a", math.nan), ("a", None), ("b", None), ("c", math.nan), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, p double")
    found = {r.g: r.edges for r in group_quantiles(df, ["g"], "p", [0.0, 0.5, 1.0], pick_rows=limit).collect()}
    assert found == {"a": [0.0, 3.0, 6.0], None: [2.0, 3.0, 4.0]}


def test_the_worst_losses_count(spark):
    rows = [(1, "m", "s", 1, 1, 0.5), (2, "m", "s", 0, 0, 0.5), (3, "m", "s", 1, 0, 0.0)]
    df = spark.createDataFrame(rows, "k int, model string, split string, y int, pred int, p double")
    least = -math.log(2.0**-52)
    found = evaluate.monitoring(df).first()
    assert math.isclose(found.entropy, (math.log(2) + least) / 4 + math.log(2) / 2)
    assert math.isclose(found.true_pos_rate, 2 / 3)


def test_models_without_probabilities_have_intervals(spark):
    rows = [(i, m, "s", i % 2, (i // 3) % 2, None if m == "guess" else (i % 10) / 10) for i in range(200) for m in ("guess", "other")]
    df = spark.createDataFrame(rows, "k int, model string, split string, y int, pred int, p double")
    found = {(r.model, r.metric): (r.value, r.low, r.high) for r in evaluate.evaluate_all(df, "k", replicates=50).collect()}
    value, low, high = found[("guess", "accuracy")]
    assert low <= value <= high
    assert found[("guess", "roc_auc")] == (None, None, None)
    assert found[("other", "roc_auc")][1] is not None
