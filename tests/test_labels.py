"""Classes, split, encodings and lookups, with pandas or plain Python as the other side."""

import datetime as dt


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postloom.operators import joins, labels, quantiles, selection
from postloom.operators.features import balanced_weights, one_hot, one_hot_vectors, standard_scale


def frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, v double")


CASES = {
    "ties": [1, 1, 1, 2, 2, 3, 5, 5, 8, 9, 9, 9, 10],
    "constant": [4.0] * 7,
    "few": [3.0, 1.0],
    "hot value": [7.0] * 400 + list(range(300)),
    "spread": np.random.default_rng(1).lognormal(0, 3, 3000).tolist(),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("limit", [200_000, 10])
def test_exact_quantiles(spark, name, limit):
    """The built-in percentile and the narrowing search agree with numpy."""
    values = CASES[name]
    probs = [0.0, 0.025, 0.2, 0.5, 0.8, 0.975, 1.0]
    got = quantiles.exact_quantiles(frame(spark, values), "v", probs, distinct_limit=limit)
    assert got == pytest.approx(list(np.quantile(values, probs)))


@pytest.mark.parametrize("n", [6, 21, 41, 1001])
def test_edges_on_values_stay_on_them(spark, n):
    """A quantile that falls on a value is that value to the last bit."""
    values = np.cumsum(np.random.default_rng(n).random(n) + 0.1)
    probs = [i / 20 for i in range(21)]
    for limit in (200_000, 3):
        got = quantiles.exact_quantiles(frame(spark, values), "v", probs, distinct_limit=limit)
        assert got == np.quantile(values, probs).tolist()


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(frame(spark, [None, None]), "v", [0.5]) is None


@pytest.mark.parametrize("name", ["ties", "hot value", "spread", "few"])
@pytest.mark.parametrize("q", [5, 20])
def test_quantile_class_is_qcut(spark, name, q):
    values = CASES[name]
    got = [r.c for r in quantiles.quantile_class(frame(spark, values), "v", q, "c").orderBy("id").collect()]
    assert got == pd.qcut(values, q, labels=False, duplicates="drop").tolist()


def test_equal_edges_can_be_refused(spark):
    with pytest.raises(ValueError):
        quantiles.bin_edges([1, 1, 2], "raise")


def posts(spark, rows):
    return spark.createDataFrame(rows, "post_id int, date date, referral_request boolean")


def test_split_is_by_date_of_requests(spark):
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i), i % 4 != 3) for i in range(40)]
    out = {r.post_id: (r.train, r.test) for r in labels.mark_train_test(posts(spark, rows)).collect()}
    asked = pd.Series(pd.to_datetime([d for _, d, a in rows if a]))
    cut = asked.quantile(0.8)
    for i, d, a in rows:
        assert out[i] == (a and pd.Timestamp(d) <= cut, a and pd.Timestamp(d) > cut)


def firm_posts(spark, spec):
    rows, i = [], 0
    for firm, train, n, pos in spec:
        for k in range(n):
            rows.append((i, firm, train, int(k < pos)))
            i += 1
    return spark.createDataFrame(rows, "post_id int, user_firm string, train boolean, class_offers int")


def encoded(spark, spec, **kw):
    out = labels.target_encoding(firm_posts(spark, spec), ["class_offers"], **kw).orderBy("post_id").collect()
    return {(r.user_firm, r.train): r.firm_prop_offers for r in out}


def test_target_encoding(spark):
    got = encoded(
        spark,
        [("Big", True, 12, 6), ("ex-Big", True, 3, 3), ("Tiny", True, 2, 1), ("Solo", True, 1, 1), ("Unseen", False, 4, 4), ("Big", False, 5, 5)],
    )
    pool = (3 + 1 + 1) / (3 + 2 + 1)  # rare spellings are pooled, rarity is counted on the name as written
    assert got == {
        ("Big", True): 0.5, ("ex-Big", True): 0.5, ("Tiny", True): pytest.approx(pool), ("Solo", True): pytest.approx(pool),
        ("Unseen", False): pytest.approx(pool), ("Big", False): 0.5,
    }


def test_encoding_without_rare_firms_falls_back_to_the_train_mean(spark):
    got = encoded(spark, [("A", True, 10, 5), ("B", True, 30, 3), ("C", False, 1, 1)])
    assert got[("C", False)] == pytest.approx(8 / 40)


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_lookup_equals_plain_join(spark, how):
    """A key with a third of all rows, on both ways of the lookup."""
    left = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    for rows in (1, 1000):
        out = joins.lookup_join(left, right, "k", how, ["row"], tasks=4, max_rows=rows)
        assert sorted(map(tuple, out.collect()), key=str) == plain


def test_salt_spreads_a_hot_key(spark):
    left = spark.range(4000).select("id", F.lit(1).alias("k"))
    right = spark.range(1).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.lookup_join(left, right, "k", "left", ["id"], tasks=16, max_rows=0, materialise=False)
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_joins_by_key(spark):
    texts = spark.createDataFrame([("b", None), ("a", "full")], "post_id string, full_text string")
    previews = spark.createDataFrame([("a", "pa"), ("b", "pb")], "post_id string, post_preview string")
    out = joins.fill_by_key(texts, previews, "post_id", "full_text", "post_preview")
    assert {r.post_id: r.full_text for r in out.collect()} == {"a": "full", "b": "pb"}
    assert [r.post_id for r in joins.repeated_keys(texts.union(texts.filter("post_id = 'a'")), "post_id").collect()] == ["a"]


@pytest.mark.parametrize("rows", [5, 100_000])
def test_stratified_split_is_exact(spark, rows):
    df = spark.range(1000).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    out = labels.stratified_split(df, "id", "y", 0.8, slice_rows=rows)
    assert {r.y: r.n for r in out.filter("fit").groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 640, 1: 160}
    again = labels.stratified_split(df.repartition(5), "id", "y", 0.8)
    assert out.exceptAll(again).count() == 0


def test_scaling_and_one_hot(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 5.0, "a", True), (2, 3.0, 5.0, "a", True), (3, 5.0, 5.0, "b", True), (4, 9.0, 6.0, "c", False)],
        "id int, x double, k double, c string, train boolean",
    )
    out = one_hot(standard_scale(df, ["x", "k"]), "c").orderBy("id").collect()
    s = np.std([1, 3, 5])
    assert [r.x for r in out] == pytest.approx([-2 / s, 0, 2 / s, 6 / s])
    assert [r.k for r in out] == [0, 0, 0, 1]  # a constant is only centred
    assert [(r["c_b"], "c_a" in r.asDict(), "c_c" in r.asDict()) for r in out] == [(0, False, False), (0, False, False), (1, False, False), (0, False, False)]


def test_balanced_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(12)], "id int, y int")
    out = balanced_weights(df, "y").groupBy("y").agg(F.sum("w").alias("s")).collect()
    assert [r.s for r in out] == pytest.approx([6, 6])


def test_group_share_without_windows(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)], "post_id int, firm string")
    out = labels.group_share(df, "firm", "post_id")
    assert {r.firm: r.pct_activity for r in out.collect()} == {"a": 0.75, "b": 0.25}
    assert "Window" not in out._jdf.queryExecution().toString()


def _jobs(spark, name, make):
    """How many jobs a computation starts."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        make()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("rows", [3, 100_000])
def test_folds_are_even_in_every_class(spark, rows):
    kinds = [0] * 50 + [1] * 7 + [None] * 11 + [2]
    df = spark.createDataFrame(list(enumerate(kinds)), "id int, y int")
    out = labels.stratified_folds(df, "id", "y", 5, slice_rows=rows)
    sizes = {}
    for r in out.collect():
        sizes.setdefault(r.y, [0] * 5)[r.fold] += 1
    assert {k: sum(v) for k, v in sizes.items()} == {0: 50, 1: 7, None: 11, 2: 1}
    assert all(max(v) - min(v) <= 1 for v in sizes.values())


def test_many_classes_take_no_more_jobs_than_few(spark):
    """A split of 100,000 classes, none of which passes through the driver."""
    df = spark.range(300_000).select("id", (F.col("id") % 100_000).alias("many"), (F.col("id") % 3).alias("few"))
    found = {}

    def split(label):
        found[label] = labels.stratified_split(df, "id", label, 0.5, slice_rows=1_000_000).groupBy(label, "fit").count().collect()

    few, many = (_jobs(spark, f"split-{c}", lambda c=c: split(c)) for c in ("few", "many"))
    assert many <= few + 2
    assert {(r["few"], r.fit): r["count"] for r in found["few"]} == {(c, f): 50_000 for c in range(3) for f in (True, False)}
    assert len(found["many"]) == 200_000 and {r["count"] for r in found["many"] if r.fit} == {2}


@pytest.mark.parametrize("pick", [2, 40, 10_000])
def test_quantiles_of_groups_against_numpy(spark, pick):
    rng = np.random.default_rng(pick)
    values = {"a": rng.normal(size=500), "b": rng.integers(0, 4, 300).astype(float), "c": np.array([7.0]), None: np.r_[np.zeros(200), 1e300, -1e300], "d": rng.geometric(0.01, 400) ** 3.0}
    df = spark.createDataFrame([(g, float(v)) for g, all_ in values.items() for v in all_], "g string, v double")
    probs = [0.0, 0.13, 0.5, 0.77, 1.0]
    found = {r.g: r.edges for r in selection.group_quantiles(df, ["g"], "v", probs, pick).collect()}
    assert found.keys() == values.keys()
    for g, all_ in values.items():
        assert found[g] == pytest.approx(np.quantile(all_, probs).tolist(), rel=1e-12)
    assert selection.group_quantiles(df.limit(0), ["g"], "v", probs, pick).count() == 0


def test_one_hot_of_any_number_of_categories(spark):
    rows = [(i, f"c{i % 1500}", True) for i in range(3000)] + [(3000, "c0", True), (3001, None, True), (3002, "new", False)]
    df = spark.createDataFrame(rows, "id int, c string, train boolean")
    with pytest.raises(ValueError):
        one_hot(df, "c")
    out = {r.id: r.features for r in one_hot_vectors(df, "c", "id").collect()}
    assert {v.size for v in out.values()} == {1499} and len(out) == 3003
    places = {f"c{i}": out[i].indices.tolist() for i in range(1500)}
    assert places["c0"] == [] and sorted(sum(places.values(), [])) == list(range(1499))
    assert out[1507].indices.tolist() == places["c7"] and not len(out[3001].indices) and not len(out[3002].indices)


def test_salts_follow_the_share_of_a_key(spark):
    """A key with a third of the rows gets many salts, one with a thousandth none, and only the first is copied."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 1000 == 1, -2).otherwise(F.col("id")).alias("k"))
    hot = {r._key: r._salts for r in joins.hot_keys(rows, ["k"], 60).collect()}
    first, second = spark.sql("SELECT xxhash64(-1L), xxhash64(-2L)").first()
    assert hot[first] == 20 and second not in hot and len(hot) == 1
    right = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = joins.spread_join(rows, right, ["k"], "left", ["id"], tasks=60)
    assert out.count() == 30_000 and out.filter("v is null or v <> k * 2").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_of_odd_keys(spark, how):
    """Null keys, keys of another type on the other side, several keys, and columns named like the join's own."""
    left = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3, "a" if i % 2 else None, i) for i in range(400)], "id int, k int, j string, n int")
    right = spark.createDataFrame([(k, j, float(k)) for k in (0, 1, 5_000_000_000) for j in ("a", "b")], "k long, j string, v double")
    want = sorted(map(tuple, left.join(right, ["k", "j"], how).select("id", "v").collect()), key=str)
    for by in ([], ["id"]):
        got = joins.spread_join(left, right, ["k", "j"], how, by, tasks=16)
        assert sorted(map(tuple, got.select("id", "v").collect()), key=str) == want
    assert joins.spread_join(left.limit(0), right, ["k", "j"], how).count() == 0
