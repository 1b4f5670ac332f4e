"""Whole jobs on a small forum: pages to posts, preparation, training, reports, a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postloom.functions.rules import offer_flag
from postloom.operators.coefficients import wald_table
from postloom.operators.describe import label_checks, post_checks, violations
from postloom.operators.features import assemble, balanced_weights, encode_text
from postloom.operators.models import Registry, fit_l1_logit, fit_plain_logit, search_l1_penalty
from postloom.plans import prepare, report, train
from postloom.sources import pages, tables
from postloom.streaming.labels import read_stream, stream_requests, write_stream

PAGE = """<html><body>
<article><div><a href="https://forum.example/post/first-1">x</a></div>
<div class="flex h-full items-center text-xs"><a>Google</a><span>ann</span><i>Yesterday</i></div>
<h2 class="a pointer-events-none">Need a referral &amp; help</h2><p class="pointer-events-none">Preview <b>one</b></p>
<div><button aria-label="Like this" data-count="3">l</button><button aria-label="Comment on this" data-count="2">c</button>
<button aria-label="Views" data-count="150">v</button></div></article>
<article><div><a href="/post/second-2">x</a></div>
<div class="h-full items-center text-xs"><a>ex-Meta</a><span>bob</span><i>Oct 14</i></div>
<h2 class="pointer-events-none">Hello</h2><p class="pointer-events-none">Second preview<br>and more</p>
<div><button aria-label="Like this" disabled>no</button></div>
<div><button aria-label="Like this">l</button><button aria-label="Views" data-count="9">v</button></div></article>
</body></html>"""


def test_pages_to_posts(spark):
    table = spark.createDataFrame([(1, PAGE), (2, "<html></html>"), (3, None)], "page_id int, html string")
    full = spark.createDataFrame([("second-2", None), ("first-1", "Please refer me\n#ml #jobs")], "post_id string, full_text string")
    out = prepare.posts_from_pages(table, full, "https://forum.example", "2024-11-17").orderBy("post_id").collect()
    a, b = out
    assert (a.post_id, a.user_firm, a.user_name, a.date) == ("first-1", "Google", "ann", dt.date(2024, 11, 16))
    assert (a.num_likes, a.num_comments, a.num_views, a.title) == (3, 2, 150, "Need a referral & help")
    assert (a.text, a.hashtags) == ("Please refer me\n", "#ml #jobs")
    assert a.combined == "[TITLE]\n\nNeed a referral & help\n\n\n[CONTENT]\n\nPlease refer me\n"
    # a missing text comes from the preview of the same post, whatever the order of the tables
    assert (b.post_id, b.text, b.num_likes, b.num_comments, b.num_views) == ("second-2", "Second preview", 0, 0, 9)
    assert b.date == dt.date(2024, 10, 14)
    posts = spark.createDataFrame(out)
    bad = violations(posts, post_checks(["post_id", "title", "text", "hashtags"], ["date", "num_likes"])).filter("n_bad > 0")
    assert bad.count() == 0


def forum(spark, n=160):
    rng = random.Random(11)
    asks = ["Need a referral please", "Can someone refer me to a role", "Looking for a referral", "Just a story about work"]
    posts, comments = [], []
    for i in range(n):
        good = rng.random() < 0.5
        text = rng.choice(asks) + (" with 5 years of experience in Oslo" if good else " asap i am desperate") + f" number {i}"
        posts.append(
            (f"p{i}", f"u{i}", rng.choice(["Google", "Meta", "ex-Meta", f"Firm{i}"]), dt.date(2024, 3, 1) + dt.timedelta(days=i),
             dt.date(2024, 11, 17), rng.randrange(4), 1, rng.randrange(900), "prev", "#a #b" if i % 2 else "", rng.choice(asks), text,
             f"[TITLE]\n\nasking\n\n\n[CONTENT]\n\n{text}")
        )
        for k in range(rng.randrange(3)):
            said = "dm me" if good and rng.random() < 0.8 else "sent dm"
            comments.append(("u", f"p{i}", f"c{i}-{k}", said, "Acme", None))
    return (
        spark.createDataFrame(posts, tables.POSTS),
        spark.createDataFrame(comments, tables.COMMENTS),
        spark.createDataFrame([(w,) for w in "need a referral please can someone refer me to role".split()], "word string"),
    )


def test_preparation_training_and_reports(spark, tmp_path):
    posts, comments, dictionary = forum(spark)
    out = str(tmp_path / "tables")
    gazetteer = spark.createDataFrame([("Oslo",)], "name string")
    prepare.prepare(posts, comments, dictionary, out, gazetteer)
    basic, masked, linguistic, flagged = [spark.read.parquet(f"{out}/{n}") for n in ("posts_basic", "posts_mask", "posts_linguistic", "comments")]

    assert basic.count() == masked.count() == linguistic.count() == 160
    counts = posts.select("post_id", "num_views", "num_likes", "num_comments")
    assert violations(basic.join(counts, "post_id"), label_checks()).filter("n_bad > 0").count() == 0
    assert masked.filter("combined_mask like '%[YEARS]%' and combined_mask like '%[GPE]%'").count() > 20
    assert any(c.startswith("below5_") for c in linguistic.columns)

    sets = train.feature_sets(basic, masked, linguistic)
    assert set(sets) == {"domain_full", "ngram", "bert_sent_base", "bertmix_sent_base"}
    registry = Registry(spark, str(tmp_path / "models"))
    scores = train.train(registry, {k: sets[k] for k in ("domain_full", "ngram")}, ["logit"])
    scores = scores.cache()
    assert {r.model for r in scores.select("model").distinct().collect()} == {"domain_full_logit", "ngram_logit", "domain_full_base", "baseline"}

    metrics = str(tmp_path / "metrics")
    curves = report.evaluate(scores, metrics, replicates=20)
    table = tables.read_metrics(spark, metrics, split="train", model="ngram_logit")
    got = {r.metric: r for r in table.collect()}
    assert got["roc_auc"].value > 0.7 and got["roc_auc"].low <= got["roc_auc"].value <= got["roc_auc"].high
    baseline = {r.metric: r.value for r in tables.read_metrics(spark, metrics, model="baseline").collect()}
    assert baseline["roc_auc"] is None
    assert curves["calibration"].count() > 0 and curves["class_report"].filter("model = 'baseline'").count() == 8

    plots = report.explore(posts, basic, flagged.withColumn("post_id", F.col("comment_id")))
    assert plots["weekly_requests"].count() > 5 and plots["gini_requests"].first().firms > 0


def test_mixed_feature_set(spark):
    posts, comments, _ = forum(spark, 60)
    _, basic = prepare.label_posts(posts, comments)
    vectors = encode_text(posts, "post_id", "text", size=16)
    out = train.mixed_features(basic.filter("referral_request"), vectors).first()
    assert len(out.features) == 16 + 2 + 6


def separable(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(4)]
        rows.append((i, int(1.5 * x[0] - x[1] + rng.gauss(0, 1) > 0), *x))
    return assemble(spark.createDataFrame(rows, "post_id int, y int, a double, b double, c double, d double"), ["a", "b", "c", "d"])


def test_models(spark):
    rows = separable(spark).cache()
    plain = fit_plain_logit(rows, "y").stages[-1].coefficients
    assert plain[0] > 1 and plain[1] < -0.5 and abs(plain[2]) < 0.4
    sparse = fit_l1_logit(rows, "y", c=0.01).stages[-1].coefficients
    assert sparse[2] == sparse[3] == 0 and sparse[0] > 0
    best, table = search_l1_penalty(rows, "y", "post_id", grid=[0.0005, 1.0], folds=3)
    assert best == 1.0 and table.count() == 2
    weighted = balanced_weights(rows, "y")
    wald = wald_table(weighted, fit_plain_logit(rows, "y"), ["a", "b", "c", "d"]).collect()
    assert {r.names for r in wald if r.statsig} == {"a", "b"} and wald[0].names == "a"


def test_encoder_batches(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "post_id int, t string")
    out = {r.post_id: r.embedding for r in encode_text(docs, "post_id", "t", encoder=lambda ts: [[3.0, 4.0] if t else [0.0, 0.0] for t in ts]).collect()}
    assert out[1] == pytest.approx([0.6, 0.8]) and out[2] == [0.0, 0.0]


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([("a", 'said "hi",\nthen left'), ("b", None)], tables.POSTS_FULLTEXT)
    tables.write_csv(df, str(tmp_path / "x"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "x"), tables.POSTS_FULLTEXT).collect())) == sorted(map(tuple, df.collect()))


def test_request_flags_on_a_stream(spark, tmp_path):
    posts = spark.createDataFrame([("a", "Need a referral", "x"), ("b", "Hi", "y")], "post_id string, title string, text string")
    posts.write.parquet(str(tmp_path / "in"))
    stream = stream_requests(read_stream(spark, str(tmp_path / "in"), posts.schema.simpleString()[7:-1].replace(":", " ")))
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    out = {r.post_id: r.referral_request for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {"a": True, "b": False}


@pytest.mark.parametrize("files", [0, 3])
def test_streamed_table_is_a_file_or_a_folder(spark, sf, tmp_path, files):
    """A table of one file and one of several give the same flags."""
    import shutil

    from __spark_entry__ import queries

    if files:
        tables.read_table(spark, sf, "conversations").repartition(files).write.parquet(str(tmp_path / "conversations.parquet"))
    else:
        shutil.copy(f"{sf}/conversations.parquet", tmp_path / "conversations.parquet")
    out = queries()["streamed_offer_flags"](spark, str(tmp_path))
    assert out.count() == out.select("comment_id").distinct().count() == tables.read_table(spark, sf, "conversations").count()


def test_flags_are_one_projection(spark, sf):
    """No shuffle and no Python for the flags; only needed columns are read."""
    turns = tables.read_table(spark, sf, "conversations")
    plan = turns.select("conv_id", offer_flag(F.col("text")).alias("f"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "role" not in plan.split("ReadSchema")[-1]


def test_shared_dir_is_read_from_the_session(spark):
    from postloom.session import scratch_path

    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_worker_functions_need_no_installed_package(tmp_path):
    """Functions for Python workers load in a process that cannot import the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from postloom.operators.evaluate import _partial_sums
    from postloom.sources.pages import _page_rows

    body = cloudpickle.dumps((_partial_sums(["m"], 2), _page_rows))
    code = "import pickle, sys; f, g = pickle.loads(sys.stdin.buffer.read()); list(f(iter([]))); print(len(g(sys.argv[1])))"
    out = subprocess.run([sys.executable, "-c", code, PAGE], input=body, cwd=tmp_path, capture_output=True, env={}, timeout=120)
    assert out.stdout.strip() == b"2", out.stderr.decode()[-500:]
