"""Evaluation of scores, and descriptive reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.catalog.base import METRICS_SQL
from postloom.catalog.common import SCORES, Book, r, score_rows, table
from postloom.catalog.labels import bin_sql, edges_sql
from postloom.operators import evaluate
from postloom.operators.describe import (
    firm_activity,
    gini_coefficient,
    lorenz_curve,
    metric_distribution,
    weekly_counts,
)
from postloom.operators.similarity import (
    improvement_by_initial,
    relate_probabilities,
    revision_effect,
    revision_histogram,
)

BOOK = Book()
BY = ["model", "split"]


@BOOK.add(
    f"""WITH {SCORES} SELECT model, split, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y <> 1 AND pred = 1) AS fp,
        count(*) FILTER (y = 1 AND pred <> 1) AS fn, count(*) FILTER (y <> 1 AND pred <> 1) AS tn FROM scores GROUP BY 1, 2"""
)
def confusion_counts(spark, d):
    return evaluate.confusion_counts(score_rows(spark, d), BY)


@BOOK.add(f"WITH {SCORES}, {METRICS_SQL} SELECT * FROM metrics")
def performance_metrics(spark, d):
    return evaluate.performance(score_rows(spark, d))


_AREA = """ranked AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS rk FROM t)
  SELECT k AS l_linestatus, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))::DOUBLE, 9)::DOUBLE AS roc_auc FROM ranked GROUP BY k"""


@BOOK.add(
    f"""WITH t AS (SELECT l_linestatus AS k, (l_returnflag = 'R')::INTEGER AS y, round(l_extendedprice / 100, 0) AS p FROM lineitem), {_AREA}"""
)
def area_under_curve(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(F.col("l_extendedprice") / 100, 0).alias("p")
    )
    return evaluate.auroc(rows, ["l_linestatus"]).withColumn("roc_auc", F.round("roc_auc", 9))


_REPORT = """cells AS (SELECT model, split, c, count(*) FILTER (y = c AND pred = c)::DOUBLE AS hit, count(*) FILTER (pred = c)::DOUBLE AS said,
    count(*) FILTER (y = c) AS support FROM scores, (VALUES (0), (1)) v(c) GROUP BY 1, 2, 3),
  per AS (SELECT model, split, c::VARCHAR AS "row", CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, CASE WHEN said + support > 0 THEN 2 * hit / (said + support) ELSE 0 END AS f1, support FROM cells),
  all_rows AS (SELECT * FROM per UNION ALL SELECT model, split, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per GROUP BY 1, 2
    UNION ALL SELECT model, split, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per GROUP BY 1, 2)"""


@BOOK.add(
    f"""WITH {SCORES}, {_REPORT} SELECT model, split, "row", round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support FROM all_rows"""
)
def class_report(spark, d):
    out = evaluate.class_report(score_rows(spark, d))
    return out.withColumns({c: r(c) for c in ("precision", "recall", "f1")})


_EDGES = """e AS (SELECT model, split, list_sort(list_distinct(quantile_cont(p, [{probs}]))) AS ed FROM scores GROUP BY 1, 2),
  b AS (SELECT s.model, s.split, p, y, len(list_filter(ed[2:len(ed) - 1], lambda x: x < p))::INTEGER AS bin FROM scores s JOIN e USING (model, split))""".replace(
    "{probs}", ", ".join(repr(i / 20) for i in range(21))
)


@BOOK.add(
    f"""WITH {SCORES}, {_EDGES} SELECT model, split, bin, round(avg(p), 6) AS model_prob, round(avg(y), 6) AS true_label, count(*) AS n FROM b GROUP BY 1, 2, 3"""
)
def calibration_curve(spark, d):
    out = evaluate.calibration(score_rows(spark, d))
    return out.withColumns({c: r(c) for c in ("model_prob", "true_label")})


@BOOK.add(
    f"""WITH {SCORES}, {_EDGES}, c AS (SELECT model, split, bin, avg(p) AS m FROM b GROUP BY 1, 2, 3)
        SELECT model, split, round(floor(arg_min(m, bin) / 0.05) * 0.05, 2) AS low, round(floor(arg_max(m, bin) / 0.05) * 0.05 + 0.05, 2) AS high FROM c GROUP BY 1, 2"""
)
def calibration_axis(spark, d):
    return evaluate.calibration_range(evaluate.calibration(score_rows(spark, d)))


@BOOK.add(
    f"""WITH {SCORES}, l AS (SELECT model, split, y, pred, -ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16::DOUBLE)) AS loss FROM scores)
        SELECT model, split, round(coalesce(avg(loss) FILTER (y = 1), 0) / 2 + coalesce(avg(loss) FILTER (y = 0), 0) / 2, 6) AS entropy,
          round(avg(y), 6) AS true_pos_rate, round(avg(pred), 6) AS pred_pos_rate FROM l GROUP BY 1, 2"""
)
def monitoring_metrics(spark, d):
    out = evaluate.monitoring(score_rows(spark, d))
    return out.select(*BY, *[r(c).alias(c) for c in out.columns[2:]])


REPLICATES = 1000
_CDF = "[" + ", ".join(repr(c) for c in evaluate.POISSON_CDF) + "]::DOUBLE[]"
_M = "18446744073709551616::UHUGEINT"


def _mixed(x: str) -> str:
    return f"((({x})::UHUGEINT) % {_M})::UBIGINT"


_BOOT = f"""seeds AS MATERIALIZED (SELECT *, ('0x' || substr(md5(post_id::VARCHAR), 1, 15))::BIGINT AS seed FROM scores),
  reps AS (SELECT unnest(range(0, {REPLICATES})) AS rep),
  x0 AS MATERIALIZED (SELECT model, split, y, pred, p, rep, {_mixed(f"seed::UHUGEINT + (rep + 1)::UHUGEINT * {evaluate.MIX_STEP}::UHUGEINT")} AS x FROM seeds, reps),
  x1 AS MATERIALIZED (SELECT * REPLACE ({_mixed(f"xor(x, x >> 30)::UHUGEINT * {evaluate.MIX_A}::UHUGEINT")} AS x) FROM x0),
  x2 AS MATERIALIZED (SELECT * REPLACE ({_mixed(f"xor(x, x >> 27)::UHUGEINT * {evaluate.MIX_B}::UHUGEINT")} AS x) FROM x1),
  x3 AS MATERIALIZED (SELECT * REPLACE (xor(x, x >> 31) AS x) FROM x2),
  w AS MATERIALIZED (SELECT model, split, y, pred, p, rep, len(list_filter({_CDF}, lambda c: c <= (x >> 11)::DOUBLE / 9007199254740992.0::DOUBLE)) AS w FROM x3),
  cell AS (SELECT model, split, rep, coalesce(sum(w) FILTER (y = 1 AND pred = 1), 0)::DOUBLE AS tp, coalesce(sum(w) FILTER (y <> 1 AND pred = 1), 0)::DOUBLE AS fp,
    coalesce(sum(w) FILTER (y = 1 AND pred <> 1), 0)::DOUBLE AS fn, coalesce(sum(w) FILTER (y <> 1 AND pred <> 1), 0)::DOUBLE AS tn FROM w GROUP BY 1, 2, 3),
  tie AS (SELECT model, split, rep, p, coalesce(sum(w) FILTER (y = 1), 0)::DOUBLE AS pos, coalesce(sum(w) FILTER (y <> 1), 0)::DOUBLE AS neg FROM w GROUP BY 1, 2, 3, 4),
  cum AS (SELECT *, sum(neg) OVER (PARTITION BY model, split, rep ORDER BY p ROWS UNBOUNDED PRECEDING) - neg AS below FROM tie),
  area AS (SELECT model, split, rep, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS a FROM cum GROUP BY 1, 2, 3),
  m AS (SELECT c.model, c.split, c.rep, round_even((tp + tn) / (tp + fp + fn + tn), 3) AS accuracy, round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 3) AS precision,
    round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 3) AS recall,
    round_even((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END * (tp + fn)
      + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END * (tn + fp)) / (tp + fp + fn + tn), 3) AS f1_weighted,
    round_even(a, 3) AS roc_auc FROM cell c JOIN area USING (model, split, rep)),
  long AS (SELECT model, split, 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT model, split, 'precision', precision FROM m
    UNION ALL SELECT model, split, 'recall', recall FROM m UNION ALL SELECT model, split, 'f1_weighted', f1_weighted FROM m
    UNION ALL SELECT model, split, 'roc_auc', roc_auc FROM m),
  bounds AS (SELECT model, split, metric, round_even(quantile_cont(v::DOUBLE, 0.025), 3)::DOUBLE AS low, round_even(quantile_cont(v::DOUBLE, 0.975), 3)::DOUBLE AS high FROM long GROUP BY 1, 2, 3)"""


@BOOK.add(f"WITH {SCORES}, {_BOOT} SELECT * FROM bounds")
def bootstrap_intervals(spark, d):
    return evaluate.confidence_intervals(score_rows(spark, d), "post_id", BY, REPLICATES)


@BOOK.add(
    f"""WITH {SCORES}, {METRICS_SQL}, {_BOOT.replace('area AS', 'boot_area AS').replace('JOIN area', 'JOIN boot_area').replace('long AS', 'boot_long AS').replace('FROM long', 'FROM boot_long')},
        pts AS (UNPIVOT metrics ON accuracy, precision, recall, f1_weighted, roc_auc INTO NAME metric VALUE value)
        SELECT model, split, metric, value, low, high FROM pts JOIN bounds USING (model, split, metric)"""
)
def full_evaluation(spark, d):
    """Metrics of all models and splits with their intervals."""
    return evaluate.evaluate_all(score_rows(spark, d), "post_id", BY, REPLICATES)


# --- descriptive reports -------------------------------------------------------


@BOOK.add(
    """WITH c AS (SELECT least(n_chars, 500)::DOUBLE AS v FROM documents), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w, count(*) AS n FROM c),
       x AS (SELECT least(floor((v - lo) / w) + 1, 20)::INTEGER AS bin, lo, w, n FROM c, b)
       SELECT bin, round(lo + w * (bin - 1), 6) AS left_edge, count(*) AS n, round(count(*) * 100.0 / max(x.n), 6)::DOUBLE AS percent FROM x GROUP BY bin, lo, w"""
)
def view_distribution(spark, d):
    docs = table(spark, d, "documents").select(F.col("n_chars").alias("num_views"))
    out = metric_distribution(docs, "num_views")
    return out.select("bin", r("left_edge").alias("left_edge"), "n", r("percent").alias("percent"))


@BOOK.add(
    """WITH c AS (SELECT o_orderkey, least(count(l_orderkey), 20) AS num_comments FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
       SELECT num_comments, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM c), 6)::DOUBLE AS percent FROM c GROUP BY 1"""
)
def comment_distribution(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    posts = table(spark, d, "orders").select("o_orderkey").join(counts, "o_orderkey", "left")
    out = metric_distribution(posts.select(F.coalesce("n", F.lit(0)).alias("num_comments")), "num_comments")
    return out.select(F.col("num_comments").cast("long").alias("num_comments"), "n", r("percent").alias("percent"))


@BOOK.add(
    """WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, count(o_orderkey) AS requests FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
       SELECT strftime(week, '%Y-%m-%d') AS week, requests FROM w WHERE week > (SELECT min(week) FROM w) AND week < (SELECT max(week) FROM w)"""
)
def weekly_series(spark, d):
    asked = table(spark, d, "orders").filter(F.col("o_orderstatus") == "O")
    out = weekly_counts(asked, "o_orderdate", "o_orderkey")
    return out.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "requests")


_ACTIVITY = """a AS (SELECT o_custkey::VARCHAR AS firm, count(*) AS n FROM orders GROUP BY 1),
  k AS (SELECT * FROM a WHERE n / (SELECT count(*) FROM orders)::DOUBLE <= 0.1 AND firm <> 'New')"""


def _activity(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("user_firm"), F.col("o_orderkey").alias("post_id"))
    return firm_activity(orders)


@BOOK.add(
    f"""WITH {_ACTIVITY}, o AS (SELECT firm, n, row_number() OVER (ORDER BY n, md5(firm), firm) AS i, sum(n) OVER (ORDER BY n, md5(firm), firm ROWS UNBOUNDED PRECEDING) AS c,
          count(*) OVER () AS f, sum(n) OVER () AS t FROM k)
        SELECT firm, n, round(i / f::DOUBLE, 9) AS cum_firms, round(c / t::DOUBLE, 9) AS cum_pct, round(i / f::DOUBLE, 9) AS equality FROM o"""
)
def lorenz_points(spark, d):
    out = lorenz_curve(_activity(spark, d))
    return out.select("firm", "n", *[r(c, 9).alias(c) for c in ("cum_firms", "cum_pct", "equality")])


@BOOK.add(
    f"""WITH {_ACTIVITY}, o AS (SELECT row_number() OVER (ORDER BY n, firm) / count(*) OVER ()::DOUBLE AS e, sum(n) OVER (ORDER BY n, firm ROWS UNBOUNDED PRECEDING) / sum(n) OVER ()::DOUBLE AS c FROM k)
        SELECT count(*) AS firms, round(sum(e - c) / sum(e), 9) AS gini FROM o"""
)
def gini_of_activity(spark, d):
    return gini_coefficient(_activity(spark, d)).select("firms", r("gini", 9).alias("gini"))


# --- comparisons of probabilities ----------------------------------------------

_WIDE = "wide AS (SELECT post_id, max(p) FILTER (model = 'length') AS p1, max(p) FILTER (model = 'digest') AS p2 FROM scores GROUP BY 1)"


def _wide(spark, d):
    return score_rows(spark, d).groupBy("post_id").agg(
        F.max(F.when(F.col("model") == "length", F.col("p"))).alias("p1"), F.max(F.when(F.col("model") == "digest", F.col("p"))).alias("p2")
    )


@BOOK.add(f"WITH {SCORES}, {_WIDE} SELECT round(corr(p1, p2), 9) AS correlation, count(*) AS n FROM wide")
def probability_correlation(spark, d):
    link, _ = relate_probabilities(_wide(spark, d), "p1", "p2")
    return link.select(r("correlation", 9).alias("correlation"), "n")


@BOOK.add(
    f"""WITH {SCORES}, {_WIDE}, e AS (SELECT {edges_sql('p1', 20, 'wide')} AS edges)
        SELECT {bin_sql('p1', 'edges')}::INTEGER AS bin, round(avg(p1), 6) AS first_prob, round(avg(p2), 6) AS second_prob, count(*) AS n FROM wide, e GROUP BY 1"""
)
def probability_relation(spark, d):
    _, curve = relate_probabilities(_wide(spark, d), "p1", "p2")
    return curve.select("bin", r("first_prob").alias("first_prob"), r("second_prob").alias("second_prob"), "n")


def _before_after(spark, d):
    wide = _wide(spark, d)
    return wide.select("post_id", F.col("p1").alias("p")), wide.select("post_id", F.col("p2").alias("p"))


@BOOK.add(
    f"""WITH {SCORES}, {_WIDE} SELECT count(*) AS n, round(avg(p1), 6) AS mean_before, round(avg(p2), 6) AS mean_after, round(avg(p2 - p1), 6) AS mean_change,
        round(avg((p2 > p1)::INTEGER), 6) AS share_improved FROM wide"""
)
def revision_summary(spark, d):
    out = revision_effect(*_before_after(spark, d))
    return out.select("n", *[r(c).alias(c) for c in out.columns[1:]])


@BOOK.add(
    f"""WITH {SCORES}, {_WIDE}, e AS (SELECT {edges_sql('p1', 20, 'wide')} AS edges)
        SELECT {bin_sql('p1', 'edges')}::INTEGER AS bin, round(avg(p1), 6) AS mean_before, round(avg((p2 > p1)::INTEGER), 6) AS share_improved, count(*) AS n FROM wide, e GROUP BY 1"""
)
def revision_by_initial(spark, d):
    out = improvement_by_initial(*_before_after(spark, d))
    return out.select("bin", r("mean_before").alias("mean_before"), r("share_improved").alias("share_improved"), "n")


@BOOK.add(
    f"""WITH {SCORES}, {_WIDE}, l AS (SELECT least(floor(p1 * 20) + 1, 20)::INTEGER AS bin, 1 AS a, 0 AS b FROM wide UNION ALL SELECT least(floor(p2 * 20) + 1, 20)::INTEGER, 0, 1 FROM wide)
        SELECT bin, sum(a)::BIGINT AS n_before, sum(b)::BIGINT AS n_after FROM l GROUP BY 1"""
)
def revision_histograms(spark, d):
    return revision_histogram(*_before_after(spark, d))
