"""Exploration and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postloom.operators.describe import firm_activity, gini_coefficient, lorenz_curve, metric_distribution, weekly_counts
from postloom.operators.evaluate import calibration, class_report, evaluate_all
from postloom.session import settle
from postloom.sources.tables import append_metrics


def explore(posts: DataFrame, basic: DataFrame, comments: DataFrame) -> dict[str, DataFrame]:
    """Plot data: engagement distributions, weekly requests, concentration across firms."""
    # written once for all six reports
    joined = settle(posts.join(basic.select("post_id", "num_offers", "referral_request"), "post_id", "left"), "joined")
    asked = firm_activity(joined.filter("referral_request"))
    offered = firm_activity(comments.filter("referral_offer"))
    return {
        "num_views": metric_distribution(joined, "num_views"),
        "num_comments": metric_distribution(joined, "num_comments"),
        "num_offers": metric_distribution(joined, "num_offers"),
        "weekly_requests": weekly_counts(joined.filter("referral_request")),
        "lorenz_requests": lorenz_curve(asked),
        "gini_requests": gini_coefficient(asked),
        "lorenz_offers": lorenz_curve(offered),
        "gini_offers": gini_coefficient(offered),
    }


def evaluate(scores: DataFrame, report: str, replicates: int | None = 1000) -> dict[str, DataFrame]:
    """Metrics with intervals of all models on both splits, written to ``report``, plus plot data."""
    append_metrics(evaluate_all(scores, "post_id", replicates=replicates), report)
    return {
        "class_report": class_report(scores),
        "calibration": calibration(scores.filter("p is not null")),
    }
