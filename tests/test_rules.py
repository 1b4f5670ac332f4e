"""Rule labels on hand-written rows with the real cues."""

import re

import pytest
from pyspark.sql import functions as F

from postloom.functions.fixed_values import OFFER_CANDIDATE, OFFER_EXCLUDE, OFFER_INCLUDE
from postloom.functions.rules import literature_flags, offer_flag, offer_label, platform_flags, referral_flag, request_flag
from postloom.operators.labels import flag_requests, offers_per_post, rename_rare_flags, rule_counts

OFFERS = [
    ("dm", True),
    ("Sure, DM me", True),
    ("dm for Google", True),
    ("dm me for referral", True),
    ("can I dm you? dm for Meta", False),
    ("sent dm", False),
    ("happy to refer, dm", True),
    ("I dm’d them yesterday. dm me", False),
    ("admin people", False),
    ("dmé is no cue", False),
    ("what about dm without rules here", False),
    ("please dm\n", True),
    ("", False),
    (None, False),
    ("I am interested, dm", False),
    ("DM ( open for all )", True),
    ("dm if you can", True),
    ("may i dm", False),
    ("dm\r", True),
]


def label_by_loop(text):
    """Rules applied in order, each overwriting the one before."""
    if text is None or not re.search(OFFER_CANDIDATE, text, re.I):
        return None
    label = "(no match)"
    for name, pattern in [*OFFER_INCLUDE, *OFFER_EXCLUDE]:
        if re.search(pattern, text, re.I):
            label = name
    return label


def test_offer_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(OFFERS)], "i int, text string")
    got = df.select("i", offer_flag(F.col("text")).alias("f"), offer_label(F.col("text")).alias("l")).orderBy("i").collect()
    for row, (text, flag) in zip(got, OFFERS):
        assert row.f == flag, text
        assert row.l == label_by_loop(text), text


def test_flag_follows_from_label(spark):
    """Last match wins over the ordered rules is the same as include and not exclude."""
    names = [n for n, _ in OFFER_INCLUDE]
    df = spark.createDataFrame([(t,) for t, _ in OFFERS], "text string")
    rows = df.select(offer_flag(F.col("text")).alias("f"), offer_label(F.col("text")).alias("l"))
    assert rows.filter(F.col("f") != F.coalesce(F.col("l").isin(names), F.lit(False))).count() == 0


def test_rule_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "patterns string")
    assert [(r.patterns, r.n) for r in rule_counts(df).collect()] == [("a", 2)]


@pytest.mark.parametrize(
    "title, text, referral, asked",
    [
        ("Referral", "thanks", True, False),
        ("Hi", "is anyone able to talk", False, True),
        ("Need a referral", "", True, True),
        ("Hello", None, False, False),
        (None, "can someone refer me", True, True),
        ("#needajob", "", True, False),
        ("needless", "helpful", False, False),
    ],
)
def test_requests(spark, title, text, referral, asked):
    df = spark.createDataFrame([("p", title, text)], "post_id string, title string, text string")
    row = flag_requests(df).first()
    assert (row.is_referral, row.is_request, row.referral_request) == (referral, asked, referral and asked)


def test_single_flags_are_null_safe(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(referral_flag(F.col("t")), request_flag(F.col("t")), *platform_flags(F.col("t")), *literature_flags(F.col("t"))).first()
    assert not any(row)


def test_platform_cues(spark):
    text = "They laid me off, so a [ROLE] at [ORG] with Python. data engineer at Acme"
    df = spark.createDataFrame([(text,), ("analyst at 5",)], "t string")
    first, second = [r.asDict() for r in df.select(*platform_flags(F.col("t"))).collect()]
    assert {k for k, v in first.items() if v} == {"layoff", "company_name", "job_title", "previous_experience", "skillset"}
    assert not second["previous_experience"]


def test_compatible_cues_read_classes(spark):
    df = spark.createDataFrame([("gig",), ("SALE",), ("sale",), ("12",)], "t string")
    rows = df.select(*platform_flags(F.col("t"), compat=True)).collect()
    assert [r.company_name for r in rows] == [True, False, False, False]
    assert [r.total_compensation for r in rows] == [False, True, False, False]


def test_literature_cues(spark):
    df = spark.createDataFrame([("Please help me asap, thanks! I am familiar with SQL",)], "t string")
    row = df.select(*literature_flags(F.col("t"))).first().asDict()
    assert {k for k, v in row.items() if v} == {
        "urgency", "gratitude", "politeness", "being_desperate", "inclusive_exclusive", "evidentiality"
    }


def test_offers_per_post(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", True), ("b", False)], "post_id string, referral_offer boolean")
    assert {r.post_id: r.num_offers for r in offers_per_post(df).collect()} == {"a": 2, "b": 0}


def test_rare_flags_move_last(spark):
    df = spark.createDataFrame([(i, i == 0, i < 50) for i in range(100)], "post_id int, rare boolean, common boolean")
    assert rename_rare_flags(df, ["rare", "common"]).columns == ["post_id", "common", "below5_rare"]
