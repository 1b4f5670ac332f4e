"""Masks: phrases against one regex, number masks on hand-written rows, both lexicon sizes."""

import re

import pytest
from pyspark.sql import functions as F

from postloom.catalog.masks import level_passes
from postloom.functions import fixed_values as fixed
from postloom.operators import lexicons, masking


def masked(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def by_regex(text, phrases, tag):
    ordered = sorted(phrases, key=lambda p: -len(p.split()))
    pattern = "|".join(r"\b" + re.escape(p) + r"\b" for p in ordered)
    return re.sub(pattern, tag, text, flags=re.IGNORECASE)


PHRASES = ["data", "data engineer", "engineer at", "at big co", "p&g", "c++", "/us", "u.s", "new york", "york city hall", "twitter / x"]
TEXTS = [
    "Data Engineer at Big Co", "engineer at big co", "metadata engineers", "P&G, p&gx", "use c++ now c++x", "in/us a/us (/us", "the u.s. and u.s",
    "new york city hall", "New  York", "twitter / x twitter/x", "", "é data é", "dataé data-data", "data data data", "a\ndata engineer\n",
]


@pytest.mark.parametrize("limit", [None, 0])
def test_phrase_mask_is_the_alternation(spark, monkeypatch, limit):
    """Small and large lexicons give what one ordered alternation gives."""
    if limit is not None:
        monkeypatch.setattr(masking, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(masking, "MAX_FIRSTS", 0)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "post_id int, t string").repartition(3)
    out = masking.mask_phrases(docs, "post_id", "t", lexicons.ordered_lexicon(spark, PHRASES, "[X]"))
    got = {r.post_id: r.t for r in out.collect()}
    assert got == {i: by_regex(t, PHRASES, "[X]") for i, t in enumerate(TEXTS)}


HARD = [*TEXTS, "İstanbul data İ engineer at", "ΣΑΣ data", "ｄata data\u0301 data", "the \U0001f642data data\U0001f642", "c++c++ c++", "data\u200dengineer data\u00a0engineer"]


@pytest.mark.parametrize("firsts", [0, 2_000])
def test_matches_are_the_same_by_automaton_and_by_join(spark, monkeypatch, firsts):
    """Places and masks of a lexicon that fits a broadcast, and of the same one joined behind its Bloom filter."""
    docs = spark.createDataFrame(list(enumerate(HARD)), "post_id int, t string").repartition(3)
    lexicon = lexicons.ordered_lexicon(spark, [*PHRASES, "istanbul", "i̇ engineer", "σας"], "[X]")
    run = lambda: (
        sorted(map(tuple, masking.phrase_matches(docs, "post_id", "t", lexicon).collect())),
        sorted(map(tuple, masking.mask_phrases(docs, "post_id", "t", lexicon).collect())),
    )
    small = run()
    monkeypatch.setattr(masking, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(masking, "MAX_FIRSTS", firsts)
    assert run() == small
    texts = dict(enumerate(HARD))
    assert all(texts[k][a : a + n].lower() == phrase for k, a, n, phrase, _, _ in small[0] if "\u0130" not in texts[k])
    assert any(k == len(TEXTS) for k, *_ in small[0])


def test_few_runs_are_shuffled(spark, monkeypatch):
    """Runs that cannot be a phrase are dropped before the exchange: what is joined is little more than what matches."""
    monkeypatch.setattr(masking, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(masking, "MAX_FIRSTS", 0)
    texts = [" ".join(f"w{(i * 31 + j * 17) % 5000}" for j in range(200)) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "post_id int, t string")
    lex = masking._prepared(lexicons.ordered_lexicon(spark, [f"w{i} w{i + 17}" for i in range(0, 4900, 50)] + ["w3 w9 w1"], "[X]"))
    sent, met = masking._candidates(docs, "post_id", "t", lex), masking._matches(docs, "post_id", "t", lex)
    assert 100 < met.count() <= sent.count() <= 2 * met.count()
    plan = sent._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "Filter" in above and "ubquery" in above and "Exchange" not in above


def test_filter_loses_nothing(spark):
    values = spark.range(5000).selectExpr("concat('p', id) gram")
    assert values.filter(masking._may_hold(values, F.col("gram"))).count() == 5000
    others = spark.range(20000).selectExpr("concat('q', id) gram")
    assert others.filter(masking._may_hold(values, F.col("gram"))).count() < 1000


def test_mask_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)] + f" {i}") for i in range(60)], "post_id int, t string")
    lexicon = lexicons.ordered_lexicon(spark, PHRASES, "[X]")
    runs = [
        sorted(map(tuple, masking.mask_phrases(docs.repartition(n), "post_id", "t", lexicon).collect())) for n in (1, 7)
    ]
    assert runs[0] == runs[1] and len(runs[0]) == 60


def test_null_text_becomes_empty(spark):
    docs = spark.createDataFrame([(1, None)], "post_id int, t string")
    out = masking.mask_phrases(docs, "post_id", "t", lexicons.ordered_lexicon(spark, ["a"], "[X]"))
    assert [tuple(r) for r in out.collect()] == [(1, "")]


@pytest.mark.parametrize(
    "fn, value, result",
    [
        (masking.mask_pay, "TC: $150k and 150k+ salary", "[SALARY] and [SALARY]"),
        (masking.mask_pay, "total comp 200k", "[SALARY]"),
        (masking.mask_pay, "comp is good, 10 people", "comp is good, 10 people"),
        (masking.mask_experience, "5 years of experience, yoe 7", "[YEARS], [YEARS]"),
        (masking.mask_experience, "years ago", "years ago"),
        (masking.mask_scores, "LC 300 and 250+ leetcode", "[LEETCODE] and [LEETCODE]"),
        (masking.mask_levels, "E5.5 or L6, senior manager ii", "[ICLEVEL] or [ICLEVEL], [MANAGER]"),
        (masking.mask_levels, "mid level, new grad", "[ICLEVEL] [ICLEVEL], [ICLEVEL]"),
        (masking.mask_levels, "senior/staff level 3", "[ICLEVEL]/[ICLEVEL]"),
        (masking.mask_industries, "big tech, fintech", "[INDUSTRY], [INDUSTRY]"),
        (masking.mask_links, "see http://a.b/c www.x.y #tag @me ex-Meta ex Google complex role", "see [URL] [URL] tag me Meta Google complex role"),
        (masking.fix_capitals, "so i'm in and i think tc", "so I'm in and I think TC"),
        (masking.single_brackets, "[[ORG]] [x]", "[ORG] [x]"),
        (masking.space_mask_tokens, "a[ORG]b  c ,d", "a [ORG] b c,d"),
    ],
)
def test_number_and_term_masks(spark, fn, value, result):
    assert masked(spark, fn, value) == result


def levels_one_by_one(text):
    """Every row of the level table applied in turn."""
    for pattern, tag in level_passes():
        text = re.sub(pattern, tag, text, flags=re.I)
    return text


def test_merged_level_passes_equal_single_passes(spark):
    import random

    rng = random.Random(5)
    atoms = (
        "senior staff junior jr sr principal mid manager em sdm level levels grade band e l i t ic icl ict e4 l5 ic3 t6 ii iii iv v vi 3 4.5 10 "
        "new grad new-grad tech lead tech-lead intern interns internship undergrad grad graduates entry-level senior-level senior/staff staff, "
        "level, ic, e, manager, word other text . , / ; \n"
    ).split(" ")
    rows = [(" ".join(rng.choice(atoms) for _ in range(rng.randint(1, 14))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "v string").select("v", masking.single_brackets(masking.mask_levels(F.col("v"))).alias("r"))
    wrong = [(r.v, r.r, levels_one_by_one(r.v)) for r in df.collect() if r.r != levels_one_by_one(r.v)]
    assert not wrong, wrong[:5]


def test_level_names_without_blanks_between(spark):
    import random

    rng = random.Random(11)
    atoms = "senior staff jr manager level grade e l i ic ict ii iv 3 4.5 new grad tech lead intern , / - x".split(" ")
    rows = [("".join(rng.choice([*atoms, " "]) for _ in range(rng.randint(1, 9))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "v string").select("v", masking.single_brackets(masking.mask_levels(F.col("v"))).alias("r"))
    wrong = [(r.v, r.r, levels_one_by_one(r.v)) for r in df.collect() if r.r != levels_one_by_one(r.v)]
    assert not wrong, wrong[:5]


def beside_one_by_one(text, terms, number, tag):
    for t in [*terms, *[f"{t}," for t in terms]]:
        text = re.sub(rf"\b{number}\s*{t}\b", tag, text, flags=re.I)
        text = re.sub(rf"\b{t}\s*[:=]?\s*{number}\b", tag, text, flags=re.I)
    return text


def test_numbers_beside_terms_equal_single_passes(spark):
    import random

    rng = random.Random(7)
    atoms = "salary pay, comp compensation TC: was total curr 150k $200k+ dollars5 = 3 7+ years yrs of experience yoe lc leetcode 90K payer x . , \n \u017falary".split(" ")
    rows = [(rng.choice(["", " "]).join(rng.choice(atoms) for _ in range(rng.randint(1, 9))),) for _ in range(2000)]
    pay = [f"{a} {t}" for a in fixed.PAY_LEADS for t in fixed.PAY_TERMS] + fixed.PAY_TERMS
    masks = {
        "pay": (masking.mask_pay, pay, fixed.PAY_AMOUNT, "[SALARY]"),
        "years": (masking.mask_experience, fixed.EXPERIENCE_TERMS, r"(\d+)\+?", "[YEARS]"),
        "scores": (masking.mask_scores, fixed.SCORE_TERMS, r"(\d+)\+?[kK]?\+?", "[LEETCODE]"),
    }
    df = spark.createDataFrame(rows, "v string").select("v", *[fn(F.col("v")).alias(k) for k, (fn, *_) in masks.items()])
    wrong = [(r.v, k, r[k]) for r in df.collect() for k, (_, *how) in masks.items() if r[k] != beside_one_by_one(r.v, *how)]
    assert not wrong, wrong[:5]


def test_only_passes_that_can_occur_are_applied(spark):
    """A pattern whose words or kind are absent is not even compiled; this one could not be."""
    passes = [("pay", ["salary"], r"\bsalary \d+"), ("pay", ["package"], "("), ("rank", [], "(")]
    guards = {"pay": r"\d", "rank": "rank"}
    mask = lambda c: masking.rewrite_where(c, passes, "[X]", guards, "|".join(guards.values()))
    assert masked(spark, mask, "Salary 5, salary 60") == "[X], [X]"


def test_company_lexicon(spark):
    comments = spark.createDataFrame([("Google",), ("ex-Big Co",), (None,), ("New",)], "user_firm string")
    names = {r.phrase for r in lexicons.company_lexicon(comments, extra=["xoogle", "visa"]).collect()}
    assert names == {"google", "big co", "bigco", "xoogle"}


def test_location_lexicon(spark):
    gazetteer = spark.createDataFrame([("São Paulo",), ("Oslo",)], "name string")
    names = {r.phrase for r in lexicons.location_lexicon(spark, gazetteer, extra=["bay area"]).collect()}
    assert names == {"sao paulo", "sao-paulo", "saopaulo", "oslo", "bay area", "bay-area", "bayarea"}


def test_role_phrases():
    roles = set(lexicons.role_phrases())
    assert {"technical product manager", "sde3", "data engineer", "data scientist", "HR analyst", "recruiter,", "/backend"} <= roles
    assert "python" not in roles and "product" not in roles


def test_lexicon_sets(spark):
    first = lexicons.ordered_lexicon(spark, ["a b", "c"], "[X]")
    second = lexicons.ordered_lexicon(spark, ["c", "d"], "[X]")
    assert {r.phrase for r in lexicons.union_lexicons(first, second).collect()} == {"a b", "c", "d"}
    assert {r.phrase for r in lexicons.without_phrases(first, second, ["A B"]).collect()} == set()


def test_full_mask(spark):
    posts = spark.createDataFrame(
        [(1, "[TITLE]\n\nSoftware engineer at Google\n\n\n[CONTENT]\n\n5 years of experience in Oslo. TC: $150k, L5")], "post_id int, combined string"
    )
    comments = spark.createDataFrame([("Google",)], "user_firm string")
    places = lexicons.location_lexicon(spark, spark.createDataFrame([("Oslo",)], "name string"))
    out = masking.mask_posts(posts, lexicons.role_lexicon(spark), lexicons.company_lexicon(comments), places).first()
    text = re.sub(r"\s+", " ", out.combined_mask).strip()
    assert text == "[TITLE] [ROLE] at [ORG] [CONTENT] [YEARS] in [GPE] . [SALARY], [ICLEVEL]"


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "The [org] hires engineers, and the policies of data!"), (2, ""), (3, None)], "post_id int, t string")
    stop = ["the", "and", "of"]
    got = {r.post_id: r.k for r in masking.process_tokens(docs, "t", "k", stop).collect()}
    # stop-words are matched with case, so the capital one stays
    assert got == {1: "The [ORG] hire engineer policy data", 2: "", 3: ""}
    lemmas = spark.createDataFrame([("hires", "hire"), ("policies", "policy")], "word string, lemma string")
    looked = {r.post_id: r.k for r in masking.process_tokens(docs, "t", "k", stop, lemmas).collect()}
    assert looked == {1: "The [ORG] hire engineers policy data", 2: "", 3: ""}


def test_stopwords_keep_meaningful_words():
    words = set(lexicons.stopwords())
    assert "the" in words and not words & {"again", "should", "only"}


def test_tokens_with_looked_up_roots_are_not_shuffled(spark):
    """Only whole texts are dealt by key; their tokens meet a small table where they are."""
    from postloom.operators.masking import process_tokens

    docs = spark.createDataFrame([(1, "cats and dogs"), (2, ""), (3, None), (4, "a cat [ORG]")], "post_id long, text string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "word string, lemma string")
    out = process_tokens(docs, "text", "tokens", ["and"], lemmas)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_COL") > 0
    assert {r.post_id: r.tokens for r in out.collect()} == {1: "cat dog", 2: "", 3: "", 4: "a cat [ORG]"}
