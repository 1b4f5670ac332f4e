import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from texts import table

from postloom.llm.mixing import mixture, n_words


def poured(budget, caps, weights):
    """Water-filling by repeated rounds: full children leave, the others share what is left by weight."""
    open_ = {k for k in caps if weights[k] > 0}
    given = {k: Fraction(0) for k in caps}
    left = Fraction(min(budget, sum(caps.values())))
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * total <= weights[k] * left}
        if not full:
            for k in open_:
                given[k] = Fraction(weights[k]) * left / total
            break
        k = min(full, key=lambda k: (Fraction(caps[k], weights[k]), str(k)))
        given[k], left = Fraction(caps[k]), left - caps[k]
        open_.remove(k)
    return given


ROWS = [
    (i, ["web", "books", None, "rare"][(i // 3) % 4], ["en", "de", None][i % 3], f"s{i % 5}" if i % 7 else None, [0, None, 3, 10, 250][i % 5] if i % 2 else i % 40, "x", 2)
    for i in range(400)
] + [(1000 + i, "web", "en", "hot", 5, "x", 2) for i in range(300)]
SCHEMA = "doc_id bigint, domain string, lang string, source string, tokens int, leaf string, copies int"
WEIGHTS = {"domain": {"web": 5, "books": 3, "rare": 0}, "lang": {"en": 4}, "source": {"hot": 3, "s1": 0}}


def totals(rows):
    out = defaultdict(int)
    for _, d, lang, s, t, _, _ in rows:
        out[(d, lang, s)] += t or 0
    return out


@pytest.mark.parametrize("budget, epochs", [(None, 1), (2000, 1), (9000, 3), (10**7, 2), (0, 2), (7, 1)])
def test_budgets_follow_the_tree_and_prefixes_the_budgets(spark, budget, epochs):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = {r.doc_id: r for r in mixture(docs, WEIGHTS, budget, epochs, seed=5).collect()}
    supply = totals(ROWS)
    caps = {k: v * epochs for k, v in supply.items()}
    wanted = sum(supply.values()) if budget is None else budget
    budgets = {(): Fraction(min(wanted, sum(caps.values())))}
    for depth, level in enumerate(("domain", "lang", "source")):
        for parent in [k for k in budgets if len(k) == depth]:
            children = defaultdict(int)
            for k, c in caps.items():
                if k[:depth] == parent:
                    children[k[: depth + 1]] += c
            budgets |= poured(budgets[parent], children, {k: WEIGHTS[level].get(k[-1], 1) for k in children})
    taken = defaultdict(int)
    for i, d, lang, s, t, _, _ in ROWS:
        if i in found:
            taken[(d, lang, s)] += (t or 0) * found[i].copies
    for leaf, total in supply.items():
        # whole tokens: rounding moves a budget by at most one per child and level
        slack = 2 + 3 * 12
        assert taken[leaf] <= budgets[leaf] + slack
        largest = max((t or 0) for i, d, lang, s, t, _, _ in ROWS if (d, lang, s) == leaf)
        assert taken[leaf] >= budgets[leaf] - slack - largest
        rows = [(i, t or 0) for i, d, lang, s, t, _, _ in ROWS if (d, lang, s) == leaf]
        copies = [found[i].copies if i in found else 0 for i, _ in rows]
        assert max(copies, default=0) <= epochs
        whole = int(budgets[leaf] // total) if total else 0
        if total and abs(budgets[leaf] - round(budgets[leaf] / total) * total) > slack:
            draw = lambda i: (int(hashlib.md5(f"5|{whole}|{i}".encode()).hexdigest()[:13], 16), i)  # noqa: E731, B023
            order = [found[i].copies - whole if i in found else -whole for i, t in sorted(rows, key=lambda x: draw(x[0])) if t > 0]
            assert order == sorted(order, reverse=True)
    assert all(r.copies >= 1 for r in found.values())


def test_empty_table_and_null_tokens(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert mixture(docs.limit(0), WEIGHTS).count() == 0
    assert mixture(docs.filter("tokens is null"), WEIGHTS).count() == 0


def test_words_are_counted(spark):
    rows = table(spark, [None, "", " a\tb\x0bc  d\n", "é\xa0x"]).select("doc_id", n_words(F.col("text")).alias("w"))
    assert [r.w for r in rows.orderBy("doc_id").collect()] == [0, 0, 4, 1]
