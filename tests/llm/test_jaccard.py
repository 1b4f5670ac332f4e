import pytest
from texts import hard_texts, lowered, table, words

from postloom.llm import jaccard


def plain(texts, percent=80):
    sets = []
    for t in texts:
        w = words(lowered(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if union and 100 * len(sets[a] & sets[b]) >= percent * union and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return {i: (len(s), g) for i, (s, g) in enumerate(zip(sets, group, strict=True))}


@pytest.mark.parametrize("pairs_per_row", [jaccard.PAIRS_PER_ROW, 0])
def test_components_of_all_pairs(spark, monkeypatch, pairs_per_row):
    monkeypatch.setattr(jaccard, "PAIRS_PER_ROW", pairs_per_row)
    texts = hard_texts(2, 80)
    found = jaccard.jaccard_components(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component) for r in found} == plain(texts)
    assert len(found) == len(texts)


def test_threshold_is_met_exactly(spark):
    # 9 of 11 shingles shared is 0.818, 8 of 12 is 0.667; 4 of 5 is 0.8
    eight = "a b c d e f g h"
    texts = [eight, eight + " i", eight + " i j", "x " + eight, "p q r s t u v w", "p q r s t u v w x"]
    found = jaccard.jaccard_components(table(spark, texts)).collect()
    assert {r.doc_id: r.component for r in found} == {k: v[1] for k, v in plain(texts).items()}


def test_empty_table_and_blank_texts(spark):
    docs = table(spark, [None, "", " "])
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    assert sorted(tuple(r) for r in jaccard.jaccard_components(docs).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_tokens_travel_in_short_rows(spark):
    tokens = spark.createDataFrame([(0, 5, 1, 10), (3, 5, 2, 9), (9, 5, 3, 1000), (1, 6, 1, 10)], "pos int, token bigint, node bigint, n int")
    found = jaccard.shared_tokens(tokens, 80)
    assert sorted((r.token, r.node, r.n, r.pos, r.smallest) for r in found.collect()) == [(5, 1, 10, 0, 9), (5, 2, 9, 3, 9), (5, 3, 1000, 9, 9)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "max(" not in plan and "place" in plan
