import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import hard_texts, table, words

from postloom.llm import quality
from postloom.llm.quality import distance, quality_rules


def plain(text):
    w, text = words(text), text or ""
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    counts = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice)
    return (*counts, len(w) < 50 or 100 * len(twice) > 50 * len(w))


def test_counts_of_hard_texts(spark):
    texts = hard_texts() + ["a\nb\na\n\n\nb\n b\na", "x\r\nx\r\nx", "#$% <a> é|\n" * 20, "q\x00\x1f\x7f ​", "\n\n", "a b c a b c d"]
    rows = quality_rules(table(spark, texts).withColumn("lang", F.lit(None).cast("string")), keep=["key"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        assert got == plain(texts[r.doc_id])
        assert (r.kept, r.char_distance, r.word_distance, r.key) == (not r.base_failed, None, None, "k")


def test_distance_of_histograms():
    shares = np.array([0.5, 0.5, 0.0])
    found = distance(np.array([[1, 1, 0], [0, 0, 3], [2, 0, 0], [0, 0, 0]]), shares)
    m = np.array([0.75, 0.25])
    third = np.sqrt((np.log2(1 / m[0]) + 0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1])) / 2)
    assert np.allclose(found, [0, 1, third, 0])


def test_far_documents_go_and_guards_hold(spark, monkeypatch):
    monkeypatch.setattr(quality, "REFERENCE_WORDS", 100)
    rng = random.Random(5)
    clean = [" ".join(rng.choice(["the", "of"] + ["".join(rng.choices("abcdefg", k=5)) for _ in range(6)]) for _ in range(240)) for _ in range(30)]
    odd = ["#$% " * 3 + " ".join(f"&%${i}##" for i in range(120)), " ".join(f"QQ{i}X" for i in range(120)), "&& ## " * 5]
    docs = table(spark, clean + odd + [None]).withColumn("lang", F.expr("if(doc_id = 33, null, 'en')"))
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert all(kept[i] for i in range(30)) and not any(kept[i] for i in range(30, 34))
    assert quality_rules(docs.limit(0)).count() == 0


def test_labelled_documents(spark):
    """Good documents stay, documents full of symbols go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) >= 0.99 * len(good)
    marked = [r.kept for r in rows if r.quality == 0 and r.n_symbols > r.n_words]
    assert sum(marked) <= 0.1 * len(marked)


def test_texts_of_another_language_and_gibberish_go(spark):
    """German texts labelled as English, and lower-case words that no language has, beside the references of all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    odd = [(-1 - i, " ".join("".join(rng.choices("abcdefghijklmno", k=6)) for _ in range(150)), "en") for i in range(5)]
    wrong = docs.filter("lang = 'de' and doc_id % 5 = 0").withColumn("lang", F.lit("en"))
    others = docs.filter("not (lang = 'de' and doc_id % 5 = 0)")
    rows = quality_rules(others.union(wrong).union(spark.createDataFrame(odd, docs.schema)), keep=["lang"]).collect()
    moved = {r.doc_id for r in wrong.collect()}
    judged = [r.kept for r in rows if r.doc_id in moved and not r.base_failed and r.word_distance is not None]
    assert len(judged) > 10 and sum(judged) <= 0.05 * len(judged)
    assert not any(r.kept for r in rows if r.doc_id < 0)
    assert sum(r.kept for r in rows if r.doc_id not in moved) > 0.8 * sum(not r.base_failed for r in rows if r.doc_id not in moved)


@pytest.mark.parametrize("text", [None, "", "a"])
def test_repeated_rows_are_judged_each(spark, text):
    docs = table(spark, [text]).withColumn("lang", F.lit("en"))
    assert quality_rules(docs.union(docs)).count() == 2
