"""Texts made to meet under sums modulo a power of two: a Thue-Morse word and its complement."""

import numpy as np
import pyarrow as pa
import pytest
from texts import table

from postloom.llm import jaccard, quality, substrings, suffix_tree
from postloom.llm.words import LONG, Block, Hashes


def morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


PAIRS = [(morse(n), morse(n, "ba")) for n in (64, 512, 2048)]


@pytest.mark.parametrize("second", [False, True])
def test_words_that_differ_have_other_hashes(second):
    hashes = Hashes(second)
    for a, b in PAIRS:
        block = Block(pa.array([a, b, a]))
        one, two, again = hashes.of_bytes(block.data, block.starts, block.ends)
        assert one != two and one == again
    n = 2048
    values = np.array([3, 5], np.uint64)
    rows = np.concatenate([values[[i.bit_count() % 2 for i in range(n)]], values[[1 - i.bit_count() % 2 for i in range(n)]]])
    a, b = hashes.word_ranges(rows, np.array([0, n]), np.array([n, 2 * n]))
    assert a != b


def test_a_hash_hangs_on_the_range_alone():
    """The same values at another place of the block, shorter and longer than the bound."""
    hashes = Hashes()
    values = np.random.default_rng(1).integers(0, 1 << 62, 500).astype(np.uint64)
    rows = np.concatenate([values, values[:7], values])
    for n in (1, LONG, LONG + 1, 400):
        a, b = hashes.word_ranges(rows, np.array([0, 507]), np.array([n, 507 + n]))
        assert a == b


def test_operators_tell_such_texts_apart(spark):
    a, b = PAIRS[-1]
    head = " ".join(f"w{i}" for i in range(34))
    found = {r.doc_id: r.component for r in jaccard.jaccard_components(table(spark, [a, b, a])).collect()}
    assert found == {0: 0, 1: 1, 2: 0}
    rows = substrings.without_repeats(table(spark, [f"{head} {a}", f"{head} {b}"])).collect()
    assert [r.n_removed for r in rows] == [0, 0]
    rows = substrings.without_repeats(table(spark, [f"{head} {a}", f"{head} {a}"])).collect()
    assert [r.n_removed for r in rows] == [35, 35]
    rows = {r.doc_id: r.n_dup_lines for r in quality.quality_rules(table(spark, [f"{a}\n{b}", f"{a}\n{a}"]).withColumn("lang", pa_lang())).collect()}
    assert rows == {0: 0, 1: 1}
    docs = table(spark, [f"one two {a}"] * 3 + [f"one two {b}"])
    scores = suffix_tree.language_scores(docs, docs.doc_id < 3).collect()
    assert {r.doc_id: r.n_known for r in scores}[3] == 3  # two words and the end


def pa_lang():
    from pyspark.sql import functions as F

    return F.lit("en")
