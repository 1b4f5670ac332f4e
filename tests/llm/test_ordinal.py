import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import hard_texts, table

from postloom.llm.catalog import with_grades
from postloom.llm.ordinal import fit, graded_quality, thresholds

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def graded(spark):
    return with_grades(spark, BIG)


def test_held_out_documents(spark, graded):
    """Trained on one half of the labelled rows, toxic rows of the other half go and good ones stay."""
    model = fit(graded.filter("doc_id % 2 = 0"), 3)
    other = graded.filter("doc_id % 2 = 1 and grade is not null")
    rows = graded_quality(other, model, select_from=2).join(other.select("doc_id", "grade"), "doc_id").collect()
    kept = lambda g: np.mean([r.kept for r in rows if r.grade == g])
    mean = lambda g: np.mean([r.expected_grade for r in rows if r.grade == g])
    assert kept(2) > 0.9 and kept(1) < 0.45 and kept(0) < 0.45
    assert mean(0) < mean(1) < mean(2)


def test_hard_texts_and_empty_tables(spark):
    docs = table(spark, hard_texts())
    none = docs.withColumn("grade", F.lit(None).cast("int"))
    weights, cuts = fit(none, 4)
    assert not weights.any() and (np.diff(cuts) > 0).all()
    rows = graded_quality(docs, (weights, cuts), select_from=3).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.expected_grade <= 3 and 0 <= r.tail_probability <= 1 for r in rows)
    assert graded_quality(docs.limit(0), (weights, cuts), select_from=1).count() == 0


def test_a_bounded_sample_gives_one_result(spark, graded):
    a, b = (fit(graded, 3, train_rows=300) for _ in range(2))
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_thresholds_are_ordered():
    assert (np.diff(thresholds(np.array([0.3, -50.0, 2.0, 60.0]))) > 0).all()
