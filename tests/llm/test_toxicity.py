import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import hard_texts, table, words

from postloom.llm import toxicity as t
from postloom.llm.catalog import op13_attention_toxicity
from postloom.llm.words import Hashes

BIG = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    """Toxic documents of the held-out fold are found, the others are left alone."""
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic")
    rows = op13_attention_toxicity(spark, BIG).collect()
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(toxic[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    bad, good = [x for x in held if x[0] == 1], [x for x in held if x[0] == 0]
    assert np.mean([x[2] for x in bad]) > 0.85 and np.mean([x[2] for x in good]) < 0.02
    below = np.sort([x[1] for x in good])
    assert np.mean(np.searchsorted(below, [x[1] for x in bad]) / len(below)) > 0.93


def test_hard_texts_and_empty_tables(spark):
    docs = table(spark, [*hard_texts(), "x" * 400_000, "a" * 70 + " " + "b" * 3])
    none = docs.withColumn("label", F.lit(None).cast("int"))
    model = t.fit(none)
    rows = t.toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert t.toxicity(docs.limit(0), model).count() == 0
    assert t.fit(none.limit(0))[1] == 1
    twice = docs.limit(5).union(docs.limit(5)).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert t.toxicity(twice, model).count() == 10


def test_one_sided_labels(spark):
    """Labels of one kind, and texts without words among them, train without failing."""
    docs = table(spark, hard_texts())
    for label in (0, 1):
        model = t.fit(docs.withColumn("label", F.lit(label)), train_rows=30)
        assert np.isfinite(model[0]).all()


def test_windows_cover_every_word():
    texts = [None, "", *[" ".join(f"w{i}" for i in range(n)) for n in (1, 31, 32, 33, 48, 49, 200)]]
    found = t.Words(pa.array(texts), Hashes(), np.zeros(1 << t.WORD_BITS, np.int32), t.letters())
    for i, text in enumerate(texts):
        mine = found.doc == i
        begin = found.block.first[i]
        covered = {w for s, n in zip(found.start[mine], found.length[mine]) for w in range(s - begin, s - begin + n)}
        assert covered == set(range(len(words(text)))) and mine.any()
        assert (found.length[mine] <= t.WINDOW).all() and (np.diff(found.start[mine]) == t.STEP).all()


def test_scores_do_not_hang_on_the_block():
    """A window's logit is the same alone, between others, and over slices of windows."""
    texts = [x for x in hard_texts() if x] + ["some words here"] * 3
    net, places = t.start(50), np.random.default_rng(0).integers(0, 50, 1 << t.WORD_BITS).astype(np.int32)
    whole = t.Words(pa.array(texts), Hashes(), places, t.letters())
    together = t.logits(whole, net)
    for i, text in enumerate(texts):
        alone = t.logits(t.Words(pa.array([text]), Hashes(), places, t.letters()), net)
        assert np.allclose(together[whole.doc == i], alone, atol=1e-4)


def test_trigrams_in_pieces(monkeypatch):
    texts = pa.array(["abc de f " + "y" * 50 + " abc", "zz"])
    found = t.Words(texts, Hashes(), np.zeros(1 << t.WORD_BITS, np.int32), t.letters())
    ids = np.array([3, 0, 1, 2, 4, 5, 0])
    table_ = np.random.default_rng(1).normal(size=(1 << t.CHAR_BITS, t.CHAR)).astype(np.float32)
    want = found.char_vectors(ids, table_)
    monkeypatch.setattr(t, "PIECE", 7)
    assert np.allclose(found.char_vectors(ids, table_), want, atol=1e-5)
    assert np.allclose(want[1], want[4]) and np.allclose(want[1], want[6])


@pytest.mark.parametrize("lengths", [[5, 3, 1], [4, 0, 2]])
def test_gradients_against_finite_differences(lengths):
    rng = np.random.default_rng(3)
    net = {k: v.astype(float) * (1 if k != "bias" else 0.1) for k, v in t.start(5).items() if k not in t.TABLES}
    x = rng.normal(size=(t.INPUT, 8))
    length = np.array(lengths)
    begin = np.array([0, 2, 6])
    slope = rng.normal(size=3)
    loss = lambda: float(t.forward(x, begin, length, net) @ slope)
    trace = {}
    t.forward(x, begin, length, net, trace)
    grads, dx = t.backward(slope, x, net, trace)
    for values, grad in [*[(net[k], grads[k]) for k in grads], (x, dx)]:
        flat, want = values.reshape(-1), np.asarray(grad).reshape(-1)
        for at in rng.choice(len(flat), min(12, len(flat)), replace=False):
            kept = flat[at]
            flat[at] = kept + 1e-6
            up = loss()
            flat[at] = kept - 1e-6
            down = loss()
            flat[at] = kept
            assert abs((up - down) / 2e-6 - want[at]) < 1e-6


def test_slopes_of_a_text_against_finite_differences():
    score, doc, labels = np.array([0.3, -1.0, 0.2, -2.0, 1.5]), np.array([0, 0, 1, 1, 2]), np.array([1, 0, 1])

    def loss(s):
        p = 1 / (1 + np.exp(-s))
        clean = np.array([np.prod(1 - p[doc == d]) for d in range(3)])
        return -np.where(labels == 1, np.log(1 - clean), np.log(clean)).sum()

    for i in range(5):
        e = np.zeros(5)
        e[i] = 1e-6
        assert abs((loss(score + e) - loss(score - e)) / 2e-6 - t.slopes(score, doc, labels)[i]) < 1e-6
