"""Ordinal cumulative-link regression on graded texts.

One weight for each hashed feature is shared by all grades; ordered thresholds
cut the score into grades: ``P(grade > k) = sigmoid(score - threshold_k)``. The
model gives the expected grade and the probability of the upper grades.

Features are the different words of a text (runs of letters), and marks for its
length, share of different words, symbols, capitals and digits, each counted
once. Only features of ``MIN_ROWS`` sample rows and more get a weight. The fit
reads at most about ``TRAIN_ROWS`` graded rows, drawn by key hash.
Each epoch is one Spark job: every partition runs gradient steps from the shared
weights, and the weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.columns import hash_unit
from postloom.llm.words import Block, Hashes, blocks, ragged
from postloom.session import settle

TRAIN_ROWS = 20_000
BITS = 20
MIN_ROWS = 10
EPOCHS = 6
PARTS = 6
BATCH = 32
RATE = 0.3
DECAY = 1e-4
START = 0.1
SYMBOLS = b"#*$%&|<>"


def letters() -> np.ndarray:
    """Bytes of letters: ASCII letters and all bytes of other characters."""
    out = np.zeros(256, bool)
    out[ord("a") : ord("z") + 1] = True
    out[ord("A") : ord("Z") + 1] = True
    out[128:] = True
    return out


def _mark(kind: int, level: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of a mark of a text, from its kind and level."""
    x = (level.astype(np.uint64) + np.uint64(1000 * (kind + 1))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: pa.Array, hashes: Hashes, kept: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every feature, by text."""
    block = Block(texts, lower=True, kept=kept)
    h = hashes.of_bytes(block.data, block.starts, block.ends)
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    plain = Block(texts)
    size = np.maximum(1, np.diff(plain.offsets))

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[plain.data])])
        return sums[plain.offsets[1:]] - sums[plain.offsets[:-1]]

    of = lambda chars: np.isin(np.arange(256), list(chars))
    pairs = np.unique(block.doc * (1 << bits) + bucket)
    different = np.bincount(pairs >> bits, minlength=plain.n_texts)
    marks = [
        np.log2(1 + plain.n_words),
        8 * different / np.maximum(1, block.n_words),
        np.log2(1 + 1000 * count(of(SYMBOLS)) / size),
        8 * count(of(range(65, 91))) / size,
        np.log2(1 + 1000 * count(of(range(48, 58))) / size),
        np.log2(1 + 1000 * count(of(b"!")) / size),
    ]
    rows = np.arange(plain.n_texts)
    extra = [rows * (1 << bits) + _mark(kind, np.floor(level).astype(np.int64), bits) for kind, level in enumerate(marks)]
    pairs = np.unique(np.concatenate([pairs, *extra]))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = Hashes(), letters()
        for part in blocks(batches, "text"):
            doc, bucket = features(part.column("text"), hashes, kept, bits)
            counts = np.bincount(doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("grade"), ragged(pa.array(bucket.astype(np.int32)), counts)], ["grade", "buckets"])

    return run


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from one free value and positive gaps."""
    return np.cumsum(np.concatenate([free[:1], np.log1p(np.exp(np.clip(free[1:], -40, 40))) + 1e-3]))


def _epoch(weights: np.ndarray, free: np.ndarray, rows: list[np.ndarray], grades: np.ndarray, epoch: int) -> tuple[np.ndarray, np.ndarray]:
    """One pass of gradient steps over the rows of a partition, in an order drawn from the epoch."""
    w, free = weights.copy(), free.copy()
    # a start value keeps the steps of features that are met once or twice small
    seen, seen_free = np.full(len(w), float(START)), np.full(len(free), float(START))
    sizes = np.bincount(grades, minlength=len(free) + 1)
    # rare grades weigh more, by the root of what would make all grades equal
    balance = np.sqrt(len(grades) / (np.count_nonzero(sizes) * np.maximum(1, sizes)))
    order = np.random.default_rng(epoch).permutation(len(rows))
    for at in range(0, len(order), BATCH):
        take = order[at : at + BATCH]
        at_bucket = np.concatenate([rows[i] for i in take])
        of = np.repeat(np.arange(len(take)), [len(rows[i]) for i in take])
        score = np.bincount(of, weights=w[at_bucket], minlength=len(take))
        cuts = np.concatenate([[-np.inf], thresholds(free), [np.inf]])
        g = grades[take]
        upper, lower = sigmoid(cuts[g + 1] - score), sigmoid(cuts[g] - score)
        p = np.maximum(upper - lower, 1e-9)
        slope = (1 - upper - lower) * balance[g]  # of the loss in the score
        grad = np.bincount(at_bucket, weights=slope[of], minlength=len(w)) / len(take)
        touched = np.unique(at_bucket)
        grad[touched] += DECAY * w[touched]
        seen[touched] += grad[touched] ** 2
        w[touched] -= RATE * grad[touched] / np.sqrt(seen[touched])
        cut_grad = np.zeros(len(free))
        np.add.at(cut_grad, g[g < len(free)], (-upper * (1 - upper) / p * balance[g])[g < len(free)])
        np.add.at(cut_grad, g[g > 0] - 1, (lower * (1 - lower) / p * balance[g])[g > 0])
        # all later thresholds move with a gap
        moved = np.cumsum(cut_grad[::-1])[::-1] / len(take)
        moved[1:] *= sigmoid(free[1:])
        seen_free += moved**2
        free -= RATE * moved / np.sqrt(seen_free)
    return w, free


def _train(state, epoch: int):
    """``state``: weights and free thresholds, and the buckets that have a weight, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, free, kept = state.value
        rows, grades = [], []
        for batch in batches:
            lists = batch.column("buckets")
            flat, begin = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows += [placed(flat[a:b], kept) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            grades += batch.column("grade").to_pylist()
        if rows:
            w, free = _epoch(weights, free, rows, np.array(grades), epoch)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([np.concatenate([free, w]).tobytes()])], ["n", "state"])

    return run


def placed(buckets: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Places of the buckets that have a weight."""
    if not len(kept):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(kept, buckets), len(kept) - 1)
    return at[kept[at] == buckets]


def fit(graded: DataFrame, n_grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from at most about ``train_rows`` of the graded rows.

    Rows without a grade from 0 to ``n_grades - 1`` are left aside. Without any
    row the weights are zero and the thresholds those of equal grades.
    """
    spark = graded.sparkSession
    rows = graded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{grade}`").cast("int").alias("grade"))
    rows = rows.filter((F.col("grade") >= 0) & (F.col("grade") < n_grades))
    share = train_rows / max(1, rows.select("grade").count())
    if share < 1:
        rows = rows.filter(hash_unit(F.coalesce(F.col("key").cast("string"), F.lit(""))) < share)
    sample = settle(rows.select("text", "grade").mapInArrow(_featured(BITS), "grade int, buckets array<int>").repartition(PARTS, "buckets"), "features")
    free = np.zeros(n_grades - 1)
    free[0] = -np.log(n_grades - 1.0)
    often = sample.select(F.explode("buckets").alias("b")).groupBy("b").count().filter(F.col("count") >= MIN_ROWS)
    kept = np.sort(often.select("b").toArrow()["b"].to_numpy())  # at most 2 ** BITS
    weights = np.zeros(len(kept))
    for epoch in range(EPOCHS):
        state = spark.sparkContext.broadcast((weights, free, kept))
        parts = sample.mapInArrow(_train(state, epoch), "n bigint, state binary").collect()
        if not parts:
            break
        total = sum(p.n for p in parts)
        mean = sum(np.frombuffer(p.state) * (p.n / total) for p in parts)
        free, weights = mean[: n_grades - 1].copy(), mean[n_grades - 1 :].copy()
        state.unpersist()
    dense = np.zeros(1 << BITS)
    dense[kept] = weights
    return dense, thresholds(free)


def _scored(model, select_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = Hashes(), letters()
        weights, cuts = model.value
        for part in blocks(batches, "text"):
            doc, bucket = features(part.column("text"), hashes, kept)
            score = np.bincount(doc, weights=weights[bucket], minlength=part.num_rows)
            above = sigmoid(score[:, None] - cuts[None, :])
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(score), pa.array(above.sum(axis=1)), pa.array(above[:, select_from - 1])],
                ["key", "score", "expected_grade", "tail_probability"],
            )

    return run


def graded_quality(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray], select_from: int, least: float = 0.5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, score, expected_grade, tail_probability, kept)`` of every document.

    The tail is the probability of a grade of at least ``select_from``; a
    document is kept when it is at least ``least``. A null text counts as empty.
    Repeated rows and null keys are scored each on their own; an empty table
    gives an empty result; further columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(_scored(shared, select_from), f"key {kind}, score double, expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= least).withColumnRenamed("key", key)
