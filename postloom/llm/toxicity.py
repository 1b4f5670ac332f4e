"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of words. Each word enters the network as
a learned vector of the word and one of its characters (trigrams with word
edges). Two gated recurrent layers read a window from either side, attention
weighs their states, and one unit gives the probability that the window is
toxic. The score of a text is that of its worst window, so length alone makes no
text toxic, and every word is read whatever the length.

Training is in numpy inside Spark tasks, on a sample of at most about
``TRAIN_ROWS`` labelled rows. A label belongs to a whole text: the most suspicious
windows of a text are taken to cause it together (one minus the product of what
is left), and the gradient goes to them. Each epoch is one Spark job; every
partition streams its rows from the shared weights on, and weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.columns import hash_unit
from postloom.llm.words import Block, Hashes, blocks
from postloom.session import settle

TRAIN_ROWS = 12_000
VISITS = 36_000
PARTS = 4
WINDOW, STEP = 32, 16
WORD, CHAR, HIDDEN = 8, 8, 8
INPUT, GATES = WORD + CHAR, 3 * HIDDEN
MIN_ROWS = 4
WORD_BITS, CHAR_BITS = 20, 14
WORST = 8
BATCH = 8
RATE, TABLE_RATE = 0.02, 0.5
START_BIAS = -3.0
RARE = 2.0
SLICE = 4096
PIECE = 1 << 18


def letters() -> np.ndarray:
    """Bytes of words: ASCII letters and digits, marks that stand for letters, and all bytes of other characters."""
    out = np.zeros(256, bool)
    out[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789*@$'")] = True
    out[128:] = True
    return out


class Words:
    """Words of a block of texts: their slots in the word table, their trigrams, and the windows of each text."""

    def __init__(self, texts: pa.Array, hashes: Hashes, places: np.ndarray | None, kept: np.ndarray):
        self.block = Block(texts, lower=True, kept=kept)
        b = self.block
        self.bucket = (hashes.of_bytes(b.data, b.starts, b.ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        self.slot = places[self.bucket] if places is not None else None
        n = b.n_words
        many = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
        self.doc = np.repeat(np.arange(len(n)), many)
        turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.start = b.first[:-1][self.doc] + STEP * turn
        self.length = np.minimum(WINDOW, n[self.doc] - STEP * turn)

    def trigrams(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Place in ``ids`` and bucket of the trigrams of some words, a bounded number of bytes at a time."""
        starts, ends, data = self.block.starts[ids], self.block.ends[ids], self.block.data
        before = np.concatenate([[0], np.cumsum(ends - starts)])
        shift = starts - before[:-1]
        for lo in range(0, int(before[-1]), PIECE):
            hi = min(lo + PIECE, int(before[-1]))
            first, last = np.searchsorted(before, [lo, hi - 1], "right") - 1
            sizes = np.minimum(before[first + 1 : last + 2], hi) - np.maximum(before[first : last + 1], lo)
            word = np.repeat(np.arange(first, last + 1), sizes)
            at = np.arange(lo, hi) + shift[word]
            key = data[at].astype(np.uint32) << np.uint32(8)
            key |= np.where(at > starts[word], data[at - 1], 0).astype(np.uint32) << np.uint32(16)
            key |= np.where(at + 1 < ends[word], data[np.minimum(at + 1, len(data) - 1)], 0).astype(np.uint32)
            yield word, (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)

    def char_vectors(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Sums of trigram vectors over the root of their number."""
        out = np.zeros((len(ids), CHAR), np.float32)
        for word, bucket in self.trigrams(ids):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[head]] += np.add.reduceat(table[bucket], head, axis=0)
        return out / self.root(ids)

    def root(self, ids: np.ndarray) -> np.ndarray:
        return np.sqrt((self.block.ends[ids] - self.block.starts[ids]).astype(np.float32))[:, None]

    def inputs(self, ids: np.ndarray, net: dict) -> np.ndarray:
        """Input vectors of some words, features first; at least one column."""
        if not len(ids):
            return np.zeros((INPUT, 1), np.float32)
        return np.ascontiguousarray(np.concatenate([net["words"][self.slot[ids]], self.char_vectors(ids, net["chars"])], axis=1).T)


SHAPES = {
    "words": (None, WORD), "chars": (1 << CHAR_BITS, CHAR), "wf": (GATES, INPUT), "wb": (GATES, INPUT), "bf": (GATES, 1), "bb": (GATES, 1),
    "uf": (GATES, HIDDEN), "ub": (GATES, HIDDEN), "attend": (2 * HIDDEN,), "out": (2 * HIDDEN,), "bias": (1,),
}
TABLES = ("words", "chars")


def start(n_words: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {}
    for name, shape in SHAPES.items():
        shape = tuple(n_words if s is None else s for s in shape)
        net[name] = (rng.normal(size=shape) * (0.1 if name in TABLES else 1 / np.sqrt(shape[-1]))).astype(np.float32)
    for name in ("bf", "bb"):
        net[name][:] = 0
    net["bias"][:] = START_BIAS
    return net


def packed(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[name].ravel() for name in SHAPES])


def unpacked(flat: np.ndarray, n_words: int) -> dict[str, np.ndarray]:
    net, at = {}, 0
    for name, shape in SHAPES.items():
        shape = tuple(n_words if s is None else s for s in shape)
        size = int(np.prod(shape))
        net[name] = flat[at : at + size].reshape(shape).copy()
        at += size
    return net


def sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.tanh(x * x.dtype.type(0.5))
    out += 1
    out *= 0.5
    return out


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the columns of ``values`` by row number."""
    return np.stack([np.bincount(rows, weights=v, minlength=n) for v in values.T], axis=1).astype(values.dtype)


def _layer(steps: list[np.ndarray], u: np.ndarray, mask: np.ndarray | None, trace: list | None) -> list[np.ndarray]:
    """States of a gated recurrent layer after each step; ``mask`` sets the state to zero where a window has no word."""
    h = np.zeros((HIDDEN, steps[0].shape[1]), steps[0].dtype)
    out = []
    for t, x in enumerate(steps):
        g = u @ h
        zr = sigmoid(x[: 2 * HIDDEN] + g[: 2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = r * g[2 * HIDDEN :]
        n += x[2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if mask is not None:
            new *= mask[t]
        if trace is not None:
            trace.append((h, z, r, n, g[2 * HIDDEN :]))
        out.append(new)
        h = new
    return out


def forward(x: np.ndarray, start_: np.ndarray, length: np.ndarray, net: dict, trace: dict | None = None) -> np.ndarray:
    """Logit of each window over the input vectors ``x``; a window without words has the bias alone."""
    pf, pb = net["wf"] @ x + net["bf"], net["wb"] @ x + net["bb"]
    most = max(1, int(length.max(initial=1)))
    at = start_ + np.minimum(np.arange(most)[:, None], np.maximum(length - 1, 0))
    mask = np.arange(most)[:, None] < length
    for_, back = ([], []) if trace is not None else (None, None)
    hf = _layer([np.take(pf, i, axis=1) for i in at], net["uf"], None, for_)
    hb = _layer([np.take(pb, i, axis=1) for i in at[::-1]], net["ub"], mask[::-1].astype(x.dtype), back)[::-1]
    states = np.concatenate([np.stack(hf), np.stack(hb)], axis=1)  # steps, states, windows
    weight = np.where(mask, np.einsum("tkb,k->tb", states, net["attend"]), -np.inf)
    weight = np.exp(weight - np.where(length > 0, weight.max(axis=0), 0))
    weight /= np.maximum(weight.sum(axis=0), 1e-30)
    pooled = np.einsum("tkb,tb->kb", states, weight)
    if trace is not None:
        trace.update(at=at, mask=mask, forward=for_, backward=back, states=states, weight=weight, pooled=pooled)
    return net["out"] @ pooled + net["bias"][0]


def _layer_back(grads: np.ndarray, trace: list, u: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients in the inputs of the steps and in ``u``, from those in the states."""
    du, dx = np.zeros_like(u), np.empty((len(trace), GATES, grads.shape[2]), grads.dtype)
    dh = np.zeros_like(grads[0])
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, n, g = trace[t]
        dh = dh + grads[t]
        if mask is not None:
            dh = dh * mask[t]
        dn = dh * (1 - z) * (1 - n * n)
        dx[t, :HIDDEN] = dh * (h - n) * z * (1 - z)
        dx[t, HIDDEN : 2 * HIDDEN] = dn * g * r * (1 - r)
        dx[t, 2 * HIDDEN :] = dn
        dg = dx[t].copy()
        dg[2 * HIDDEN :] *= r
        du += dg @ h.T
        dh = dh * z + u.T @ dg
    return dx, du


def backward(slope: np.ndarray, x: np.ndarray, net: dict, trace: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the dense weights and of the input vectors, from those of the logits."""
    at, mask, states, weight, pooled = (trace[k] for k in ("at", "mask", "states", "weight", "pooled"))
    out = {"out": pooled @ slope, "bias": slope.sum(keepdims=True)}
    dpool = np.outer(net["out"], slope)
    part = np.einsum("tkb,kb->tb", states, dpool)
    dweight = weight * (part - (weight * part).sum(axis=0))
    out["attend"] = np.einsum("tkb,tb->k", states, dweight)
    dstate = weight[:, None, :] * dpool + dweight[:, None, :] * net["attend"][:, None]
    df, out["uf"] = _layer_back(dstate[:, :HIDDEN], trace["forward"], net["uf"], None)
    db, out["ub"] = _layer_back(dstate[:, HIDDEN:][::-1], trace["backward"], net["ub"], mask[::-1].astype(x.dtype))
    dx = np.zeros_like(x)
    for name, grad, places in (("f", df, at), ("b", db, at[::-1])):
        flat = grad.transpose(1, 0, 2).reshape(GATES, -1)
        taken = x[:, places.ravel()]
        out["w" + name] = flat @ taken.T
        out["b" + name] = flat.sum(axis=1, keepdims=True)
        dx += summed(places.ravel(), (net["w" + name].T @ flat).T, x.shape[1]).T
    return out, dx


def logits(words: Words, net: dict) -> np.ndarray:
    """Logit of every window, a bounded number of windows at a time."""
    out = np.empty(len(words.start), np.float32)
    for at in range(0, len(out), SLICE):
        s, n = words.start[at : at + SLICE], words.length[at : at + SLICE]
        p, q = int(s.min()), int((s + n).max())
        out[at : at + SLICE] = forward(words.inputs(np.arange(p, q), net), s - p, n, net)
    return out


def worst(doc: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` windows of the highest score of every text."""
    order = np.lexsort((-score, doc))
    begin = np.searchsorted(doc[order], doc[order])
    return np.sort(order[np.arange(len(order)) - begin < most])


class Trainer:
    """Gradient steps on one network: Adam for dense weights, steps scaled by past gradients for touched rows of the tables."""

    def __init__(self, net: dict):
        self.net, self.turn = net, 0
        self.first = {k: np.zeros_like(v) for k, v in net.items() if k not in TABLES}
        self.second = {k: np.zeros_like(v) for k, v in net.items()}

    def table(self, name: str, rows: np.ndarray, grads: np.ndarray) -> None:
        touched, place = np.unique(rows, return_inverse=True)
        total = summed(place, grads, len(touched))
        self.second[name][touched] += total**2
        self.net[name][touched] -= TABLE_RATE * total / np.sqrt(self.second[name][touched] + 1e-4)

    def dense(self, grads: dict) -> None:
        self.turn += 1
        for name, g in grads.items():
            self.first[name] += 0.1 * (g - self.first[name])
            self.second[name] += 0.01 * (g * g - self.second[name])
            m, v = self.first[name] / (1 - 0.9**self.turn), self.second[name] / (1 - 0.99**self.turn)
            self.net[name] -= RATE * m / (np.sqrt(v) + 1e-6)

    def step(self, words: Words, labels: np.ndarray) -> None:
        """One step on some texts."""
        score = logits(words, self.net)
        take = worst(words.doc, score, WORST)
        doc = words.doc[take]
        # toxic texts are rare and weigh more
        slope = slopes(score[take], doc, labels) * np.where(labels[doc] == 1, RARE, 1) / len(labels)
        # the words of these windows alone, one after another
        length = words.length[take]
        begin = np.cumsum(length) - length
        places = np.repeat(words.start[take] - begin, length) + np.arange(int(length.sum()))
        if not len(places):
            return
        x = words.inputs(places, self.net)
        trace: dict = {}
        forward(x, begin, length, self.net, trace)
        grads, dx = backward(slope.astype(np.float32), x, self.net, trace)
        self.dense(grads)
        self.table("words", words.slot[places], dx[:WORD].T)
        per_word = dx[WORD:].T / words.root(places)
        for word, bucket in words.trigrams(places):
            self.table("chars", bucket, per_word[word])


def slopes(score: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope of the loss in the logits, when the windows of a text cause its label together."""
    p = sigmoid(score.astype(float))
    clean = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(labels))
    any_ = np.maximum(-np.expm1(clean), 1e-9)
    return np.where(labels[doc] == 1, -(np.exp(clean) / any_)[doc] * p, p)


def _epoch(state):
    """``state``: packed weights, size of the word table, and the slots of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, n_words, places = state.value
        trainer, hashes, kept, seen = Trainer(unpacked(flat, n_words)), Hashes(), letters(), 0
        for part in blocks(batches, "text"):
            for at in range(0, part.num_rows, BATCH):
                some = part.slice(at, BATCH)
                labels = some.column("label").to_numpy()
                trainer.step(Words(some.column("text"), hashes, places, kept), labels)
                seen += len(labels)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([packed(trainer.net).tobytes()], pa.binary())], ["n", "state"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of the different words of every text."""
    hashes, kept = Hashes(), letters()
    for part in blocks(batches, "text"):
        words = Words(part.column("text"), hashes, None, kept)
        pairs = np.unique((words.block.doc.astype(np.int64) << WORD_BITS) + words.bucket)
        yield pa.RecordBatch.from_arrays([pa.array((pairs & ((1 << WORD_BITS) - 1)).astype(np.int32))], ["b"])


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, int, np.ndarray]:
    """A network from at most about ``train_rows`` of the rows whose label is 0 or 1, drawn by key hash.

    Rows are visited about ``VISITS`` times in all, three to twelve times each. Words of fewer than
    ``MIN_ROWS`` rows share one vector. Without any row the network is as it began.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("int").alias("label"))
    rows = rows.filter("label in (0, 1)")
    share = train_rows / max(1, rows.select("label").count())
    if share < 1:
        rows = rows.filter(hash_unit(F.col("key")) < share)
    sample = settle(rows, "labelled")
    n = sample.select("label").count()
    often = sample.select("text").mapInArrow(_buckets, "b int").groupBy("b").count().filter(F.col("count") >= MIN_ROWS)
    known = np.sort(often.select("b").toArrow()["b"].to_numpy())  # at most 2 ** WORD_BITS
    places = np.zeros(1 << WORD_BITS, np.int32)
    places[known] = np.arange(1, len(known) + 1)
    n_words = len(known) + 1
    flat = packed(start(n_words))
    for epoch in range(min(12, max(3, -(-VISITS // max(1, n)))) if n else 0):
        state = spark.sparkContext.broadcast((flat, n_words, places))
        # dealt without a key, so that no setting makes more partitions, each with a network for the driver
        turn = sample.repartition(PARTS).sortWithinPartitions(F.xxhash64("key", F.lit(epoch)), "text", "label")
        parts = turn.mapInArrow(_epoch(state), "n bigint, state binary").collect()
        flat = sum(np.frombuffer(p.state, np.float32) * np.float32(p.n / n) for p in sorted(parts, key=lambda p: (p.n, p.state)))
        state.unpersist()
    return flat, n_words, places


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, n_words, places = model.value
        net, hashes, kept = unpacked(flat, n_words), Hashes(), letters()
        for part in blocks(batches, "text"):
            words = Words(part.column("text"), hashes, places, kept)
            begin = np.searchsorted(words.doc, np.arange(part.num_rows))
            high = np.maximum.reduceat(logits(words, net), begin)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sigmoid(high.astype(float)))], ["key", "score"])

    return run


def toxicity(docs: DataFrame, model: tuple[np.ndarray, int, np.ndarray], key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``(key, score, predicted)`` of every text: the probability of its worst window, and 1 where it is at least ``least``.

    Null texts count as empty; a text without words is one window without words. Repeated rows and null keys are scored
    each on their own; an empty table gives an empty result; further columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(_scored(shared), f"key {kind}, score double")
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= least).cast("int").alias("predicted"))
