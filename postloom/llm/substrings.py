"""Repeated word windows across a corpus, by super-k-mers.

Every window of ``WINDOW`` words has a minimiser: the leftmost smallest hash of
the ``GRAM``-word grams inside it. Consecutive windows with the same minimiser
are a super-k-mer. A window that starts anywhere else again has a minimiser that
also stands in another super-k-mer, so the job

1. writes the place, minimiser and digest of every super-k-mer (a few bytes for
   some fifteen windows) and deals them out by minimiser,
2. counts equal super-k-mers there: all windows of a repeated one are repeated,
   and one of them stands for all in step 3,
3. packs the words of the different super-k-mers of a minimiser as one string
   each and sends it to the bucket of the minimiser,
4. sorts the windows in each bucket and finds those that occur twice.

A minimiser with more than ``HOT`` super-k-mers would be a bucket without bound.
Its super-k-mers are counted by digest, combined before the shuffle, and joined
with their counts, large keys being split by adaptive execution; their windows go
one by one, are counted in the same way, and meet their counts with a salt.
Nothing is left out.

Windows are equal when two independent 64-bit hashes of their words are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.llm.words import BLOCK_BYTES, Block, Hashes, as_long, blocks
from postloom.session import settle

WINDOW = 35
GRAM = 8
HOT = 2000
SALTS = 16
CHUNK = 1 << 16
STRINGS = 256  # packed strings whose bytes are hashed at once


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, where, span = values, np.arange(len(values)), 1
    while span < width:
        shift = min(span, width - span)
        a, b = least[:-shift], least[shift:]
        left = a <= b
        least, where = np.where(left, a, b), np.where(left, where[:-shift], where[shift:])
        span += shift
    return where[:n]


def super_kmers(block: Block, hashes: Hashes, digests: Hashes, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first word, number of windows, minimiser and digest of each super-k-mer of a block."""
    words = hashes.of_bytes(block.data, block.starts, block.ends)
    n = len(words) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    grams = hashes.windows(words, gram)
    at = leftmost_minima(grams, window - gram + 1)
    inside = np.flatnonzero(block.doc[:n] == block.doc[window - 1 :])
    if not len(inside):
        return super_kmers(Block(pa.array([], pa.string())), hashes, digests, window, gram)
    new = np.ones(len(inside), bool)
    new[1:] = (at[inside[1:]] != at[inside[:-1]]) | (np.diff(inside) != 1) | (block.doc[inside[1:]] != block.doc[inside[:-1]])
    first = np.flatnonzero(new)
    start = inside[first]
    doc = block.doc[start]
    n = np.diff(np.append(first, len(inside)))
    whole = digests.word_ranges(words, start, start + n + window - 1)
    return doc, start - block.first[doc], n, grams[at[start]], whole


def _places(key: str, text: str, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, digests = Hashes(), Hashes(second=True)
        for part in blocks(batches, text, BLOCK_BYTES // 2):
            doc, start, n, mini, whole = super_kmers(Block(part.column(text)), hashes, digests, window, gram)
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(pa.array(doc)), pa.array(start), pa.array(n.astype(np.int32)), as_long(mini), as_long(whole)],
                ["key", "start", "n", "mini", "whole"],
            )

    return run


def _packed(window: int):
    """Words of each super-k-mer of a text, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            out: dict[str, list] = {"key": [], "start": [], "n": [], "mini": [], "packed": []}
            part = part.filter(part.column("held").is_valid())
            if not part.num_rows:
                continue
            block = Block(part.column("text"))
            data = block.data.tobytes()
            for i, (key, held) in enumerate(zip(part.column("key").to_pylist(), part.column("held").to_pylist(), strict=True)):
                base = block.first[i]
                words = [data[a:b] for a, b in zip(block.starts[base : block.first[i + 1]], block.ends[base : block.first[i + 1]], strict=True)]
                for x in held:
                    out["key"].append(key)
                    for c in ("start", "n", "mini"):
                        out[c].append(x[c])
                    out["packed"].append(b" ".join(words[x["start"] : x["start"] + x["n"] + window - 1]))
            types = [part.schema.field("key").type, pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
            for at in range(0, len(out["key"]), 4096):
                yield pa.RecordBatch.from_arrays([a.slice(at, 4096) for a in arrays], list(out))

    return run


def _window_keys(packed: pa.Array, n: np.ndarray, window: int, families: tuple[Hashes, Hashes]):
    """Two hashes of every window of packed strings, with the string and the offset of the window."""
    block = Block(packed.cast(pa.large_binary()).view(pa.large_string()))
    start = np.repeat(block.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    row = np.repeat(np.arange(len(n)), n)
    one, two = (h.word_ranges(h.of_bytes(block.data, block.starts, block.ends), start, start + window) for h in families)
    return row, start - block.first[row], one, two


def _keys_by_parts(packed: pa.Array, n: np.ndarray, window: int, families: tuple[Hashes, Hashes]):
    """``_window_keys`` of few strings at a time, so that the arrays by byte stay small beside those by window."""
    parts = []
    for at in range(0, len(n), STRINGS):
        row, *rest = _window_keys(packed.slice(at, STRINGS), n[at : at + STRINGS], window, families)
        parts.append((row + at, *rest))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _repeated(window: int):
    """Stretches of windows that occur twice in their bucket; rows arrive sorted by minimiser."""

    def found(rows: pa.Table, families) -> pa.RecordBatch:
        n = rows.column("n").to_numpy()
        packed = rows.column("packed").combine_chunks()
        row, offset, one, two = _keys_by_parts(packed, n, window, families)
        mini = rows.column("mini").to_numpy()[row]
        order = np.lexsort((two, one, mini))
        same = (mini[order][1:] == mini[order][:-1]) & (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        hit = np.zeros(len(order), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(at)))
        row, offset = row[at[first]], offset[at[first]]
        begin = rows.column("start").to_numpy()[row] + offset
        keys = rows.column("key").combine_chunks().take(pa.array(row))
        return pa.RecordBatch.from_arrays([keys, pa.array(begin), pa.array(begin + length + window - 1)], ["key", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = (Hashes(), Hashes(second=True))
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held.append(part)
                windows += int(np.sum(part.column("n").to_numpy()))
                if windows < CHUNK:
                    continue
                rows = pa.Table.from_batches(held)
                mini = rows.column("mini").to_numpy()
                # all complete buckets; the last one may go on
                cut = int(np.flatnonzero(mini != mini[-1])[-1]) + 1 if (mini != mini[-1]).any() else 0
                if cut:
                    yield found(rows.slice(0, cut), families)
                held = rows.slice(cut).to_batches()
                windows = int(np.sum(rows.slice(cut).column("n").to_numpy()))
        if held:
            yield found(pa.Table.from_batches(held), families)

    return run


def _single_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = (Hashes(), Hashes(second=True))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, offset, one, two = _keys_by_parts(part.column("packed"), part.column("n").to_numpy(), window, families)
                begin = part.column("start").to_numpy()[row] + offset
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(row)), pa.array(begin), as_long(one), as_long(two)], ["key", "begin", "one", "two"]
                )

    return run


def _texts(docs: DataFrame, key: str, text: str, keep: Sequence[str]) -> DataFrame:
    """The same columns for every join, so that all of them read one exchange of the texts."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *kept)


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, keep: Sequence[str] = ()
) -> DataFrame:
    """``(key, spans)`` of the texts that hold a repeated window: ``array<struct<begin, end>>`` of word positions.

    A window is ``window`` consecutive words of one text; it is repeated when the
    same words also start anywhere else, in the same text too. Spans may overlap.
    Null, empty and short texts have no window and no row. Keys must be unique and
    not null. Further columns of ``docs`` are not read (``keep`` names some that
    travel with the texts); an empty table gives none.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts = _texts(docs, key, text, keep)
    places = settle(
        texts.select("key", "text").mapInArrow(_places("key", "text", window, gram), f"key {kind}, start bigint, n int, mini bigint, whole bigint"), "super-k-mers"
    )
    often = settle(places.groupBy("mini").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot).select("mini"), "hot-minimisers")
    any_hot = not often.isEmpty()

    cold = places.join(often, "mini", "left_anti") if any_hot else places
    same, bucket = Window.partitionBy("mini", "whole"), Window.partitionBy("mini")
    # one exchange by minimiser serves both windows; a bucket has at most ``hot`` rows
    cold = cold.repartition("mini").select(
        "key", "start", "n", "mini", F.count(F.lit(1)).over(same).alias("c"), F.min("key").over(same).alias("first"),
        (F.min("whole").over(bucket) != F.max("whole").over(bucket)).alias("differ"),
    )
    cold = settle(cold.filter("c > 1 or differ"), "repeated-minimisers")

    def ranges(rows: DataFrame) -> DataFrame:
        return rows.filter("c > 1").select("key", F.col("start").alias("begin"), (F.col("start") + F.col("n") + (window - 1)).alias("end"))

    def packed(travel: DataFrame) -> DataFrame:
        held = travel.groupBy("key").agg(F.collect_list(F.struct("start", "n", "mini")).alias("held"))
        # a left join, like that of without_repeats: an inner one would read another exchange of the texts
        return texts.join(held, "key", "left").mapInArrow(_packed(window), f"key {kind}, start bigint, n int, mini bigint, packed binary")

    several = ranges(cold)
    dealt = packed(cold.filter("differ and key = first")).repartition("mini").sortWithinPartitions("mini")
    spans = dealt.mapInArrow(_repeated(window), f"key {kind}, begin bigint, end bigint")
    if any_hot:
        # one branch after another, so that not all their workers are alive at once
        spans = settle(spans, "cold-spans")
        rows = settle(places.join(often, "mini"), "hot-super-k-mers")
        strings = settle(rows.groupBy("mini", "whole").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("first")), "hot-strings")
        rows = settle(rows.join(strings, ["mini", "whole"]).drop("whole"), "hot-places")
        several = several.union(ranges(rows))
        single = packed(rows.filter("key = first")).mapInArrow(_single_windows(window), f"key {kind}, begin bigint, one bigint, two bigint")
        single = settle(single, "hot-windows")
        twice = single.groupBy("one", "two").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("one", "two")
        twice = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        single = single.withColumn("salt", F.pmod(F.xxhash64("key", "begin"), F.lit(SALTS)).cast("int"))
        single = single.join(twice, ["one", "two", "salt"])
        spans = spans.union(single.select("key", "begin", (F.col("begin") + window).alias("end")))
    spans = spans.union(several)
    return spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans")).withColumnRenamed("key", key)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        block = Block(part.column("text"))
        data = block.data.tobytes()
        n, removed, kept = [], [], []
        for i, spans in enumerate(part.column("spans").to_pylist()):
            a, b = block.first[i], block.first[i + 1]
            keep = np.ones(b - a, bool)
            for s in spans or ():
                keep[s["begin"] : s["end"]] = False
            n.append(int(b - a))
            removed.append(int((~keep).sum()))
            at = np.flatnonzero(keep) + a
            kept.append(b" ".join([data[s:e] for s, e in zip(block.starts[at].tolist(), block.ends[at].tolist(), strict=True)]))
        kept_names = [c for c in part.schema.names if c.startswith("k") and c != "key"]
        arrays = [part.column("key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())]
        yield pa.RecordBatch.from_arrays(arrays + [part.column(c) for c in kept_names], ["key", "n_words", "n_removed", "kept_text", *kept_names])


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, keep: Sequence[str] = ()
) -> DataFrame:
    """``(key, n_words, n_removed, kept_text, kept columns)`` for every text: each word covered by a repeated window goes.

    Kept words are joined by one space. A null text counts as one without words
    and gives an empty text. ``keep`` names columns that come along. See
    ``repeated_spans``.
    """
    kind = docs.schema[key].dataType.simpleString()
    spans = repeated_spans(docs, key, text, window, gram, hot, keep).withColumnRenamed(key, "key")
    fields = "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = _texts(docs, key, text, keep).join(spans, "key", "left")
    out = out.mapInArrow(_cut, f"key {kind}, n_words bigint, n_removed bigint, kept_text string{fields}")
    return out.select(F.col("key").alias(key), "n_words", "n_removed", "kept_text", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
