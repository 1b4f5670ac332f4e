"""Quality rules: how far a document's characters and common words diverge from its language.

The language references are counted on all documents: shares of character
classes, and shares of the words that make up at least ``COMMON_SHARE`` of a
language (at most ``1 / COMMON_SHARE`` of them). A document is compared by the
Jensen-Shannon distance (base 2, 0 to 1) of its histograms to those of its
language. A text without any common word has a distance that follows from the
language alone; the bound of the words is ``WORD_SHARE`` of that, so that such
texts go. Short documents have rough histograms, so each comparison has a guard
of its own length; below it, and for languages without a reference of
``REFERENCE_WORDS`` words, the comparison passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import Block, Hashes, as_long, blocks
from postloom.session import settle

MIN_WORDS = 50
REPEAT_PERCENT = 50
COMMON_SHARE = 0.005
REFERENCE_WORDS = 5000
CHAR_GUARD = 200  # code points
WORD_GUARD = 80  # words
CHAR_DISTANCE = 0.25
WORD_SHARE = 0.9  # of the distance of a text without a common word
WORD_LEAST = 0.25  # bound of languages whose common words are too few to tell
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "other")
FLUSH = 1 << 20


def class_table() -> np.ndarray:
    """The class of a character by its first byte; continuation bytes count for none."""
    out = np.full(256, CLASSES.index("punctuation"), np.int64)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[32, 9, 10, 11, 12, 13]] = 3
    out[list(SYMBOLS)] = 4
    out[128:192] = len(CLASSES)
    out[192:] = CLASSES.index("other")
    return out


def class_counts(block: Block, table: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    doc = np.repeat(np.arange(block.n_texts), np.diff(block.offsets))
    width = len(CLASSES) + 1
    flat = np.bincount(doc * width + table[block.data], minlength=block.n_texts * width)
    return flat.reshape(block.n_texts, width)[:, :-1]


def repeated_words(block: Block, words: np.ndarray, hashes: Hashes, size: int = 3) -> np.ndarray:
    """Words of each text inside ``size``-word windows that the text has twice or more."""
    wins = hashes.windows(words, size)
    inside = np.flatnonzero(block.doc[: len(wins)] == block.doc[size - 1 :]) if len(wins) else np.empty(0, np.int64)
    doc, h = block.doc[inside], wins[inside]
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + size, bool)
    for k in range(size):
        covered[inside[twice] + k] = True
    return np.bincount(block.doc[covered[: len(words)]], minlength=block.n_texts)


def repeated_lines(block: Block, hashes: Hashes) -> np.ndarray:
    """Lines of each text that have a word and equal an earlier line."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.concatenate([block.offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, block.offsets[1:]])
    doc = np.concatenate([np.arange(block.n_texts), np.searchsorted(block.offsets, breaks, "right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = ends[np.lexsort((ends, np.concatenate([np.searchsorted(block.offsets, breaks, "right") - 1, np.arange(block.n_texts)])))]
    filled = np.searchsorted(block.starts, starts) < np.searchsorted(block.starts, ends)
    starts, ends, doc = starts[filled], ends[filled], doc[filled]
    h = hashes.of_bytes(block.data, starts, ends)
    order = np.lexsort((h, doc))
    again = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return np.bincount(doc[order][1:][again], minlength=block.n_texts)


def _reference_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: words (kind 0), characters of a class (kind 1)."""
    hashes, table = Hashes(), class_table()
    words: dict[str | None, list] = {}
    chars: dict[str | None, np.ndarray] = {}

    def rows(kind: int, lang, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), 1 << 17):
            c, m = codes[at : at + (1 << 17)], n[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(c), kind, np.int8)), pa.array([lang] * len(c), pa.string()), as_long(c), pa.array(m)], ["kind", "lang", "code", "n"]
            )

    def merged(pairs: list) -> tuple[np.ndarray, np.ndarray]:
        values, n = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.argsort(values)
        values, n = values[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return values[at], np.add.reduceat(n, at)

    held = 0
    for part in blocks(batches, "text"):
        block = Block(part.column("text"), lower=False)
        counts = class_counts(block, table)
        lowered = Block(part.column("text"), lower=True)
        h = hashes.of_bytes(lowered.data, lowered.starts, lowered.ends)
        langs = np.array(part.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            of = np.array([x == lang for x in langs.tolist()])
            chars[lang] = chars.get(lang, 0) + counts[of].sum(axis=0)
            found = h[of[block.doc]]
            if len(found):
                words.setdefault(lang, []).append(np.unique(found, return_counts=True))
                held += len(words[lang][-1][0])
        if held > 2 * FLUSH:
            held = 0
            for lang, pairs in list(words.items()):
                pair = merged(pairs)
                words[lang] = [pair]
                held += len(pair[0])
            if held > FLUSH:
                for lang, pairs in words.items():
                    yield from rows(0, lang, *pairs[0])
                words, held = {}, 0
    for lang, pairs in words.items():
        yield from rows(0, lang, *merged(pairs))
    for lang, n in chars.items():
        yield from rows(1, lang, np.arange(len(CLASSES), dtype=np.uint64), n.astype(np.int64))


def references(texts: DataFrame) -> dict:
    """Per language: shares of classes, sorted common words and their shares (the rest last), and the bound of the word distance."""
    counts = settle(texts.mapInArrow(_reference_counts, "kind tinyint, lang string, code bigint, n bigint").groupBy("kind", "lang", "code").agg(F.sum("n").alias("n")), "references")
    words = counts.filter("kind = 0 and lang is not null")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= REFERENCE_WORDS)
    common = words.join(totals, "lang").filter(F.col("n") >= COMMON_SHARE * F.col("total")).select("lang", "code", (F.col("n") / F.col("total")).alias("share"))
    chars = counts.filter("kind = 1").join(totals, "lang").select("lang", "code", "n")
    out: dict = {}
    for r in chars.toLocalIterator():
        out.setdefault(r.lang, {"classes": np.zeros(len(CLASSES)), "words": []})["classes"][r.code] = r.n
    for r in common.toLocalIterator():
        out[r.lang]["words"].append((r.code & (2**64 - 1), r.share))
    for ref in out.values():
        ref["classes"] = ref["classes"] / ref["classes"].sum()
        codes = np.array([c for c, _ in ref["words"]], np.uint64)
        shares = np.array([s for _, s in ref["words"]])
        order = np.argsort(codes)
        ref["words"] = codes[order], np.append(shares[order], max(0.0, 1 - shares.sum()))
        ref["word_bound"] = word_bound(ref["words"][1])
    return out


def distance(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the shares; 0 for rows without counts."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + shares) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(shares > 0, shares * np.log2(shares / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(0, (left + right) / 2)), 0.0)


def word_bound(shares: np.ndarray) -> float:
    """Bound of the word distance, from the shares of common words and the rest (last)."""
    none = np.zeros((1, len(shares)))
    none[0, -1] = 1
    return max(WORD_LEAST, WORD_SHARE * float(distance(none, shares)[0]))


def _rules(found):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, refs = Hashes(), class_table(), found.value
        for part in blocks(batches, "text"):
            block = Block(part.column("text"))
            words = hashes.of_bytes(block.data, block.starts, block.ends)
            n = block.n_words
            leads = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
            chars = np.bincount(block.doc, weights=leads[block.ends] - leads[block.starts], minlength=block.n_texts).astype(np.int64)
            classes = class_counts(block, table)
            repeats = repeated_words(block, words, hashes)
            lowered = Block(part.column("text"), lower=True)
            h = hashes.of_bytes(lowered.data, lowered.starts, lowered.ends)
            char_far, word_far = np.full(block.n_texts, np.nan), np.full(block.n_texts, np.nan)
            bound = np.full(block.n_texts, np.inf)
            langs = part.column("lang").to_pylist()
            for lang in set(langs) & set(refs):
                of = np.array([x == lang for x in langs])
                codes, shares = refs[lang]["words"]
                mine = of[block.doc]
                at = np.minimum(np.searchsorted(codes, h[mine]), max(0, len(codes) - 1))
                at = np.where(codes[at] == h[mine], at, len(codes)) if len(codes) else np.zeros(int(mine.sum()), np.int64)
                width = len(shares)
                hist = np.bincount(block.doc[mine] * width + at, minlength=block.n_texts * width).reshape(block.n_texts, width)[of]
                char_far[of] = np.where(classes[of].sum(axis=1) >= CHAR_GUARD, distance(classes[of], refs[lang]["classes"]), np.nan)
                bound[of] = refs[lang]["word_bound"]
                word_far[of] = np.where(n[of] >= WORD_GUARD, distance(hist, shares), np.nan)
            base = (n < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
            far = (np.nan_to_num(char_far) > CHAR_DISTANCE) | (np.nan_to_num(word_far) > bound)
            out = [n, chars, classes[:, CLASSES.index("symbol")], repeated_lines(block, hashes), repeats, base, ~base & ~far]
            arrays = [pa.array(x) for x in out] + [pa.array(x, mask=np.isnan(x)) for x in (char_far, word_far)]
            kept = [c for c in part.schema.names if c not in ("key", "text", "lang")]
            yield pa.RecordBatch.from_arrays([part.column("key"), *arrays, *(part.column(c) for c in kept)], [*NAMES, *kept])

    return run


NAMES = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: Sequence[str] = ()) -> DataFrame:
    """Counts, distances and verdict of every document, and the columns named in ``keep``.

    A document fails the base rules with fewer than ``MIN_WORDS`` words, or when
    more than ``REPEAT_PERCENT`` per cent of them are in repeated three-word
    windows; it is kept when it passes them and no distance is over its bound.
    Null texts have no words. A null language, or one without a reference, has
    null distances, as has a document below a guard. Repeated rows and null keys
    are judged each on its own; an empty table gives an empty result; further
    columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), *kept)
    found = docs.sparkSession.sparkContext.broadcast(references(texts.select("text", "lang")))
    fields = ", ".join(f"{c} bigint" for c in NAMES[1:6]) + ", base_failed boolean, kept boolean, char_distance double, word_distance double"
    fields += "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = texts.mapInArrow(_rules(found), f"key {kind}, {fields}")
    return out.select(F.col("key").alias(key), *NAMES[1:], *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
