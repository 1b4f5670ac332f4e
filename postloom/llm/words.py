"""Words, hashes of words and of word windows, for whole Arrow batches at once.

Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; in UTF-8 these
separators are single bytes that occur in no other character, so texts are cut
without decoding. Null texts have no words. Batches are worked in blocks of a
bounded number of bytes; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SECOND_BASE, _SECOND_STEP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


# Sums modulo 2 ** 64 meet for certain different sequences of 2 ** 10 values, whatever the step; shorter ones do not.
LONG = 64


class Rolling:
    """Hashes of all ranges of a sequence of 64-bit values.

    Ranges of up to ``LONG`` values are sums of value times a power of an odd step, modulo 2**64, spread afterwards.
    Longer ones, for which such sums can be made to meet, are hashed by xxhash over their values, with a seed of the step.
    """

    def __init__(self, step: np.uint64):
        self.step, self.back = step, np.uint64(_inverse(int(step)))
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.step, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.back, np.uint64)]))

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: np.ndarray | None = None) -> np.ndarray:
        """``raw`` is a shorter form of the values for long ranges, such as the bytes they stand for."""
        raw = np.ascontiguousarray(values if raw is None else raw)
        self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        out = mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > LONG):
            out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], int(self.step) & 0xFFFFFFFF)
        return out


class Hashes:
    """One family of hashes; ``second=True`` gives one that is independent of the first."""

    def __init__(self, second: bool = False):
        base, step = (_SECOND_BASE, _SECOND_STEP) if second else (_BASE, _STEP)
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * base)
        self.bytes_, self.words_ = Rolling(step), Rolling(mixed(np.array([step], np.uint64))[0] | np.uint64(1))

    def of_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.bytes_.ranges(self.table[data], starts, ends, data)

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on, for as many starts as there are."""
        n = max(0, len(words) - k + 1)
        starts = np.arange(n)
        return self.words_.ranges(words, starts, starts + k)

    def word_ranges(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.words_.ranges(words, starts, ends)


class Block:
    """Texts of one block: their bytes, and where words begin and end.

    ``doc`` is the text of each word, ``first`` the number of words before each
    text. ``kept`` names other word bytes than those that are no white space.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, kept: np.ndarray | None = None):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        if lower:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        self.data = data
        gap = (data == 32) | ((data >= 9) & (data <= 13)) if kept is None else ~kept[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        word = ~gap
        before = np.concatenate([[True], gap[:-1]]) if len(gap) else gap
        after = np.concatenate([gap[1:], [True]]) if len(gap) else gap
        self.starts = np.flatnonzero(word & (before | edge[:-1]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, self.offsets, "left")
        self.n_texts = len(texts)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each part have ``size`` bytes at most, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def ragged(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
