"""Token ids in binary files: one zstandard dictionary for all, one frame for each document.

A file has the magic, the SHA-256 of the dictionary, one frame for each document
in ascending key order, an index (key, offset and length of the frame, number of
ids before it, number of ids) and a trailer with the place of the index. A
document is read by its index entry alone: a range of the file, decompressed
with the dictionary that the hash names. Ids are little-endian unsigned 32-bit.

The dictionary is trained on whole documents: the ``TRAIN_DOCS`` of smallest key
hash among those of at most ``TRAIN_DOC_BYTES``. It changes the size of the files
only; all documents are encoded and written.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.llm.files import make_folder, opened, task_file
from postloom.llm.words import BLOCK_BYTES, blocks
from postloom.session import scratch_path, settle

MAGIC = b"TOKZ0001"
TRAIN_DOCS = 2000
TRAIN_DOC_BYTES = 8 << 10
DICTIONARY_BYTES = 64 << 10
KNOWN_PIECES = 500_000
LEVEL = 1
JOINED = 2000  # pieces that the library gets as one text
SPACE_LETTER = "\u0120"  # of byte-level vocabularies
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
INDEX = np.dtype([("key", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("before", "<u8"), ("n", "<u4")])
MANIFEST = "path string, first bigint, last bigint, n_docs bigint, n_tokens bigint, size bigint"


class TextEncoder:
    """Ids of whole texts by the tokenizers library.

    The pattern of this vocabulary always cuts before a single space between two
    other characters, so texts are cut there, and a piece is encoded once while
    the store of known pieces is not full. New pieces go to the library as one
    text: tokens that begin with a space tell where each of them starts. Texts
    with other white space beside a space, or with a special token, go to the
    library whole. The pattern also cuts between letters and the marks after
    them, so words and marks are encoded apart.
    """

    def __init__(self, path: str, known_pieces: int = KNOWN_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(SPACE_LETTER)]] = True
        self.limit, self.round = known_pieces, 0
        self.known: dict[str, int] = {}  # a piece after a space, and its place among the stored ids
        self.first: dict[str, bytes] = {}
        self.marks: dict[str, np.ndarray] = {}
        self.flat, self.start, self.n, self.used = np.empty(0, np.uint32), *(np.empty(0, np.int64) for _ in range(3))

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced_ids(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of pieces after a space, and their number for each piece."""
        parts = [pieces[at : at + JOINED] for at in range(0, len(pieces), JOINED)]
        ids = self._raw([" " + " ".join(p) for p in parts])
        return ids, [np.diff(np.append(np.flatnonzero(self.spaced[i]), len(i))) for i in ids]

    def _store(self, pieces: list[str], ids: list[np.ndarray], n: list[np.ndarray]) -> None:
        n = np.concatenate(n).astype(np.int64)
        if len(n) != len(pieces):
            raise ValueError("a piece has more or less than one space")
        self.known.update(zip(pieces, range(len(self.n), len(self.n) + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.flat, self.n = np.concatenate([self.flat, *ids]), np.concatenate([self.n, n])
        self.used = np.concatenate([self.used, np.full(len(pieces), self.round)])

    def _learn(self, new: list[str]) -> None:
        held = pa.array(new, pa.large_string())
        cut = pc.utf8_rtrim(held, MARKS)
        ended = np.flatnonzero(pc.not_equal(cut, held).to_numpy(zero_copy_only=False))
        bare = cut.take(pa.array(ended)).to_pylist()
        marked = {new[i]: w for i, w in zip(ended.tolist(), bare, strict=True) if w.isalpha()}
        plain = new if not marked else [p for p in new if p not in marked]
        # the new pieces themselves are not known; a word before marks may be
        words = list(dict.fromkeys([*(w for w in marked.values() if w not in self.known), *plain]))
        if words:
            self._store(words, *self._spaced_ids(words))
        if not marked:
            return
        ends = [p[len(w) :] for p, w in marked.items()]
        unknown = list(set(ends).difference(self.marks))
        self.marks.update(zip(unknown, self._raw(unknown), strict=True))
        at = np.array([self.known[w] for w in marked.values()])
        self.used[at] = self.round
        tails = [self.marks[e] for e in ends]
        n, more = self.n[at], np.array([len(t) for t in tails])
        ids = np.empty(int((n + more).sum()), np.uint32)
        is_tail = np.repeat(np.tile([False, True], len(at)), np.stack([n, more], 1).ravel())
        ids[~is_tail], ids[is_tail] = taken(self.flat, self.start[at], n), np.concatenate(tails)
        self._store(list(marked), [ids], [n + more])

    def _forget(self) -> None:
        """Keep the pieces used last, and none that is long, when the store has grown beyond its limits."""
        if len(self.known) > self.limit or len(self.flat) > 16 * self.limit:
            short = np.flatnonzero(self.n <= 64)
            kept = np.sort(short[np.argsort(self.used[short], kind="stable")][len(short) - min(len(short), self.limit // 2) :])
            place = np.full(len(self.n), -1)
            place[kept] = np.arange(len(kept))
            self.known = {p: i for p, i in zip(self.known, place[list(self.known.values())].tolist(), strict=True) if i >= 0}
            self.flat, self.n, self.used = taken(self.flat, self.start[kept], self.n[kept]), self.n[kept], self.used[kept]
            self.start = np.cumsum(self.n) - self.n
        for store in (self.first, self.marks):
            if len(store) > self.limit or sum(map(len, store.values())) > 64 * self.limit:
                store.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        self.round += 1
        held = pa.array(texts, pa.large_string())
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(held, s).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(held, " ")
        bounds, pieces = cut.offsets.to_numpy().astype(np.int64), cut.flatten()
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        later = ~whole[owner]
        later[bounds[:-1]] = False
        owner = owner[later]
        words = pieces.filter(pa.array(later)).dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        slots = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(slots < 0)
        odd = np.zeros(len(names), bool)
        fresh = words.dictionary.take(pa.array(unknown))
        full, trimmed = (pc.binary_length(x).to_numpy() for x in (fresh, pc.utf8_trim_whitespace(fresh)))
        odd[unknown] = (full == 0) | (trimmed < full)
        place = words.indices.to_numpy()
        whole[owner[odd[place]]] = True
        heads = pieces.take(pa.array(bounds[:-1])).to_pylist()
        alone = np.diff(bounds) == 1
        whole |= np.array([not h or h[-1].isspace() for h in heads]) & ~alone

        still = ~whole[owner]
        place, owner = place[still], owner[still]
        seen = np.zeros(len(names), bool)
        seen[place] = True
        unknown = unknown[seen[unknown]]
        if len(unknown):
            new = [names[i] for i in unknown.tolist()]
            self._learn(new)
            slots[unknown] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        self.used[slots[seen]] = self.round
        at = slots[place]
        ids = taken(self.flat, self.start[at], self.n[at])
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, self.n[at], len(texts)).astype(np.int64))])

        lost = list({h for h, w in zip(heads, whole.tolist(), strict=True) if not w and h not in self.first})
        self.first.update(zip(lost, (i.tobytes() for i in self._raw(lost)), strict=True))
        rest = iter(self._raw([t for t, w in zip(texts, whole.tolist(), strict=True) if w]))
        out = [
            next(rest).tobytes() if w else self.first[h] + ids[a:b].tobytes()
            for h, w, a, b in zip(heads, whole.tolist(), ends[:-1], ends[1:], strict=True)
        ]
        self._forget()
        return out


def taken(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after another."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def _write(tools, tokenizer: str, end: int, folder: str, dictionary: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = tools.value.get("encoder")  # kept for all tasks of a worker
        if encoder is None:
            encoder = tools.value["encoder"] = TextEncoder(tokenizer)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=shared)
        closing = np.array([end], np.uint32).tobytes()
        out = path = None
        entries: list[np.ndarray] = []
        offset = before = 0
        for part in blocks(batches, "text", 2 * BLOCK_BYTES):
            if out is None:
                system, path = opened(task_file(folder, ".tokz"))
                out = system.open_output_stream(path)
                out.write(MAGIC + hashlib.sha256(dictionary).digest())
                offset = len(MAGIC) + 32
            keys = part.column("key").to_numpy()
            entry = np.empty(part.num_rows, INDEX)
            for i, ids in enumerate(encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                frame = compressor.compress(ids + closing)
                n = len(ids) // 4 + 1
                entry[i] = (keys[i], offset, len(frame), before, n)
                out.write(frame)
                offset += len(frame)
                before += n
            entries.append(entry)
        if out is not None:
            index = np.concatenate(entries)
            out.write(index.tobytes() + struct.pack("<QQ", offset, len(index)) + MAGIC)
            out.close()
            size = offset + index.nbytes + 24
            row = [path], [int(index["key"][0])], [int(index["key"][-1])], [len(index)], [before], [size]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["path", "first", "last", "n_docs", "n_tokens", "size"])

    return run


def train_dictionary(docs: DataFrame, tokenizer: str, key: str, text: str, end: int, docs_limit: int = TRAIN_DOCS) -> bytes:
    """A dictionary from the serialized ids of a bounded sample; empty if there is too little to train on."""
    import zstandard

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(tokenizer)
        for part in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(encoder.encode(part.column("text").to_pylist()))], ["ids"])

    short = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    short = short.filter(F.octet_length("text") <= TRAIN_DOC_BYTES)
    sample = short.orderBy(F.xxhash64("key"), "key", "text").limit(docs_limit).select("text")
    closing = np.array([end], np.uint32).tobytes()
    samples = [ids + closing for ids in sample.mapInArrow(serialized, "ids binary").toArrow()["ids"].to_pylist()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(
    docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", folder: str | None = None, level: int = LEVEL
) -> DataFrame:
    """Encode, append ``end``, and write files in ascending key order; the table of files.

    Null texts count as empty and have the end id alone. Keys are integers;
    null keys are refused, equal keys stand beside each other in no fixed
    order. An empty table gives no file. Further columns are not read. The table
    has the path, the range of keys, documents, ids and bytes of each file; files
    without a row in it are left-overs of lost attempts.
    """
    spark = docs.sparkSession
    folder = make_folder(folder or scratch_path(spark, "tokens"))
    dictionary = train_dictionary(docs, tokenizer, key, text, end)
    system, path = opened(f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dict")
    with system.open_output_stream(path) as out:
        out.write(dictionary)
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("key", F.expr("coalesce(key, raise_error('null key'))"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key")
    return settle(rows.mapInArrow(_write(spark.sparkContext.broadcast({}), tokenizer, end, folder, dictionary, level), MANIFEST), "token-files")


class TokenFile:
    """One file, opened for short-document access."""

    def __init__(self, path: str):
        import zstandard

        system, at = opened(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        begin, n = struct.unpack("<QQ", tail[:16])
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if tail[16:] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, begin), INDEX)
        self.dictionary_hash = head[len(MAGIC) :].hex()
        with system.open_input_file(f"{at.rsplit('/', 1)[0]}/{self.dictionary_hash}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != self.dictionary_hash:
            raise ValueError("the dictionary is another one")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.reader = zstandard.ZstdDecompressor(dict_data=shared)

    def payload(self, i: int) -> bytes:
        """Serialized ids of the i-th document of the file."""
        e = self.index[i]
        return self.reader.decompress(self.file.read_at(int(e["length"]), int(e["offset"])), max_output_size=4 * int(e["n"]))

    def document(self, key: int) -> np.ndarray:
        i = int(np.searchsorted(self.index["key"], key))
        if i == len(self.index) or self.index["key"][i] != key:
            raise KeyError(key)
        return np.frombuffer(self.payload(i), "<u4")


def _read(step: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(path)
                index = file.index
                at = 0
                while at < len(index):
                    n = np.cumsum(index["n"][at:].astype(np.int64))
                    to = at + max(1, int(np.searchsorted(n, step, "right")))
                    payloads = [file.payload(i) for i in range(at, to)]
                    part = index[at:to]
                    ends = np.concatenate([[0], np.cumsum(part["n"].astype(np.int32))])
                    out = {
                        "key": pa.array(part["key"]),
                        "start": pa.array(part["before"].astype(np.int64) + base),
                        "n_tokens": pa.array(part["n"].astype(np.int64)),
                        "ids_crc32": pa.array([zlib.crc32(p) for p in payloads], pa.int64()),
                    }
                    if with_ids:
                        ids = pa.array(np.frombuffer(b"".join(payloads), "<u4").view(np.int32))
                        out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
                    yield pa.RecordBatch.from_pydict(out)
                    at = to

    return run


def read_tokens(spark: SparkSession, files: DataFrame, key: str = "doc_id", with_ids: bool = True, step: int = 1 << 18) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32, ids)`` of every document in the files of a table of files.

    ``start`` counts the ids of all documents before; the CRC-32 is that of the
    serialized ids. ``with_ids=False`` leaves the ids out of the result. Files are read by their own
    index, one range for each document. The running sum runs over files, not rows.
    """
    order = Window.orderBy("first", "last", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    tasks = max(1, min(files.count(), 10_000))
    out = placed.repartition(tasks, "path").mapInArrow(
        _read(step, with_ids), "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    )
    return out.withColumnRenamed("key", key)
