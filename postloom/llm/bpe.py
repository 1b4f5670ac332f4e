"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that ends its encoding: the
token t, ending there, whose predecessor (the last token of the prefix before t)
stands beside t without being merged into it. An automaton over all tokens gives
the tokens that end at each place; a test on two tokens, kept once made, tells
whether they can stand side by side. The encoding follows from the back-pointers.
The work is linear in the word for a given vocabulary.

Words are cut by the tokenizer's own rule inside pieces without white space.
Pieces and words are looked up among those met lately (see ``Recent``).
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import blocks, ragged

KNOWN_PIECES = 200_000
DECODED_IDS = 1 << 18  # ids that are decoded at once, or those of one text
END = 0xE000  # added to the last character of a word, in place of the mark for word ends
NEVER = 1 << 60

# White space of the tokenizer's patterns.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_RULE = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What the encoder needs of a tokenizer file; its size is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "suffix": model["end_of_word_suffix"],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Recent:
    """A store of bounded size: when the newer half is full, the older half goes."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = max(1, limit // 2), {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Encoder:
    def __init__(self, spec: dict, known_pieces: int = KNOWN_PIECES):
        import ahocorasick
        import regex

        vocab, suffix = spec["vocab"], spec["suffix"]
        letters = byte_letters()
        self.to_letters = {b: letters[b] for b in range(256)}
        self.special = spec["special"]
        self.cut_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.words = regex.compile(WORD_RULE)
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile(f"[{SPACE}]+")
        n = max(vocab.values()) + 1
        spelled = {c: c for c in letters} | {c + suffix: chr(END + ord(c)) for c in letters}
        self.rank, self.halves = {}, {}
        self.born = [-1] * n
        for rank, (a, b) in enumerate(spec["merges"]):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), rank)
            if t not in self.halves and a + b not in spelled:
                self.halves[t], self.born[t] = (x, y), rank
                spelled[a + b] = spelled[a] + spelled[b]
        self.length = [0] * n
        self.automaton = ahocorasick.Automaton()
        self.known: dict[int, bool] = {}
        self.met, self.pieces_met = Recent(known_pieces), Recent(known_pieces)
        self.size = n
        whole = []
        for token, text in spelled.items():
            i = vocab[token]
            self.length[i] = len(text)
            if i not in self.halves or self._whole(i):
                whole.append((text, i))
        for text, i in whole:
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()

    def _whole(self, t: int) -> bool:
        """A token is its own encoding when its halves are and stand together until they are merged."""
        a, b = self.halves[t]
        return all(h not in self.halves or self._whole(h) for h in (a, b)) and self._first_merge(a, b) == self.born[t]

    def _edge(self, t: int, side: int) -> list[int]:
        """The tokens that stand at one edge of ``t`` while it is merged, first to last."""
        out = [t]
        while out[-1] in self.halves:
            out.append(self.halves[out[-1]][side])
        return out[::-1]

    def _first_merge(self, a: int, b: int) -> int | None:
        """Rank of the first merge across the border of ``a`` and ``b``, None if they stay apart.

        Both sides grow by their own merges. A merge across happens if its rank
        comes before the ends of both tokens at the border; of equal ranks the
        left-most is made first.
        """
        x, y = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            ends_x = self.born[x[i + 1]] if i + 1 < len(x) else NEVER
            ends_y = self.born[y[j + 1]] if j + 1 < len(y) else NEVER
            m = self.rank.get((x[i], y[j]), NEVER)
            if m < ends_x and m <= ends_y:
                return m
            if ends_x == NEVER and ends_y == NEVER:
                return None
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1

    def word(self, text: str) -> list[int]:
        """Ids of one word in byte letters whose last letter has the mark."""
        n, known, length, size = len(text), self.known, self.length, self.size
        last: list[int] = [-1] * (n + 1)
        for end, token in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - length[token]
            if start:
                pair = last[start] * size + token
                fits = known.get(pair)
                if fits is None:
                    if len(known) > 1_000_000:
                        known.clear()
                    fits = known[pair] = self._first_merge(last[start], token) is None
                if not fits:
                    continue
            last[end + 1] = token
        out = []
        while n:
            out.append(last[n])
            n -= length[last[n]]
        return out[::-1]

    def piece(self, piece: str) -> list[int]:
        if piece.isascii():
            if piece.isalpha():
                return self.known_word(piece)
            if piece[:-1].isalpha():  # one mark after a word, which never starts with it
                return self.known_word(piece[:-1]) + self.known_word(piece[-1])
        ids: list[int] = []
        for w in self.words.findall(piece):
            ids += self.known_word(w)
        return ids

    def known_word(self, w: str) -> list[int]:
        ids = self.met.get(w)
        if ids is None:
            letters = w.encode().decode("latin-1").translate(self.to_letters)
            ids = self.word(letters[:-1] + chr(END + ord(letters[-1])))
            if len(w) < 50:
                self.met.put(w, ids)
        return ids

    def pieces(self, text: str) -> list[str]:
        """Normalised text, cut at white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form in the lower case of single letters
        text = text.lower()
        if self.odd_space.search(text):
            return [p for p in self.space.split(text) if p]
        return text.split()


def _encode(text: str, spec, known_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = spec.value  # one object for all tasks of a worker, so the encoder is built once
        encoder = shared.get("encoder")
        if encoder is None:
            encoder = shared["encoder"] = Encoder(shared, known_pieces)
        special = {s: array("I", [i]).tobytes() for s, i in encoder.special.items()}
        met = encoder.pieces_met

        def ids_of(piece: str) -> bytes:
            ids = met.get(piece)
            if ids is None:
                ids = array("I", encoder.piece(piece)).tobytes()
                if len(piece) < 50:
                    met.put(piece, ids)
            return ids

        for part in blocks(batches, text):
            out, counts = [], []
            for t in part.column(text).to_pylist():
                parts = []
                for span in encoder.cut_special.split(t or "") if t and "<|" in t and encoder.cut_special else [t or ""]:
                    if span in special:
                        parts.append(special[span])
                    else:
                        new = met.new.get
                        parts += [new(p) or ids_of(p) for p in encoder.pieces(span)]
                got = b"".join(parts)
                out.append(got)
                counts.append(len(got) // 4)
            ids = pa.array(np.frombuffer(b"".join(out), np.int32))
            held_columns = [n for n in part.schema.names if n != text]
            arrays = [part.column(n) for n in held_columns] + [ragged(ids, np.array(counts))]
            yield pa.RecordBatch.from_arrays(arrays, [*held_columns, "ids"])

    return run


def encoded(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", keep: Sequence[str] = (), known_pieces: int = KNOWN_PIECES
) -> DataFrame:
    """``(key, kept columns, ids)`` of every document, as the tokenizer at the path ``vocabulary`` gives them without special tokens around.

    Special tokens that stand in a text get their own id. Null and empty texts
    have no ids. Repeated rows, null keys and an empty table are kept as they
    are; further columns are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    names = [key, *keep]
    rows = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(names))
    out = rows.mapInArrow(_encode("text", spec, known_pieces), f"{kinds}ids array<int>")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "ids")


def _decode(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(names.value, pa.string())
        for batch in batches:
            n = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + DECODED_IDS, "right")))
                part = batch.slice(at, to - at)
                lists = part.column("ids")
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                shown = ragged(tokens.take(lists.flatten()), counts)
                texts = pc.if_else(lists.is_valid(), pc.binary_join(shown, " "), None)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])
                at = to

    return run


def decoded(rows: DataFrame, vocabulary: str, name: str = "decoded") -> DataFrame:
    """Rows with ``ids`` and their text: the tokens with their marks, joined by one space.

    This vocabulary has no decoder, so word-end marks stay and special tokens are
    shown. Null ids give a null text, no ids an empty one.
    """
    spec = read_vocabulary(vocabulary)
    ids = {i: t for t, i in [*spec["vocab"].items(), *spec["special"].items()]}
    names = [ids.get(i, "") for i in range(max(ids) + 1)]
    shared = rows.sparkSession.sparkContext.broadcast(names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decode(shared), f"{kinds}, decoded string").withColumnRenamed("decoded", name)
