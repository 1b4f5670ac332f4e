"""Masking of phrases and numbers.

Phrases are not matched by one regex over the whole lexicon. A lexicon that fits
a broadcast becomes an automaton with failure links, built once in each worker;
one walk over a text finds every phrase in it, whatever the size of the lexicon,
without a shuffle. A larger one is joined: a text is cut into pieces, runs of
pieces become rows, a Bloom filter of bounded size drops those that cannot be a
phrase, and the rest meets the lexicon on equality. Overlaps are resolved per
text from the left, best priority first, in time linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import fixed_values as fixed
from postloom.functions.columns import UNICODE, UNICODE_NOCASE, any_pattern, contains, let, text_or_empty, words
from postloom.functions.text import sentence_case
from postloom.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join, spread_join
from postloom.operators.lexicons import lexicon_of, trimmed, without_phrases
from postloom.session import settle

PIECE = r"(?U)\w+|\s+|[^\w\s]"
WORD_START = r"^(?U)\w"


def pieces(text: Column) -> Column:
    """Words, blanks and single other characters; joined again they give the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _grams(lowered: Column, lengths: Sequence[int], firsts: Sequence[str] | None) -> Column:
    """Runs of pieces with their place and their neighbours.

    When the first pieces of all phrases are few, runs start only there.
    """

    def at(p: Column, i: Column) -> Column:
        return F.get(p, i)

    def build(p: Column) -> Column:
        def from_place(x: Column, i: Column) -> Column:
            runs = [
                F.struct(
                    i.alias("start"),
                    F.lit(n).alias("len"),
                    F.concat(*[at(p, i + k) for k in range(n)]).alias("gram"),
                    F.when(i > 0, at(p, i - 1)).alias("before"),
                    at(p, i + n).alias("after"),
                )
                for n in lengths
            ]
            # phrases are trimmed, so none starts with a blank either way
            begins = ~x.rlike(r"^\s") if firsts is None else x.isin(list(firsts))
            return F.when(begins, F.filter(F.array(*runs), lambda g: g["gram"].isNotNull()))

        return F.flatten(F.filter(F.transform(p, from_place), lambda g: g.isNotNull()))

    return let(pieces(lowered), build)


class _Lexicon(NamedTuple):
    table: DataFrame
    lengths: list[int]  # in pieces
    firsts: list[str] | None  # first pieces, when few
    small: bool


MAX_FIRSTS = 2_000


def _prepared(lexicon: DataFrame) -> _Lexicon:
    """Lexicon by lower-case phrase, written out and measured."""
    table = (
        lexicon.withColumn("gram", trimmed(F.lower("phrase")))
        .filter("gram <> ''")
        .groupBy("gram")
        .agg(F.min(F.struct("priority", "tag")).alias("best"))
        .select(
            "gram",
            F.col("best.tag").alias("tag"),
            F.col("best.priority").alias("priority"),
            F.col("gram").rlike(WORD_START).alias("word_first"),
            F.col("gram").rlike(r"(?U)\w$").alias("word_last"),
        )
    )
    table = settle(table, "lexicon")
    cut = table.select("*", pieces(F.col("gram")).alias("p"))
    lengths, starts, rows, size = cut.agg(
        F.collect_set(F.size("p")), F.countDistinct(F.col("p")[0]), F.count(F.lit(1)), F.sum(F.length("gram") + F.length("tag") + 32)
    ).first()
    firsts = None
    if starts <= MAX_FIRSTS:
        firsts = [r[0] for r in cut.select(F.col("p")[0]).distinct().collect()]
    small = rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    return _Lexicon(table, sorted(lengths), firsts, small)


def _edges_hold() -> Column:
    """Word-boundary rule at both ends of a match."""
    before = F.coalesce(F.col("before").rlike(r"(?U)\w$"), F.lit(False))
    after = F.coalesce(F.col("after").rlike(WORD_START), F.lit(False))
    return (F.col("word_first") | before) & (F.col("word_last") | after)


FOUND = "start int, len int, phrase string, tag string, priority bigint"


def phrase_matches(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Every place of every text where a lexicon phrase stands, overlaps included.

    ``start`` and ``len`` count characters; ``key`` is unique.
    """
    lex = _prepared(lexicon)
    fields = f"key {docs.schema[key].dataType.simpleString()}, {FOUND}"
    body = text_or_empty(F.col(text))
    if lex.small:
        rows = docs.select(F.col(key).alias("key"), body.alias("own"), F.lower(body).alias("low"))
        return rows.mapInArrow(_found_rows(_shared_phrases(docs, lex)), fields).withColumnRenamed("key", key)
    docs = settle(docs.select(key, text), "unmatched")
    span = F.struct("start", "len", F.col("gram").alias("phrase"), "tag", "priority")
    spans = _matches(docs, key, text, lex).groupBy(key).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    rows = docs.join(spans, key).select(F.col(key).alias("key"), pieces(body).alias("own"), "spans")
    return rows.mapInArrow(_placed_rows, fields).withColumnRenamed("key", key)


def _candidates(docs: DataFrame, key: str, text: str, lex: _Lexicon) -> DataFrame:
    """Runs of pieces that may be phrases: those that the lexicon's Bloom filter lets through."""
    runs = _grams(F.lower(text_or_empty(F.col(text))), lex.lengths, lex.firsts)
    grams = docs.select(key, F.explode(runs).alias("g")).select(key, "g.*")
    return grams.filter(_may_hold(lex.table, F.col("gram")))


def _matches(docs: DataFrame, key: str, text: str, lex: _Lexicon) -> DataFrame:
    """Matches with a lexicon of any size: candidate runs joined with the phrases, frequent ones spread."""
    grams = settle(_candidates(docs, key, text, lex), "runs")
    return spread_join(grams, lex.table, ["gram"], "inner", [key, "start"]).filter(_edges_hold())


# A Bloom filter has at least BLOOM_BITS per phrase, a power of two, and never more than BLOOM_MOST (8 MB) in all:
# beyond some 4 million phrases it lets more through, and loses nothing.
BLOOM_BITS = 16
BLOOM_LEAST, BLOOM_MOST = 1 << 16, 1 << 26
BLOOM_HASHES = 4


def _bits_of(value: Column, size: int) -> list[Column]:
    """Places of a value in a filter of ``size`` bits, each from a hash of its own."""
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(size)) for i in range(BLOOM_HASHES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def bloom_filter(table: DataFrame, column: str) -> tuple[DataFrame, int]:
    """One row with the words of a Bloom filter over a column, and its size in bits."""
    n = max(1, table.count())
    size = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (BLOOM_BITS * n - 1).bit_length()))
    bit = table.select(F.explode(F.array(*_bits_of(F.col(column), size))).alias("bit"))
    mask = _bit(F.col("bit"))
    held = bit.groupBy(F.shiftright("bit", 6).cast("int").alias("i")).agg(F.bit_or(mask).alias("mask"))
    # all words, the empty ones too, so that a word is found by its place
    words_ = table.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("i")).join(held, "i", "left")
    ordered = words_.agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("w"))
    return settle(ordered.select(F.col("w.mask").alias("words")), "bloom"), size


def _may_hold(table: DataFrame, value: Column) -> Column:
    """False only where a value is surely not in ``table.gram``; the filter comes as a scalar, read once per query."""
    held, size = bloom_filter(table, "gram")
    words_ = held.scalar()
    tests = [F.get(words_, F.shiftright(bit, 6).cast("int")).bitwiseAND(_bit(bit)) != 0 for bit in _bits_of(value, size)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def mask_phrases(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``docs(key, text)`` with lexicon phrases replaced by their tags; ``key`` is unique.

    A lexicon that fits a broadcast is looked up inside each row, so nothing is
    shuffled. With a larger one the runs of pieces are joined on the phrase with a
    salt, and the input is written out first so that it is not computed twice.
    """
    lex = _prepared(lexicon)
    body = text_or_empty(F.col(text))
    if not lex.lengths:
        return docs.select(key, body.alias(text))
    kind = docs.schema[key].dataType.simpleString()
    if lex.small:
        rows = docs.select(F.col(key).alias("key"), body.alias("own"), F.lower(body).alias("low"))
        out = rows.mapInArrow(_masked_rows(_shared_phrases(docs, lex)), f"key {kind}, body string")
    else:
        docs = settle(docs.select(key, text), "unmasked")
        span = F.struct("start", "priority", "len", "tag")
        spans = _matches(docs, key, text, lex).groupBy(key).agg(F.sort_array(F.collect_list(span)).alias("spans"))
        rows = docs.join(spans, key, "left").select(F.col(key).alias("key"), pieces(body).alias("own"), "spans")
        out = rows.mapInArrow(_spanned_rows, f"key {kind}, body string")
    return out.select(F.col("key").alias(key), F.col("body").alias(text))


# --- matching inside a row ----------------------------------------------------


def _shared_phrases(docs: DataFrame, lex: _Lexicon):
    """A small lexicon for the tasks, as Arrow columns; measured: at most BROADCAST_ROWS and BROADCAST_BYTES."""
    import pyarrow as pa

    columns = ["gram", "tag", "priority", "word_first", "word_last", F.size(pieces(F.col("gram"))).cast("long").alias("n")]
    sink = pa.BufferOutputStream()
    held = lex.table.select(*columns).toArrow()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    return docs.sparkSession.sparkContext.broadcast({"phrases": sink.getvalue().to_pybytes()})


def automaton(shared: dict):
    """The automaton of a shared lexicon, built once in a worker.

    A phrase's value is what orders it (priority, pieces, tag, phrase), its length, and whether it begins and ends
    with a word character.
    """
    import ahocorasick
    import pyarrow as pa

    if "built" not in shared:
        built = ahocorasick.Automaton()
        table = pa.ipc.open_stream(shared["phrases"]).read_all()
        columns = [table[c].to_pylist() for c in ("gram", "priority", "n", "tag", "word_first", "word_last")]
        for gram, priority, n, tag, first, last in zip(*columns, strict=True):
            built.add_word(gram, ((priority, n, tag, gram), len(gram), first, last))
        if len(built):
            built.make_automaton()
        shared["built"] = built if len(built) else None
    return shared["built"]


class _WordCharacters(dict):
    """Whether a character is a word character, by the rules of the patterns that cut pieces; the empty text is none."""

    def __missing__(self, c: str) -> bool:
        code, kind = ord(c) if c else 0, unicodedata.category(c) if c else "Cc"
        circled = 0x24B6 <= code <= 0x24E9 or 0x1F130 <= code <= 0x1F149 or 0x1F150 <= code <= 0x1F169 or 0x1F170 <= code <= 0x1F189
        self[c] = kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or code in (0x200C, 0x200D) or circled
        return self[c]


def _spans(low: str, found, word: _WordCharacters) -> list[tuple]:
    """Phrases with word boundaries at both ends: (start, order, length)."""
    out = []
    for end, (order, size, first, last) in found.iter(low):
        start = end + 1 - size
        # a boundary lies between a word character and another, or none
        if word[low[start - 1 : start]] != first and word[low[end + 1 : end + 2]] != last:
            out.append((start, order, size))
    out.sort()
    return out


def _places(own: str, low: str) -> list[int] | None:
    """Where the characters of the lower-case text stand in the text, if their numbers differ."""
    if len(own) == len(low):
        return None
    out: list[int] = []
    for i, c in enumerate(own):
        out += [i] * len(c.lower())
    return [*out, len(own)]


def byte_slices(batch, column: str, size: int = 1 << 20) -> Iterator:
    """Parts of a batch whose texts have about ``size`` bytes, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _masked_rows(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found, word = automaton(shared.value), _WordCharacters()
        for batch in batches:
            for part in byte_slices(batch, "own"):
                out = []
                for own, low in zip(part.column("own").to_pylist(), part.column("low").to_pylist(), strict=True):
                    spans = _spans(low, found, word) if found else ()
                    at, kept, stop = _places(own, low) if spans else None, [], 0
                    last = 0
                    for start, order, size in spans:
                        if start >= stop:
                            stop = start + size
                            a, b = (start, stop) if at is None else (at[start], at[stop])
                            kept += [own[last:a], order[2]]
                            last = b
                    out.append("".join([*kept, own[last:]]) if kept else own)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.string())], ["key", "body"])

    return run


def _found_table(part, row: list[int], out: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    columns = zip(*out, strict=True) if out else [()] * 5
    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    keys = part.column("key").take(pa.array(row, pa.int64()))
    return pa.RecordBatch.from_arrays([keys, *arrays], ["key", "start", "len", "phrase", "tag", "priority"])


def _found_rows(shared):
    def run(batches: Iterator) -> Iterator:
        found, word = automaton(shared.value), _WordCharacters()
        for batch in batches:
            for part in byte_slices(batch, "own"):
                row, out = [], []
                texts = zip(part.column("own").to_pylist(), part.column("low").to_pylist(), strict=True)
                for k, (own, low) in enumerate(texts):
                    spans = _spans(low, found, word) if found else ()
                    at = _places(own, low) if spans else None
                    for start, (priority, _, tag, gram), size in spans:
                        a, b = (start, start + size) if at is None else (at[start], at[start + size])
                        row.append(k)
                        out.append((a, b - a, gram, tag, priority))
                yield _found_table(part, row, out)

    return run


def _placed_rows(batches: Iterator) -> Iterator:
    """Spans of pieces as spans of characters."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, row, out = batch.slice(at, 256), [], []
            for k, (own, spans) in enumerate(zip(part.column("own").to_pylist(), part.column("spans").to_pylist(), strict=True)):
                begin = [0]
                for piece in own:
                    begin.append(begin[-1] + len(piece))
                for s in spans:
                    first, stop = begin[s["start"]], begin[s["start"] + s["len"]]
                    row.append(k)
                    out.append((first, stop - first, s["phrase"], s["tag"], s["priority"]))
            yield _found_table(part, row, out)


def _spanned_rows(batches: Iterator) -> Iterator:
    """Texts with their sorted spans resolved: leftmost first, best priority first."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, out = batch.slice(at, 256), []
            for own, spans in zip(part.column("own").to_pylist(), part.column("spans").to_pylist(), strict=True):
                stop = 0
                for s in spans or ():
                    if s["start"] >= stop:
                        stop = s["start"] + s["len"]
                        own[s["start"] : stop] = [s["tag"]] + [""] * (len(own[s["start"] : stop]) - 1)
                out.append("".join(own))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.string())], ["key", "body"])


# --- ordered rewrites -------------------------------------------------------


def rewrite_in_order(text: Column, patterns: Sequence[str], tag: str, guard: str | None = None) -> Column:
    """Replace the matches of each pattern in turn by ``tag``.

    ``guard`` is a cheap pattern that holds whenever any of the patterns does;
    texts without it skip the whole sequence.
    """
    def chain(t: Column) -> Column:
        rules = F.lit([UNICODE_NOCASE + p for p in patterns])
        return F.aggregate(rules, t, lambda acc, p: F.regexp_replace(acc, p, F.lit(tag)))

    if guard is None:
        return chain(text)
    return let(text, lambda t: F.when(t.rlike(UNICODE_NOCASE + guard), chain(t)).otherwise(t))


def rewrite_where(
    text: Column, passes: Sequence[tuple[str, Sequence[str], str]], tag: str, guards: dict[str, str], needed: str, alone: Sequence[str] = ()
) -> Column:
    """Replace in turn the matches of those patterns that can occur in the text.

    Passes are (kind, words, pattern): every match begins and ends at word boundaries, holds none of the brackets of
    ``tag``, and has the letters of each of ``words`` somewhere. ``guards`` holds a necessary condition
    per kind, ``needed`` one for all passes. The guard of a kind in ``alone`` is the alternation of its patterns, of
    which no two match at one place; these are tested in what it finds only. A replacement makes no room for a match
    that was not there before, so all of this is looked up once, in the text as it comes: one scan finds the words.
    """
    wanted = sorted({w.lower() for _, ws, _ in passes for w in ws})
    # a word that begins with another one is found with it
    keys = [k for k in wanted if not any(k != o and k.startswith(o) for o in wanted)]
    key_of = {w: next(k for k in keys if w.startswith(k)) for w in wanted}

    def rule(kind: str, words_: Sequence[str], pattern: str) -> Column:
        needs = [pattern if kind in alone else kind, *dict.fromkeys("=" + key_of[w.lower()] for w in words_)]
        return F.struct(F.lit(needs).cast("array<string>").alias("needs"), F.lit(UNICODE_NOCASE + pattern).alias("pattern"))

    rules = F.array(*[rule(*p) for p in passes])

    def held(found: Column, tests: dict[str, str]) -> Column:
        return let(F.array_join(F.array_distinct(found), " "), lambda w: F.array(*[F.when(w.rlike(UNICODE_NOCASE + p), F.lit(k)) for k, p in tests.items()]))

    def chain(t: Column) -> Column:
        met = [F.array(*[F.when(t.rlike(UNICODE_NOCASE + g), F.lit(k)) for k, g in guards.items() if k not in alone])]
        if keys:
            found = F.regexp_extract_all(t, F.lit(UNICODE_NOCASE + f"(?=({_either(keys)}))"), F.lit(1))
            met.append(held(found, {"=" + k: k for k in keys}))
        for kind in alone:
            # matches that overlap are found too
            found = F.regexp_extract_all(t, F.lit(UNICODE_NOCASE + f"(?=({guards[kind]}))"), F.lit(1))
            met.append(held(found, {p: p for k, _, p in passes if k == kind}))
        chosen = let(F.array_compact(F.concat(*met)), lambda m: F.filter(rules, lambda r: F.size(F.array_except(r["needs"], m)) == 0))
        return F.aggregate(chosen, t, lambda acc, r: F.regexp_replace(acc, r["pattern"], F.lit(tag)))

    if needed is None:
        return let(text, chain)
    return let(text, lambda t: F.when(t.rlike(UNICODE_NOCASE + needed), chain(t)).otherwise(t))


def _from_letter(names: Sequence[str]) -> str:
    """A word boundary before one of the first letters; testing the letter first is cheaper."""
    return f"(?=[{''.join(sorted({n[0].lower() for n in names}))}])" + r"\b"


def _literal(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def _with_commas(terms: Sequence[str]) -> list[str]:
    return [*terms, *[f"{t}," for t in terms]]


def _beside(text: Column, terms: Sequence[str], leads: Sequence[str], number: str, tag: str) -> Column:
    """A number before or after a term, the term with one of ``leads`` or without.

    A number begins with a digit after its currency, if it has one, and ends with signs and letters of thousands.
    """
    passes = []
    for comma in ("", ","):
        for words_ in [*[(a, t) for a in leads for t in terms], *[(t,) for t in terms]]:
            term = " ".join(words_) + comma
            t = _literal(term)
            begin = _from_letter([term]) if _begun([term]) else r"\b"
            passes.append(("after", _begun(term.split(" ")), rf"{_from_number(number)}\b{number}\s*{t}\b"))
            passes.append(("before", _begun(term.split(" ")), rf"{begin}{t}\s*[:=]?\s*{number}\b"))
    either = _either([_literal(t) for t in terms])
    led = f"(?:(?:{'|'.join(_literal(a) for a in leads)}) )?" if leads else ""
    begin = _from_letter(terms) if len(_begun(terms)) == len(terms) else ""
    guards = {"after": rf"\d[+km]*\s*{led}{either}", "before": rf"{begin}{either},?\s*[:=]?\s*{number}"}
    return rewrite_where(text, passes, tag, guards, "|".join(guards.values()))


def _begun(words_: Sequence[str]) -> list[str]:
    """The letters with which words begin, of those that begin with some."""
    return [m[0] for m in (re.match("[A-Za-z]+", w) for w in words_) if m]


def _either(patterns: Sequence[str]) -> str:
    """An alternation of patterns that begin with a character of their own, dealt by it, which keeps which one is taken."""
    dealt: dict[str, list[str]] = {}
    for p in patterns:
        dealt.setdefault(p[0].lower() if p[0].isalnum() and p[0].isascii() else "", []).append(p)
    if "" in dealt:
        return f"(?:{'|'.join(patterns)})"
    return f"(?:{'|'.join(f"{c}(?:{'|'.join(p[1:] for p in ps)})" for c, ps in dealt.items())})"


def _from_number(number: str) -> str:
    """One of the characters that the number, or its currency, can begin with; testing it first is cheaper."""
    return r"(?=[$£€₹dper\d])" if number == fixed.PAY_AMOUNT else r"(?=\d)"


def mask_pay(text: Column, leads: Sequence[str] = fixed.PAY_LEADS, terms: Sequence[str] = fixed.PAY_TERMS) -> Column:
    """An amount before or after a pay term."""
    return _beside(text, terms, leads, fixed.PAY_AMOUNT, "[SALARY]")


def mask_experience(text: Column, terms: Sequence[str] = fixed.EXPERIENCE_TERMS, tag: str = "[YEARS]") -> Column:
    """A number before or after a term for years of experience."""
    return _beside(text, terms, (), r"(\d+)\+?", tag)


def mask_scores(text: Column, terms: Sequence[str] = fixed.SCORE_TERMS) -> Column:
    """A count before or after the name of a coding platform."""
    return _beside(text, terms, (), r"(\d+)\+?[kK]?\+?", "[LEETCODE]")


def _alternations(names: Sequence[str]) -> list[str]:
    """Names in as few alternations as keep the effect of replacing them one by one.

    Names followed by digits can only overlap where one is the tail of another.
    An alternation takes the leftmost, so a name that ends in an earlier one
    starts a new alternation.
    """
    groups: list[list[str]] = [[]]
    for name in names:
        tails = [n for n in groups[-1] if name.lower().endswith(n.lower()) and not name[: -len(n)][-1:].isalnum()]
        if tails:
            groups.append([])
        groups[-1].append(name)
    return [rf"{_from_letter(g)}(?:{'|'.join(g)})" for g in groups]


def mask_levels(text: Column) -> Column:
    """Job levels written with a decimal, an integer or a roman number, then bare level names.

    The result is that of replacing every name in turn, up to doubled brackets,
    which the masking sequence collapses.
    """
    ladder = (
        [rf"{s} level\s?" for s in fixed.SENIORITIES] + [rf"{s}-level\s?" for s in fixed.SENIORITIES] + fixed.LEVEL_NAMES
    )
    managers = _from_letter(fixed.MANAGER_LEVELS) + _either(_with_commas(fixed.MANAGER_LEVELS))
    decimal, integer, roman = fixed.LEVEL_NUMBERS
    every = fixed.MANAGER_LEVELS + fixed.SENIORITIES + fixed.LEVEL_NAMES
    named = _from_letter(every) + _either(every)

    def numbered(t: Column) -> Column:
        for number, first in ((decimal, r"\d+\.\d"), (integer, r"\d")):
            needed = rf"{named}(?: level| ?-level)?\s?,?\s*{first}"
            t = rewrite_in_order(t, [rf"{managers}{number}\b"], "[MANAGER]", needed)
            passes = [f"{group}{number}" + r"\b" for group in _alternations(_with_commas(ladder))]
            t = rewrite_in_order(t, passes, "[ICLEVEL]", needed)
        return t

    # a decimal begins with a digit too, so one look at the text tells whether there is anything to do
    some = UNICODE_NOCASE + rf"{named}(?: level| ?-level)?\s?,?\s*\d"
    text = let(text, lambda t: F.when(t.rlike(some), numbered(t)).otherwise(t))
    # a manager name takes its numeral if it has one and is masked without it too
    either = _either([x for m in fixed.MANAGER_LEVELS for x in (rf"{m}{roman}\b", rf"{m}\b")])
    text = rewrite_in_order(text, [f"{_from_letter(fixed.MANAGER_LEVELS)}{either}"], "[MANAGER]")
    passes = []
    # a name longer than two letters is masked bare, so its comma spelling cannot occur afterwards
    spelled = [*ladder, *[f"{n}," for n in ladder if len(n) <= 2]]
    # names without a longer word have guards of their own
    short = {n for n in spelled if not _long_words(n)}
    for name in spelled:
        first, kind, held = _from_letter([name]), "short " if name in short else "", _long_words(name)
        passes.append((kind + "numbered", held, rf"{first}{name}{roman}\b"))
        passes.append((kind + "led", held, rf"(?=[js])\b{fixed.LEVEL_LEADS}\s*{name}\b"))
        if len(name) > 2:
            passes.append((kind + "bare", held, rf"{first}{name}\b"))
    guards = {}
    for kind, names in (("", [n for n in spelled if n not in short]), ("short ", [n for n in spelled if n in short])):
        begin, any_name = _from_letter(names), _either(names)
        guards[kind + "numbered"] = rf"{begin}{any_name}{roman}\b"
        guards[kind + "led"] = rf"(?=[js])\b{fixed.LEVEL_LEADS}\s*{any_name}\b"
        guards[kind + "bare"] = rf"{begin}{_either([n for n in names if len(n) > 2])}\b"
    # a short name, a comma and a numeral tell each other apart by their next letter
    text = rewrite_where(text, passes, "[ICLEVEL]", guards, "|".join(guards.values()), ["short numbered"])
    return rewrite_in_order(text, [r"(?=[mjsp])" + fixed.BARE_SENIORITY], "[ICLEVEL]")


def _long_words(name: str) -> list[str]:
    """The words of a level name that have four letters and more."""
    return re.findall("[A-Za-z]{4,}", name.replace(r"\s?", ""))


def mask_terms(text: Column, terms: Sequence[str], tag: str) -> Column:
    """A short list of terms as one alternation, earlier terms first."""
    return F.regexp_replace(text, UNICODE_NOCASE + rf"{_from_letter(terms)}{_either([_literal(t) for t in terms])}\b", tag)


def mask_industries(text: Column, terms: Sequence[str] = fixed.INDUSTRIES) -> Column:
    return mask_terms(text, _with_commas(terms), "[INDUSTRY]")


def mask_links(text: Column, compat: bool = False) -> Column:
    """Links, the signs of tags and mentions, and the former-employer marker.

    ``compat`` drops the marker inside words too and lets any character follow ``www``.
    """
    text = F.regexp_replace(text, UNICODE_NOCASE + r"http\S+", "[URL]")
    text = F.regexp_replace(text, UNICODE_NOCASE + (r"www.\S+" if compat else r"(?=w)\bwww\.\S+"), "[URL]")
    text = F.regexp_replace(text, UNICODE + r"#(\w+)", "$1")
    text = F.regexp_replace(text, UNICODE + r"@(\w+)", "$1")
    return F.regexp_replace(text, UNICODE + (r"[eE]x[- ]" if compat else r"(?=[eE])\b[eE]x[- ]"), "")


def fix_capitals(text: Column, terms: Sequence[str] = fixed.CAPITAL_TERMS) -> Column:
    """Capital pronouns, roman numerals and abbreviations."""
    for old, new in (("i'm", "I'm"), (" i ", " I "), (" ii", " II"), ("ii ", "II ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    for t in terms:
        text = F.regexp_replace(text, UNICODE_NOCASE + rf"{_from_letter([t])}{t}\b", t.upper())
    return text


def single_brackets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[+", "["), r"\]+", "]")


def space_mask_tokens(text: Column, tokens: Sequence[str] = fixed.MASK_TOKENS) -> Column:
    """Blanks around mask tokens; runs of blanks and blanks before commas go."""
    spellings = [s for t in tokens for s in (t, t.title(), t.lower())]
    text = F.regexp_replace(text, "(" + "|".join(_literal(s) for s in spellings) + ")", " $1 ")
    text = F.replace(F.regexp_replace(text, " {2,}", " "), F.lit(" ,"), F.lit(","))
    text = F.replace(text, F.lit(" [TITLE]"), F.lit("[TITLE]"))
    return F.replace(text, F.lit("\n\n [CONTENT] \n\n"), F.lit("\n\n[CONTENT]\n\n"))


def mask_numbers_and_terms(text: Column, compat: bool = False) -> Column:
    """The rewrites between the job titles and the organisations, in their order."""
    text = mask_levels(mask_scores(mask_experience(mask_pay(text))))
    return fix_capitals(mask_links(mask_industries(text), compat))


def mask_posts(
    posts: DataFrame,
    roles: DataFrame,
    companies: DataFrame,
    places: DataFrame,
    key: str = "post_id",
    text: str = "combined",
    out: str = "combined_mask",
    compat: bool = False,
) -> DataFrame:
    """The whole masking sequence: titles, numbers and terms, organisations, places."""
    docs = posts.select(key, text).select(key, sentence_case(F.col(text)).alias(out))
    docs = mask_phrases(docs, key, out, roles)
    docs = docs.withColumn(out, mask_numbers_and_terms(F.col(out), compat))
    docs = mask_phrases(docs, key, out, companies).withColumn(out, single_brackets(F.col(out)))
    places = without_phrases(places, fixed.PLACE_EXCEPTIONS, companies)
    docs = mask_phrases(docs, key, out, places)
    return docs.withColumn(out, space_mask_tokens(single_brackets(F.col(out))))


def entity_lexicon(entities: DataFrame, phrase: str, exceptions: Sequence[str] = fixed.ORG_EXCEPTIONS, tag: str = "[ORG]") -> DataFrame:
    """Names found by any recogniser as a lexicon, without those that hold an exception."""
    held = contains(F.col(phrase), any_pattern([_literal(e) for e in exceptions]))
    emoji = F.col(phrase).rlike(r"[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{27BF}]")
    return lexicon_of(entities.filter(~held & ~emoji), phrase, tag)


# --- tokens -----------------------------------------------------------------


def plural_root(token: Column) -> Column:
    """A light root: plural endings only."""
    return (
        F.when(token.rlike("(?i)(?:ss|us|is)$") | (F.length(token) < 4), token)
        .when(token.rlike("(?i)[a-z]ies$") & (F.length(token) > 4), F.regexp_replace(token, "(?i)ies$", "y"))
        .otherwise(F.regexp_replace(token, "(?i)s$", ""))
    )


def kept_words(text: Column, stop: Sequence[str], lower: bool = False) -> Column:
    """Words outside the stop list; compared with case unless ``lower``."""
    stops = list(stop)
    return F.filter(words(text), lambda w: ~(F.lower(w) if lower else w).isin(stops))


def token_list(text: Column, stop: Sequence[str], lower: bool = False) -> Column:
    """Words without stop-words, before and after punctuation is removed."""
    first = F.array_join(kept_words(text, stop, lower), " ")
    return kept_words(F.regexp_replace(first, UNICODE + r"[^\w\s\[\]]", " "), stop, lower)


def is_mask(token: Column) -> Column:
    return token.rlike(r"^\[.*\]")


def process_tokens(
    docs: DataFrame,
    text: str,
    out: str,
    stop: Sequence[str],
    lemmas: DataFrame | None = None,
    key: str = "post_id",
    lower: bool = False,
) -> DataFrame:
    """Token text for n-gram models: stop-words out, roots in, mask tokens in capitals.

    Roots come from a table ``word, lemma`` when one is given, through a salted
    lookup; otherwise from plural endings, without a shuffle. Texts are dealt by key
    first: tokens that meet a broadcast table stay where they are, only texts travel.
    """
    def finished(tokens: Column) -> Column:
        return F.regexp_replace(F.array_join(tokens, " "), r"(?i)\bdatum\b", "data")

    if lemmas is not None:
        docs = docs.repartition(key)
    listed = docs.withColumn("_tokens", token_list(F.col(text), stop, lower))
    if lemmas is None:
        root = F.transform("_tokens", lambda t: F.when(is_mask(t), F.upper(t)).otherwise(plural_root(t)))
        return listed.withColumn(out, finished(root)).drop("_tokens")
    flat = listed.select(key, F.posexplode("_tokens").alias("pos", "word"))
    met = lookup_join(flat, lemmas.select("word", "lemma"), "word", "left", [key, "pos"])
    rooted = F.when(is_mask(F.col("word")), F.upper("word")).otherwise(F.coalesce("lemma", "word"))
    lists = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", rooted.alias("root")))).alias("_r"))
    joined = docs.join(lists, key, "left")
    return joined.withColumn(out, F.coalesce(finished(F.col("_r.root")), F.lit(""))).drop("_r")
