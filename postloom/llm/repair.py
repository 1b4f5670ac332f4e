"""Conversation structure repair by a run-length dynamic programme.

Rows of a conversation become symbols of role and fault, and equal neighbours
one run. The legal order of roles, ``(s?(ua)+)?``, has four states: nothing yet,
after the system turn, after a user turn, after an assistant turn. Reading one
row is a four by four min-plus matrix, a run is a power of it, put together from
cached binary powers. In each state an edit's letter tells the state it leads
to, so walking forward and taking the least letter that can still reach the
cheapest end gives the cheapest edits with the least audit.

Rows are dealt by ranges of conversation and turn, so a long conversation lies
in several chunks. A chunk hands on its matrix; the costs behind each chunk are
chained backwards, the states before it forwards (a few numbers a chunk), and
the chunks are unrolled on their own. Equal rows of one turn are one row with a
count before any exchange.

Results for special rows: a null turn comes first; rows of one turn are in order
of role, the first 64 characters of the text, and its SHA-256; a null conversation
id is a conversation of its own; repeated rows are duplicates. A role that is
empty or begins with another letter than s, u and a has no legal place and is
never kept. Null roles and texts count as one space. Further columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import settle

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("s", "u", "a")
TURN_ROLE = {USER: "user", ASSISTANT: "assistant"}
# the state after the next user or assistant turn
NEXT = (USER, USER, ASSISTANT, USER)
BLANK, DUPLICATE = 8, 9
FAR = 1 << 50
MEMO = 1 << 16

# places in the numbers of a chunk
N, N_BLANK, N_DUPLICATE, N_CUT, N_ILLEGAL, FIRST_TURN, LAST_TURN, N_TURNS, FIRST, LAST = range(10)
MATRIX = 10
CHUNK_ROWS = 8192
CHUNK_BYTES = 1 << 24
# rows of a chunk carry code, count, role and text; its head, at place -1, carries numbers
FIELDS = "conv string, chunk bigint, place bigint, code int, n bigint, role string, text string, numbers array<bigint>"
BLANKS = r"\x20\x09-\x0D"


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of stacks of matrices."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def _kept(state: int, code: int) -> int | None:
    """The state after a row is kept as it is, if it may be."""
    kind = code // 2
    if state == START and kind == 0:
        return SYSTEM
    return NEXT[state] if code < BLANK and kind < 3 and ROLES[kind] == TURN_ROLE[NEXT[state]][0] else None


def _options(state: int, code: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of the edits that use up the row, in order of letters."""
    yield "D", DELETE, state
    cut = CUT * (code % 2)
    if code < BLANK:
        kept = _kept(state, code)
        if kept is not None:
            yield "K", cut, kept
        yield "R", REROLE + cut, NEXT[state]


def _inserts() -> np.ndarray:
    out = np.full((4, 4), FAR)
    for state in range(4):
        at, cost = state, 0
        for _ in range(4):
            out[state, at] = min(out[state, at], cost)
            at, cost = NEXT[at], cost + INSERT
    return out


@functools.cache
def power(code: int, k: int) -> np.ndarray:
    """The transition of ``2 ** k`` rows of a symbol."""
    if k:
        return times(power(code, k - 1), power(code, k - 1))
    direct = np.full((4, 4), FAR)
    for state in range(4):
        for _, cost, to in _options(state, code):
            direct[state, to] = min(direct[state, to], cost)
    return times(_inserts(), direct)


def run_matrix(code: int, n: int) -> np.ndarray:
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = power(code, k) if out is None else times(out, power(code, k))
    return out


def product(runs: list[tuple[int, int]]) -> np.ndarray:
    """The transition of a sequence of runs, multiplied in pairs."""
    if not runs:
        out = np.full((4, 4), FAR)
        np.fill_diagonal(out, 0)
        return out
    found = {run: run_matrix(*run) for run in set(runs)}
    stack = np.stack([found[run] for run in runs])
    while len(stack) > 1:
        even = times(stack[0 : len(stack) - 1 : 2], stack[1::2])
        stack = np.concatenate([even, stack[-1:]]) if len(stack) % 2 else even
    return stack[0]


# Costs from each state to a legal end by inserts alone.
END = tuple(int(x) for x in _inserts()[:, [START, ASSISTANT]].min(axis=1))


@functools.lru_cache(MEMO)
def _before(code: int, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    costs = np.array(after)
    for k in range(n.bit_length()):
        if n >> k & 1:
            costs = (power(code, k) + costs).min(axis=1)
    return tuple(int(x) for x in costs)


def before(code: int, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end from each state before a run, from those after it."""
    least = min(after)
    return tuple(x + least for x in _before(code, n, tuple(x - least for x in after)))


@functools.lru_cache(MEMO // 16)
def _letters(code: int, n: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """Edits of a run and the state behind it; ``after`` are the costs behind the run, less their least."""
    if n > 1:
        half = 1 << ((n - 1).bit_length() - 1)
        middle = before(code, n - half, after)
        head, state = letters(code, half, state, middle)
        tail, state = letters(code, n - half, state, after)
        return head + tail, state
    out, at = "", state
    left = before(code, 1, after)
    while True:
        found = {letter: (cost + after[to], to, True) for letter, cost, to in _options(at, code)}
        found["I"] = (INSERT + left[NEXT[at]], NEXT[at], False)
        letter = min(x for x in found if found[x][0] == left[at])
        out, (_, at, used) = out + letter, found[letter]
        if used:
            return out, at


def letters(code: int, n: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    least = min(after)
    return _letters(code, n, state, tuple(x - least for x in after))


def unrolled(runs: list[tuple[int, int]], state: int, after: tuple[int, ...]) -> tuple[list[str], int]:
    """Edits of each run from a state on, when ``after`` are the costs behind the last run.

    Blank and repeated rows go at once wherever they stand, so such a run is given as no letters.
    """
    costs = [after]
    for code, n in reversed(runs):
        costs.append(before(code, n, costs[-1]))
    out = []
    for (code, n), behind in zip(runs, reversed(costs[:-1]), strict=True):
        word = ""
        if code < BLANK:
            word, state = letters(code, n, state, behind)
        out.append(word)
    return out, state


KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
SCHEMA = pa.schema(list(zip(["conv", "chunk", "place", "code", "n", "role", "text", "numbers"], KINDS, strict=True)))
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def illegal(a: int, b: int) -> int:
    """1 for neighbours that may not follow each other, by the code points of their initials (0: none)."""
    return int((chr(a), chr(b)) not in LEGAL)


def _heads(rows: list[tuple]) -> pa.RecordBatch:
    """Heads of chunks from conversation, chunk and numbers."""
    none = [None] * len(rows)
    columns = [[r[0] for r in rows], [r[1] for r in rows], [-1] * len(rows), none, none, none, none, [r[2] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], schema=SCHEMA)


class _Chunk:
    """What a chunk of a conversation hands on; rows come in order."""

    def __init__(self, conv: str | None, number: int, cut: bool):
        self.conv, self.number, self.cut = conv, number, cut
        self.runs: list[list[int]] = []
        self.size = self.bytes = 0
        self.numbers: list = [0] * MATRIX
        for at in (FIRST_TURN, LAST_TURN, FIRST, LAST):
            self.numbers[at] = None

    def add(self, turn: int | None, code: int, n: int, initial: int, size: int) -> None:
        x = self.numbers
        x[N] += n
        if code == BLANK:
            x[N_BLANK] += n
        elif code == DUPLICATE:
            x[N_DUPLICATE] += n
        elif code % 2:
            x[N_CUT] += n
        if x[FIRST] is None:
            x[FIRST] = initial
        else:
            x[N_ILLEGAL] += illegal(x[LAST], initial)
        x[N_ILLEGAL] += n - 1
        x[LAST] = initial
        if turn is not None and turn != x[LAST_TURN]:
            x[FIRST_TURN] = turn if x[FIRST_TURN] is None else x[FIRST_TURN]
            x[LAST_TURN] = turn
            x[N_TURNS] += 1
        if self.runs and self.runs[-1][0] == code:
            self.runs[-1][1] += n
        else:
            self.runs.append([code, n])
        self.size += 1
        self.bytes += size

    def closed(self, edge: bool) -> tuple:
        """The chunk's head. A conversation that may go on in other chunks needs its matrix, any other its cost."""
        runs = [(code, n) for code, n in self.runs]
        if edge or self.cut:
            return self.conv, self.number, self.numbers + product(runs).ravel().tolist()
        costs = END
        for code, n in reversed(runs):
            costs = before(code, n, costs)
        return self.conv, self.number, [*self.numbers, costs[START]]


def _chunked(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their chunk and place, and the head of every chunk; a chunk has ``most`` rows."""
    number, now, first = TaskContext.get().partitionId() << 32, None, True
    for batch in batches:
        places, chunks, heads = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "code", "n", "initial", "size")]
        for conv, turn, code, n, initial, size in zip(*columns, strict=True):
            if now is not None and now.conv != conv:
                heads.append(now.closed(first))
                first, now = False, None
            elif now is not None and (now.size >= most or now.bytes >= CHUNK_BYTES):
                heads.append(now.closed(True))
                number += 1
                now = _Chunk(conv, number, True)
            now = _Chunk(conv, number, False) if now is None else now
            chunks.append(now.number)
            places.append(now.size)
            now.add(turn, code, n, initial, size)
        size = batch.num_rows
        plain = [batch.column("conv"), pa.array(chunks, pa.int64()), pa.array(places, pa.int64()), *[batch.column(c) for c in ("code", "n", "role", "text")]]
        yield pa.RecordBatch.from_arrays([*plain, pa.nulls(size, KINDS[-1])], schema=SCHEMA)
        if heads:
            yield _heads(heads)
    if now is not None:
        yield _heads([now.closed(True)])


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], by: int) -> Iterator[list[tuple]]:
    """Rows of each group of equal leading ``by`` columns; groups are whole and adjacent."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            if group and group[-1][:by] != row[:by]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _slices(rows: Iterable, size: int = 4096) -> Iterator[list]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def _totals(chunks: list[list[int]], cost: int) -> list[int]:
    """Counts of a conversation from those of its chunks: blank, duplicate, truncated, illegal, gaps, cost."""
    sums = [sum(x[at] for x in chunks) for at in (N_BLANK, N_DUPLICATE, N_CUT, N_ILLEGAL, N_TURNS)]
    sums[3] += sum(illegal(a[LAST], b[FIRST]) for a, b in zip(chunks[:-1], chunks[1:], strict=True))
    turns = [x for x in chunks if x[FIRST_TURN] is not None]
    distinct = sums[4] - sum(a[LAST_TURN] == b[FIRST_TURN] for a, b in zip(turns[:-1], turns[1:], strict=True))
    gaps = turns[-1][LAST_TURN] - turns[0][FIRST_TURN] + 1 - distinct if turns else 0
    return [*sums[:4], gaps, cost]


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads with the state before a chunk, where it is known, whether it is the last, and the costs behind it; at chunk -1 the totals."""

    def rows() -> Iterator[tuple]:
        for group in _groups(batches, ("conv", "chunk", "numbers"), 1):
            costs, after, cost = END, [], None
            for _, _, x in reversed(group):
                after.append(costs)
                if len(x) == MATRIX + 1:
                    cost = x[MATRIX]
                else:
                    costs = tuple(int(c) for c in (np.array(x[MATRIX:]).reshape(4, 4) + np.array(costs)).min(axis=1))
            yield group[0][0], -1, _totals([x for _, _, x in group], costs[START] if cost is None else cost)
            known = START if len(group) == 1 else None
            for at, ((conv, chunk, _), behind) in enumerate(zip(group, reversed(after), strict=True), 1):
                yield conv, chunk, [known, int(at == len(group)), *behind]

    for part in _slices(rows()):
        yield _heads(part)


def _runs_of(group: list[tuple]) -> tuple[list[tuple[int, int]], list[int]]:
    """Runs of a chunk's rows (code and count at places 3 and 4), and how many rows each has."""
    runs, sizes = [], []
    for row in group:
        if runs and runs[-1][0] == row[3]:
            runs[-1][1] += row[4]
            sizes[-1] += 1
        else:
            runs.append([row[3], row[4]])
            sizes.append(1)
    return [(code, n) for code, n in runs], sizes


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads of chunks with the state behind the chunk for each of the four states before it."""

    def rows() -> Iterator[tuple]:
        for group in _groups(batches, ("conv", "chunk", "numbers", "code", "n"), 2):
            _, last, *costs = group[0][2]
            costs = tuple(costs)
            runs, _ = _runs_of(group[1:])
            yield group[0][0], group[0][1], [last, *costs, *[unrolled(runs, state, costs)[1] for state in range(4)]]

    for part in _slices(rows()):
        yield _heads(part)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads of chunks with the state before the chunk and the costs behind it."""

    def rows() -> Iterator[tuple]:
        for group in _groups(batches, ("conv", "chunk", "numbers"), 1):
            state = START
            for conv, chunk, x in group:
                yield conv, chunk, [state, *x[:5]]
                state = x[5 + state]

    for part in _slices(rows()):
        yield _heads(part)


EDITS = "conv string, chunk bigint, place bigint, edit string, n bigint, role string, text string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each edit of a chunk, ``n`` times the same for equal rows."""

    def rows() -> Iterator[tuple]:
        for group in _groups(batches, ("conv", "chunk", "numbers", "code", "n", "role", "text"), 2):
            conv, chunk, (entry, last, *costs) = group[0][:3]
            runs, sizes = _runs_of(group[1:])
            words, _ = unrolled(runs, entry, tuple(costs))
            state, place, at = entry, 0, 1
            for word, size in zip(words, sizes, strict=True):
                for letter in word or "D" * size:
                    if letter == "I":
                        state = NEXT[state]
                        yield conv, chunk, place, "I", 1, TURN_ROLE[state], ""
                    else:
                        _, _, _, code, n, role, text = group[at]
                        at += 1
                        if letter == "D":
                            yield conv, chunk, place, "D", n, None, None
                        elif letter == "K":
                            state = _kept(state, code)
                            yield conv, chunk, place, "K", n, role, text
                        else:
                            state = NEXT[state]
                            yield conv, chunk, place, "R", n, TURN_ROLE[state], text
                    place += 1
            # what the last chunk still lacks
            while last and END[state]:
                state = NEXT[state]
                yield conv, chunk, place, "I", 1, TURN_ROLE[state], ""
                place += 1

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["conv", "chunk", "place", "edit", "n", "role", "text"]
    for part in _slices(rows(), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)


def damaged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, turn, role, text, n)``: rows with planted faults, by a hash of conversation and turn; ``n`` equal rows.

    One in twenty is dropped, emptied, loses its ends of sentences, is repeated, or becomes a user's. Nulls of role
    and text become one space; null keys and turns stay and count as one space in the hash.
    """
    blank = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat_ws(":", blank(key), blank(turn)).cast("binary")), F.lit(20))
    out = conversations.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), draw.alias("draw"))
    broken = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return out.filter("draw <> 0").select(
        F.col("key").alias(key),
        F.col("turn").alias(turn),
        F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role")).alias(role),
        broken.alias(text),
        F.when(F.col("draw") == 3, 2).otherwise(1).alias("n"),
    )


def _symbols(rows: DataFrame) -> DataFrame:
    """Different rows of ``(conv, turn, role, text, n)`` with their symbol; further copies are a row of their own."""
    known = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))
    known = settle(known.withColumn("digest", F.sha2("text", 256)), "turns")
    # the first turn of texts that a role says again, nulls first
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = known.groupBy("conv", "role", "digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    found = known.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(at > F.col("first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    ends = F.col("text").rlike(rf"[.!?][{BLANKS}]*\z")
    code = F.when(blank, BLANK).when(later, DUPLICATE).otherwise(2 * kind + F.when(ends, 0).otherwise(1)).cast("int")
    found = found.select("conv", "turn", "role", "text", "digest", "n", code.alias("code"), F.when(F.col("role") == "", 0).otherwise(F.ascii("role")).alias("initial"))
    copies = F.when(
        (F.col("n") > 1) & (F.col("code") < BLANK),
        F.array(F.struct(F.lit(0).alias("again"), F.lit(1).cast("long").alias("n"), F.col("code").alias("code")),
                F.struct(F.lit(1).alias("again"), (F.col("n") - 1).alias("n"), F.lit(DUPLICATE).alias("code"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("again"), F.col("n").alias("n"), F.col("code").alias("code"))))
    found = found.withColumn("copy", F.explode(copies))
    size = F.octet_length("text").cast("long").alias("size")
    return found.select("conv", "turn", "role", F.substring("text", 1, 64).alias("head"), "digest", "copy.again", "copy.code", "copy.n", "initial", size, "text")


def _dealt(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Rows of several tables, those of equal ``by`` together and in order."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.repartition(*by).sortWithinPartitions("conv", "chunk", "place")


def repaired(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", n: str | None = None, chunk_rows: int = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The totals of every conversation, and its edits.

    Totals: ``conv, numbers`` with the counts of blank, duplicate and truncated rows, illegal neighbours, gaps and the
    cost. Edits: ``conv, chunk, place, edit, n, role, text`` in order of chunk and place; ``K`` kept, ``R`` with another
    role, ``I`` inserted, ``D`` deleted (no role and text), ``n`` times each. ``conv`` is the key as a string.
    ``n`` names a column that counts equal rows.
    """
    count = F.col(f"`{n}`") if n else F.lit(1)
    blank = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(f"`{key}`").cast("string").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), count.alias("n")
    )
    order = ["conv", "turn", "role", "head", "digest", "again"]
    found = _symbols(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "digest", "again")
    chunks = settle(found.mapInArrow(functools.partial(_chunked, chunk_rows), FIELDS), "chunks")
    heads, lines = chunks.filter("place < 0"), chunks.filter("place >= 0")
    behind = settle(_dealt([heads], ["conv"]).mapInArrow(_behind, FIELDS), "behind")
    known, open_ = (behind.filter("chunk >= 0").filter(F.col("numbers")[0].isNotNull() == x) for x in (True, False))
    several = open_.select(F.col("conv").alias("c"), F.col("chunk").alias("k"))
    codes = lines.drop("role", "text").join(several, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left_semi")
    none = F.lit(None).cast("string")
    codes = codes.withColumn("role", none).withColumn("text", none)
    ends = _dealt([open_, codes], ["conv", "chunk"]).mapInArrow(_ends, FIELDS)
    entries = _dealt([ends], ["conv"]).mapInArrow(_entries, FIELDS)
    edits = _dealt([known, entries, lines], ["conv", "chunk"]).mapInArrow(_edits, EDITS)
    return behind.filter("chunk < 0").select("conv", "numbers"), edits


DIGEST = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation; its edits pass through one at a time."""
    names = [f.split()[0] for f in DIGEST.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]

    def rows() -> Iterator[tuple]:
        conv, open_, numbers, audit, sha, any_ = None, False, [0] * 6, [], hashlib.sha256(), False
        done = lambda: (conv, numbers[4], *numbers[:4], numbers[5], "".join(audit), sha.hexdigest())
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "chunk", "numbers", "edit", "n", "role", "text")]
            for now, chunk, x, edit, n, role, text in zip(*columns, strict=True):
                if not open_ or now != conv:
                    if open_:
                        yield done()
                    conv, open_, numbers, audit, sha, any_ = now, True, [0] * 6, [], hashlib.sha256(), False
                if chunk == -1:
                    numbers = x
                elif chunk >= 0:
                    audit.append(edit * n)
                    if edit != "D":
                        sha.update((("\n" if any_ else "") + f"{role}:{text}").encode())
                        any_ = True
        if open_:
            yield done()

    for part in _slices(rows(), 256):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)


def repair_digest(conversations: DataFrame, totals: DataFrame, edits: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each key of ``conversations``: totals, the letters of its edits, and the SHA-256 of its repaired text.

    A hash and a cell hold a conversation's letters one after another, so a conversation is one task here; its texts
    pass through in batches.
    """
    kind = conversations.schema[key].dataType.simpleString()
    long = lambda x: F.lit(x).cast("long")
    empty = {"edit": "string", "n": "long", "role": "string", "text": "string", "numbers": "array<bigint>"}

    def filled(df: DataFrame, chunk: int) -> DataFrame:
        out = df.withColumn("chunk", long(chunk)).withColumn("place", long(-1))
        for name, of in empty.items():
            out = out if name in out.columns else out.withColumn(name, F.lit(None).cast(of))
        return out

    ids = conversations.select(F.col(f"`{key}`").cast("string").alias("conv")).distinct()
    lines = edits.withColumn("numbers", F.lit(None).cast("array<bigint>"))
    out = _dealt([filled(ids, -2), filled(totals, -1), lines], ["conv"]).mapInArrow(_digests, DIGEST)
    return out.select(F.col("conv").cast(kind).alias(key), *[f.split()[0] for f in DIGEST.split(", ")[1:]])
