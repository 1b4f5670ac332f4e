import hashlib
import random
import re
import zlib

import pytest

from postloom.llm import repair
from postloom.llm.catalog import op12_run_repair
from postloom.llm.repair import damaged, repair_digest, repaired

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n string, chunk int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def harmed(rows):
    """The rows of each conversation after damage, one by one and in order."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        mine = out.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        mine += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: sorted(mine, key=order) for conv, mine in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = WORD.findall(text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, marks):
    """Least ``(cost, audit)`` and the repaired rows, from every state at every row on."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    best = {q: (0, "", []) if q in (0, 3) else None for q in range(4)}

    def with_inserts(now):
        for _ in range(4):
            for q in range(4):
                then = now[after[q]]
                if then is not None:
                    tried = (then[0] + 2, "I" + then[1], [f"{name[after[q]]}:", *then[2]])
                    if now[q] is None or tried[:2] < now[q][:2]:
                        now[q] = tried
        return now

    best = with_inserts(best)
    for (_, role, text), fault in zip(reversed(rows), reversed(marks)):
        now = {}
        for q in range(4):
            tries = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                to = after[q]
                tries.append((best[to][0] + 2 + cut, "R" + best[to][1], [f"{name[to]}:{text}", *best[to][2]]))
                if role[:1] == name[to][0]:
                    tries.append((best[to][0] + cut, "K" + best[to][1], [f"{role}:{text}", *best[to][2]]))
                if q == 0 and role[:1] == "s":
                    tries.append((best[1][0] + cut, "K" + best[1][1], [f"{role}:{text}", *best[1][2]]))
            now[q] = min(tries, key=lambda t: t[:2])
        best = with_inserts(now)
    return best[0]


def plain(rows):
    out = {}
    for conv, mine in harmed(rows).items():
        marks = faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, texts = cheapest(mine, marks) if mine else (0, "", [])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[marks.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(texts).encode()).hexdigest(),
        )
    return out


def conversations(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "And", "", " \t", None, "Why?", "Well ", "é。", "Fine.\n"]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "User", "unknown"]
    rows = []
    for conv in range(n):
        order = rng.choice(["legal", "any"])
        for turn in range(rng.randrange(0, 14)):
            role = ("assistant" if turn % 2 else "user") if order == "legal" else rng.choice(roles)
            text = f"Said {rng.randrange(6)}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 3]), role, text, "x", 1))
    rows += [(None, t, "user", f"t{t}.", "x", 1) for t in range(5)]
    rows += rows[10:30] + [(900, None, "user", "a.", "x", 1)] * 4
    rows += [(901, t, "user" if t % 3 else "assistant", "word " * 30000 + ".", "x", 1) for t in range(6)]
    # long runs of one symbol
    rows += [(902, t, "user", f"{t}.", "x", 1) for t in range(150)] + [(903, t, "assistant", f"{t // 2}" + "." * (t % 2), "x", 1) for t in range(150)]
    return rows


def results(found):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}


@pytest.mark.parametrize("seed, chunk", [(1, 8192), (2, 8192), (3, 3), (4, 1)])
def test_against_plain_search(spark, seed, chunk):
    """Whole conversations, and conversations cut into many chunks."""
    rows = conversations(seed)
    table = spark.createDataFrame(rows, SCHEMA)
    harm = damaged(table)
    assert results(repair_digest(table, *repaired(harm, n="n", chunk_rows=chunk))) == plain(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert results(op12_run_repair(spark, sf)) == plain(rows)


def test_hot_conversation(spark):
    """One conversation with most rows, and equal rows, spreads over chunks."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"line {t % 1701}.", "x", 1) for t in range(4000)] + [(2, 0, "user", "same", "x", 1)] * 4000
    table = spark.createDataFrame(rows, SCHEMA)
    totals, edits = repaired(damaged(table), n="n", chunk_rows=500)
    assert edits.filter("conv = '1'").select("chunk").distinct().count() >= 7
    assert edits.filter("conv = '2'").count() <= 4
    assert results(repair_digest(table, totals, edits)) == plain(rows)


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert repair_digest(table, *repaired(damaged(table), n="n")).count() == 0


def test_powers_are_repeated_steps():
    for code in range(10):
        step = repair.power(code, 0)
        out = step
        for _ in range(12):
            out = repair.times(out, step)
        assert (repair.run_matrix(code, 13) == out).all()
        assert (repair.product([(code, 5), (code, 8)]) == out).all()
