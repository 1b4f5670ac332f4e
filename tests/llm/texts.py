"""Small texts with the hard cases: nulls, blanks, very long, ties, copies, other scripts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def hard_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "漢字", "A", "The", "a b", "x y", "\U0001f642"]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared, base = some(60), some(120)
    out = [None, "", " \t\n\r\x0b\x0c ", "one", "one", "ONE two\tthree", "a a a a a a a a a a a a " * 9, some(20000), base, base]
    for _ in range(n):
        kind = rng.randrange(5)
        if kind == 0:
            out.append(some(rng.randrange(1, 90)))
        elif kind == 1:
            out.append(some(rng.randrange(30)) + "\n" + shared + " " + some(rng.randrange(30)))
        elif kind == 2:
            near = base.split(" ")
            for _ in range(rng.randrange(1, 5)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append("  ".join(near))
        elif kind == 3:
            out.append((base + "\n") * 2 + some(5))
        else:
            out.append(some(4).upper())
    return out


def table(spark, texts, **more):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(i, t, 7, "k", 1.5, [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int, key string, score double, ids array<int>")
