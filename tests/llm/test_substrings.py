from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from texts import hard_texts, table, words

from postloom.llm.substrings import _repeated, without_repeats


def plain(texts, window):
    seen = Counter(tuple(w[i : i + window]) for w in map(words, texts) for i in range(len(w) - window + 1))
    out = {}
    for key, w in enumerate(map(words, texts)):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[key] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("window, gram, hot", [(35, 8, 2000), (35, 8, 1), (5, 2, 3), (3, 3, 2000)])
def test_words_of_repeated_windows_go(spark, window, gram, hot):
    texts = hard_texts()
    found = without_repeats(table(spark, texts), window=window, gram=gram, hot=hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == plain(texts, window)
    assert len(found) == len(texts)


def test_empty_table_and_kept_columns(spark):
    docs = table(spark, ["a b c", None])
    assert without_repeats(docs.limit(0)).count() == 0
    rows = without_repeats(docs, keep=["key", "n"]).orderBy("doc_id").collect()
    assert [(r.key, r.n, r.kept_text) for r in rows] == [("k", 7, "a b c"), ("k", 7, "")]


def test_buckets_are_searched_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    strings = [b" ".join(b"%016d" % w for w in rng.integers(0, 50, 60)) for _ in range(2500)]
    strings[7] = strings[2400]
    n = len(strings)
    columns = [pa.array(range(n)), pa.array([0] * n, pa.int64()), pa.array([26] * n, pa.int32()), pa.array([1] * n, pa.int64()), pa.array(strings, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "start", "n", "mini", "packed"])
    tracemalloc.start()
    found = [r for b in _repeated(35)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [{"key": k, "begin": 0, "end": 60} for k in (7, 2400)]
    assert peak < 64 << 20
