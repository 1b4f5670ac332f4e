"""Each stage against a plain version, on the rows its predecessor keeps."""

import public_tokenizers
import pytest
from test_jaccard import plain as jaccard_plain
from test_substrings import plain as substrings_plain
from tokenizers import Tokenizer

import corpus_pipeline
from postloom.llm.quality import quality_rules
from postloom.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], sf), "test-stage"))
    return out


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[1:-1])


def test_quality_keeps_what_passes(stages):
    kept = {r.doc_id for r in quality_rules(stages[0]).collect() if r.kept}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] in kept]


def test_one_of_each_group_stays(stages):
    before = sorted(rows(stages[1]))
    found = jaccard_plain([r[1] for r in before])
    assert rows(stages[2]) == sorted((r for i, r in enumerate(before) if found[i][1] == i), key=str)


def test_repeated_passages_go(stages):
    before = sorted(rows(stages[2]))
    cut = substrings_plain([r[1] for r in before], 35)
    wanted = []
    for i, r in enumerate(before):
        _, gone, left = cut[i]
        if not gone:
            wanted.append(r)
        elif left:
            wanted.append((r[0], left, r[2], r[3], len(left)))
    assert rows(stages[3]) == sorted(wanted, key=str)


def test_mixture_takes_whole_rows(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(after) <= set(before)
    assert 0 < len(after) and max(after.count(r) for r in after) <= corpus_pipeline.EPOCHS


def test_ids_of_the_library(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] for r in rows(stages[4])}
    found = stages[5].collect()
    assert len(found) == stages[4].count()
    assert all(r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in found)


def test_null_rows_and_an_empty_table(spark, sf, stages):
    hard = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "xx", "src1", 0), (-3, " a ", "en", None, 3)], stages[0].schema)
    for start in (hard, hard.limit(0), stages[0].limit(40).union(hard)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, sf), "test-stage")
        assert docs.columns == ["doc_id", "source", "n_tokens", "ids"]
    for _, stage in corpus_pipeline.STAGES:  # each stage on its own
        assert stage(spark, hard, sf).count() >= 0
