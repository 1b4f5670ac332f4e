import random

import public_tokenizers
import pyarrow as pa
import pytest
from texts import hard_texts, table
from tokenizers import Tokenizer

from postloom.llm.bpe import _decode, decoded, encoded

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = hard_texts() + [
        "It's THE 'llama's don't Σας ΣΑΣ İstanbul ﬁ é 漢字かな 1234 ½ x²!!!???...", "a\x1cb c d　e \x00\x01 \x7f",
        "<|startoftext|>hi<|endoftext|> there <|startoftext", "ababababab thththth ingingin" * 30, "a" * 5000,
    ]
    for _ in range(300):
        out.append("".join(rng.choice("abcdeinghtors'AE é1 ß\n\t漢🙂.,!<|>") for _ in range(rng.randrange(80))))
    return out


@pytest.mark.parametrize("known", [200_000, 3])
def test_ids_and_text_of_the_library(spark, texts, known):
    library = Tokenizer.from_file(PATH)
    rows = decoded(encoded(table(spark, texts), PATH, keep=["key"], known_pieces=known), PATH, "back").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.back == library.decode(ids, skip_special_tokens=False)
        assert r.key == "k"


def test_empty_table(spark):
    assert decoded(encoded(table(spark, []), PATH), PATH).count() == 0


def test_null_ids_have_no_text(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [tuple(r) for r in decoded(rows, PATH).collect()] == [(1, None, None), (2, [], "")]


def test_tokens_are_joined_without_a_step_for_each(monkeypatch):
    class Names(list):
        asked = 0

        def __getitem__(self, i):
            Names.asked += 1
            return super().__getitem__(i)

    class Shared:
        value = Names(["a</w>", "b", "é</w>"])

    monkeypatch.setattr("postloom.llm.bpe.DECODED_IDS", 4)
    lists = [[0, 1, 2], [], None, [2] * 9, [1]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], ["ids"])
    out = [t for b in _decode(Shared)(iter([batch, batch.slice(1, 2), batch.slice(0, 0)])) for t in b.column("decoded").to_pylist()]
    plain = [None if x is None else " ".join(list(Shared.value)[i] for i in x) for x in lists]
    assert out == plain + plain[1:3]
    assert Names.asked <= len(Shared.value)
