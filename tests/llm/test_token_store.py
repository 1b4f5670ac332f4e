import sys
import zlib

import numpy as np
import public_tokenizers
from texts import hard_texts, table
from tokenizers import Tokenizer

from postloom.llm.token_store import TextEncoder, TokenFile, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_files_give_the_ids_of_the_library(spark):
    texts = hard_texts() + ["a  b", " a", "a ", "a\n b", "x <|endoftext|> y", "tab\t end", "don't we'll  \n\n ok"]
    library = Tokenizer.from_file(PATH)
    files = write_tokens(table(spark, texts), PATH, end=2)
    rows = read_tokens(spark, files).orderBy("doc_id").collect()
    start = 0
    for i, (t, r) in enumerate(zip(texts, rows, strict=True)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_one_document_is_read_by_its_index_entry(spark):
    texts = ["red green", None, "blue " * 50]
    files = write_tokens(table(spark, texts), PATH, end=2).filter("first <= 2 and last >= 2").collect()
    ids = TokenFile(files[0].path).document(2)
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(texts[2]).ids + [2]


def test_a_trained_dictionary_is_named_by_its_hash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files = write_tokens(docs, PATH, end=2).collect()
    hashes = {TokenFile(f.path).dictionary_hash for f in files}
    assert len(hashes) == 1
    assert sum(f.n_docs for f in files) == docs.count()


def test_empty_table_and_a_full_store_of_pieces(spark):
    assert read_tokens(spark, write_tokens(table(spark, []), PATH, end=2)).count() == 0
    texts = [t or "" for t in hard_texts()]
    library = Tokenizer.from_file(PATH)
    for got, t in zip(TextEncoder(PATH, known_pieces=5).encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t).ids


def test_new_pieces_go_to_the_library_as_one_text():
    encoder = TextEncoder(PATH)
    given, raw = [], encoder._raw
    encoder._raw = lambda texts: given.extend(texts) or raw(texts)
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}word{'!' * (i % 3)}" for i in range(600)), "oneword", "", "é x z\ty  w"]
    library = Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from the store
        for got, t in zip(encoder.encode(texts), texts, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t).ids
    assert len(given) < 20


def test_new_pieces_are_checked_in_whole_columns():
    encoder = TextEncoder(PATH)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    text = "a " + " ".join(words)
    calls = []
    sys.setprofile(lambda _, event, what: calls.append(what.__name__) if event == "c_call" else None)
    try:
        encoder.encode([text])
    finally:
        sys.setprofile(None)
    assert sum(c in ("isspace", "rstrip", "isalpha", "get") for c in calls) < 100
    library = Tokenizer.from_file(PATH)
    for space in "\x1c\x1f\x85\xa0  　​":
        odd = [f"a b{space} c", f"a {space}b c", f"a {space} c", f"a b!{space}", f"a b{space}!? c?!"]
        for got, t in zip(encoder.encode(odd), odd, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t).ids
