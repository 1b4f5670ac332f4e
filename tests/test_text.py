"""Text and date columns against plain Python statements of the same rules."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from postloom.functions import columns, dates, text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "said, day",
    [
        ("Yesterday", dt.date(2024, 11, 16)),
        ("Yesteray", dt.date(2024, 11, 16)),
        ("3d", dt.date(2024, 11, 14)),
        ("12 d", dt.date(2024, 11, 5)),
        ("5h", dt.date(2024, 11, 17)),
        ("10m", dt.date(2024, 11, 17)),
        ("Oct 14", dt.date(2024, 10, 14)),
        ("Feb 30", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_relative_dates(spark, said, day):
    assert one(spark, said, dates.relative_date) == day


def test_week_and_day(spark):
    df = spark.sql("select date'2024-11-17' d union all select date'2024-11-18'")
    rows = df.select("d", dates.week_start(F.col("d")).alias("w"), dates.day_name(F.col("d")).alias("n")).orderBy("d").collect()
    assert [(r.w.isoformat(), r.n) for r in rows] == [("2024-11-11", "Sunday"), ("2024-11-18", "Monday")]


def hashtags_by_loop(txt):
    """The splitting rule as a loop over tokens."""
    edge = " \n\t.,!?-:;"
    txt = txt.strip(edge).replace("\n", " \n ").replace("  ", " ").replace("#", " #").replace("  ", " ")
    tokens = [t.strip(edge) if t.startswith("#") else t for t in txt.split(" ")]
    tagged = [t.strip(edge).startswith("#") for t in tokens]
    last = -1
    for i, tag in enumerate(tagged):
        between = 0 < i < len(tokens) - 1 and tagged[i - 1] and tagged[i + 1]
        if not tag and not between:
            last = i
    content = " ".join(tokens[: last + 1]).replace(" \n", "\n").replace("\n ", "\n").replace("#", "")
    return content, " ".join(tokens[last + 1 :]).replace("\n", "").replace("  ", " ").strip()


TAGGED = [
    "", "no tags at all", "#only #tags", "text first #a #b", "a #mid tag here", "text #a, #b!\n#c", "x #a and #b", "#a word",
    "line\nbreak #t\n", "word#glued #b", "#a , #b", "  spaced   out  #x  ", "dots... #a. #b;", "#",
]


@pytest.mark.parametrize("value", TAGGED)
def test_hashtag_split(spark, value):
    got = one(spark, value, text.split_hashtags)
    assert (got.content, got.hashtags) == hashtags_by_loop(value)


def test_hashtag_count(spark):
    assert [one(spark, v, text.hashtag_count) for v in ("#a #b c", "é #été", None, "# x")] == [2, 1, 0, 0]


def cased_by_loop(value):
    tokens = re.split(r"(\s)", value.lower())
    special = lambda t: "[TITLE]" in t.upper() or "[CONTENT]" in t.upper()
    sentences, current = [], []
    for t in tokens:
        current.append(t)
        if t.endswith((".", "!", "?", "\n")) or special(t):
            sentences.append("".join(current))
            current = []
    sentences.append("".join(current))
    out = []
    for s in sentences:
        content = s.strip()
        out.append(s.upper() if special(s) else s.replace(content, content.capitalize()).strip(" ") if content else s.strip(" "))
    return " ".join(out).replace("\n ", "\n")


CASED = [
    "[TITLE]\n\nHELLO World\n\n\n[CONTENT]\n\nfirst one. Second ONE! third? yes", "a.b c. d", "no end", "Tab\tthere. x",
    "ends here.", "two  spaces.  then", "élan vital. été",
]


@pytest.mark.parametrize("value", CASED)
def test_sentence_case(spark, value):
    # the loop leaves a blank where a text ends right after a sentence
    assert one(spark, value, text.sentence_case).rstrip(" ") == cased_by_loop(value).rstrip(" ")


def test_ratios_and_counts(spark):
    assert [one(spark, v, text.type_token_ratio) for v in ("", "  ", "one", "a b a b", None)] == [0.0, 0.0, 1.0, 0.5, 0.0]
    assert [one(spark, v, text.word_count) for v in ("", " x ", "a\nb\tc", None)] == [0, 1, 3, 0]
    assert one(spark, "", text.kincaid_grade) == 0.0
    assert one(spark, "The cat sat. It ran.", text.kincaid_grade) == pytest.approx(0.39 * 5 / 2 + 11.8 * 5 / 5 - 15.59)


def test_small_columns(spark):
    assert one(spark, "São Tomé", columns.without_accents) == "Sao Tome"
    assert one(spark, "Straße Æsir œuvre Đà Þór ð", columns.without_accents) == "Strasse AEsir oeuvre Da Thor d"
    assert one(spark, "hELLO wORLD", columns.capitalised) == "Hello world"
    assert one(spark, "ex-Meta", columns.remove_prefix_marker) == "Meta"
    assert [one(spark, v, lambda c: columns.cap(c, 6), "int") for v in (9, 3, None)] == [6, 3, None]
    grid = columns.log_grid(0.0001, 20, 500)
    assert (len(grid), grid[0], grid[-1]) == (500, 0.0001, pytest.approx(20))


def test_java_line_ends_follow_the_rules(spark):
    assert one(spark, "please dm\n", lambda c: columns.contains(c, r"dm$"))
    assert not one(spark, "please dm\r", lambda c: columns.contains(c, r"dm$"))


@pytest.mark.parametrize("said, cased", [("ßen da. ßo\nça va", "ẞen da. ẞo\nÇa va"), ("ﬁn. ŉa. ǆ. ᾳ", "ﬁn. ŉa. Ǆ. ᾼ"), ("[title] aß", "[TITLE] Aß"), ("", "")])
def test_a_sentence_gets_one_capital(spark, said, cased):
    """Letters that upper-case to several letters, such as ß, give one capital or stay."""
    assert one(spark, said, text.sentence_case) == cased


def test_terms_are_counted_without_a_shuffle(spark):
    """A text's terms within its row; a key on several rows gets the sums, as do texts without a key."""
    from postloom.operators.tfidf import term_counts

    one_row = spark.createDataFrame([(1, "aa bb aa bb aa"), (2, ""), (3, None), (4, "cc")], "k long, t string")
    counts = term_counts(one_row, "k", "t")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == [(1, "aa", 3), (1, "aa bb", 2), (1, "bb", 2), (1, "bb aa", 2), (4, "cc", 1)]
    more = one_row.union(spark.createDataFrame([(1, "aa"), (None, "cc cc"), (None, "cc")], "k long, t string"))
    found = {(r.k, r.term): r.tf for r in term_counts(more, "k", "t").collect()}
    assert found[1, "aa"] == 4 and found[None, "cc"] == 3 and found[None, "cc cc"] == 1 and found[4, "cc"] == 1


def test_texts_meet_the_vocabulary_within_their_rows(spark):
    """The rows of the joins, whatever part of the vocabulary is broadcast; terms are not shuffled one by one."""
    from postloom.operators import tfidf

    texts = [(i, " ".join(f"w{(i * k * k) % 23}" for k in range(1, 12 + i % 5))) for i in range(60)] + [(100, ""), (101, None), (None, "w1 w2 w2")]
    docs = spark.createDataFrame(texts, "k long, t string").repartition(5).persist()
    counts = tfidf.term_counts(docs, "k", "t").persist()
    vocabulary = tfidf.fit_vocabulary(counts, 60, min_df=2)
    df = {r.term: r.n for r in counts.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.term: r.df for r in vocabulary.table.collect()} == {t: n for t, n in df.items() if 2 <= n <= 57}
    joined = {(r.k, r.term): r.weight for r in tfidf.tfidf_weights(counts, vocabulary, "k").collect()}
    for head in (0, 9, tfidf.HEAD):
        out = tfidf.text_weights(docs, vocabulary, "k", "t", head=head)
        assert {(r.k, r.term): r.weight for r in out.collect()} == pytest.approx(joined)
    assert "Exchange" not in tfidf.text_table(spark.createDataFrame(texts, docs.schema), vocabulary, "k", "t")._jdf.queryExecution().executedPlan().toString()
    indexed = tfidf.fit_vocabulary(counts, 60, min_df=2, indexed=True)
    old = {r.k: r.features for r in tfidf.tfidf_vectors(tfidf.tfidf_weights(counts, indexed, "k"), indexed, "k", docs).collect()}
    for head in (0, 9, tfidf.HEAD):
        new = {r.k: r.features for r in tfidf.text_vectors(docs, indexed, "k", "t", head=head).collect()}
        assert len(new) == len(old) == 63
        assert all(new[k].size == old[k].size and new[k].toArray() == pytest.approx(old[k].toArray()) for k in old)
    # a key on several rows
    twice = docs.union(docs.filter("k < 3"))
    again = {(r.k, r.term) for r in tfidf.text_table(twice, vocabulary, "k", "t").collect()}
    assert again == set(joined)
    assert tfidf.text_vectors(twice, indexed, "k", "t").count() == 66
    none = tfidf.fit_vocabulary(counts, 60, min_df=1000)
    assert tfidf.text_table(docs, none, "k", "t").count() == 0


def test_terms_travel_packed(monkeypatch):
    """A task hands on a row for each bucket, and again where it holds too many terms; sums are those of all rows."""
    import pyarrow as pa

    from postloom.operators import tfidf

    said = [f"é{i % 700} x" for i in range(2000)] + ["", "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array([len(s) % 3 for s in said], pa.int32()), pa.array(said)], ["bucket", "term"])
    for flush in (tfidf.FLUSH, 100):
        monkeypatch.setattr(tfidf, "FLUSH", flush)
        sent = pa.Table.from_batches(list(tfidf._term_rows(iter([batch, batch]))))
        assert sent.num_rows <= (3 if flush > 100 else 6)
        out = pa.Table.from_batches(list(tfidf._term_sums(iter(sent.sort_by("bucket").to_batches()))))
        assert dict(zip(out["term"].to_pylist(), out["df"].to_pylist(), strict=True)) == {t: 2 * said.count(t) for t in set(said)}
    assert not list(tfidf._term_rows(iter([]))) and not list(tfidf._term_sums(iter([])))


def test_terms_that_share_a_hash_are_told_apart():
    import numpy as np

    from postloom.operators.tfidf import Codes

    codes = Codes(np.array([5, 1, 5]), np.array([7, 8, 9]), np.array([0.5, 1.5, 2.5]), np.array([0, 1, 2]))
    at = codes.places(np.array([5, 5, 1, 5, 2]), np.array([9, 7, 8, 8, 8]))
    assert [codes.idx[i] if i >= 0 else -1 for i in at] == [2, 0, 1, -1, -1]
