"""Text and date columns, linguistic features and their tabulations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postloom.catalog.common import (
    ASCII,
    PLAIN_DOCUMENTS,
    Book,
    ascii_text,
    plain_documents,
    r,
    sql_match,
    sql_text,
    table,
)
from postloom.functions import fixed_values as fixed
from postloom.functions.columns import (
    any_phrase,
    capitalised,
    contains,
    floor_to,
    SPELT,
    log_grid,
    without_accents,
)
from postloom.functions.dates import day_name, day_text, relative_date, week_start
from postloom.functions.rules import literature_flags, platform_flags
from postloom.functions.text import (
    CONTENT_MARK,
    TITLE_MARK,
    collapse_spaces,
    combined_text,
    hashtag_count,
    kincaid_grade,
    sentence_case,
    split_hashtags,
    type_token_ratio,
    word_count,
)
from postloom.functions.vectors import l2_norm, positive_probability, predicted, unit
from postloom.operators.describe import flag_shares
from postloom.operators.linguistic import semantic_features, unknown_words
from postloom.session import spread
from postloom.sources.pages import attach_text

BOOK = Book()


@BOOK.add(
    rf"""WITH {PLAIN_DOCUMENTS} SELECT post_id, {sql_match('text', r'^the\b')} AS starts, {sql_match('text', any_phrase(['the of', 'in the', 'der']))} AS any_phrase,
        len(regexp_extract_all(text, '\b[A-Z]\w+'))::INTEGER AS n_capital,
        md5(regexp_replace(text, '(\w+)-(\w+)', '\2 \1', 'g')) AS swapped, md5(replace(text, '. ', ' | ')) AS barred,
        regexp_matches(text, '\Q.\E') AS has_dot FROM docs"""
)
def regex_columns(spark, d):
    t = F.col("text")
    return plain_documents(spark, d).select(
        "post_id",
        contains(t, r"^the\b").alias("starts"),
        contains(t, any_phrase(["the of", "in the", "der"])).alias("any_phrase"),
        F.regexp_count(t, F.lit(r"\b[A-Z]\w+")).alias("n_capital"),
        F.md5(F.regexp_replace(t, r"(\w+)-(\w+)", "$2 $1")).alias("swapped"),
        F.md5(F.replace(t, F.lit(". "), F.lit(" | "))).alias("barred"),
        t.rlike(r"\Q.\E").alias("has_dot"),
    )


@BOOK.add(
    r"""SELECT doc_id, upper(lang) AS upper_lang, upper(substr(source, 1, 1)) || lower(substr(source, 2)) AS capital,
        md5(trim(text, ' .,!?')) AS trimmed, starts_with(text, 'A') AS starts_a, ends_with(text, '.') AS ends_dot,
        md5('[TITLE]' || chr(10) || chr(10) || source || chr(10) || chr(10) || chr(10) || '[CONTENT]' || chr(10) || chr(10) || text) AS combined,
        md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\[+', '[', 'g')) AS collapsed,
        len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::INTEGER AS n_words FROM documents"""
)
def string_columns(spark, d):
    t = F.col("text")
    return spread(table(spark, d, "documents")).select(
        "doc_id",
        F.upper("lang").alias("upper_lang"),
        capitalised(F.col("source")).alias("capital"),
        F.md5(F.btrim(t, F.lit(" .,!?"))).alias("trimmed"),
        t.startswith("A").alias("starts_a"),
        t.endswith(".").alias("ends_dot"),
        F.md5(combined_text(F.col("source"), t)).alias("combined"),
        F.md5(F.regexp_replace(collapse_spaces(t), r"\[+", "[")).alias("collapsed"),
        word_count(t).alias("n_words"),
    )


_spelt = "strip_accents(text)"
for _letter, _plain in {**SPELT, "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ı": "i"}.items():
    _spelt = f"replace({_spelt}, '{_letter}', '{_plain}')"


@BOOK.add(f"SELECT doc_id, md5({_spelt}) AS folded FROM documents")
def folded_accents(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(without_accents(F.col("text"))).alias("folded"))


_TAG_SOURCE = rf"regexp_replace({ASCII.format('text')}, '\b(of|de|la|the)\b', '#\1', 'g')"
_EDGE = "' ' || chr(10) || chr(9) || '.,!?-:;'"


def _split_sql(keys: str) -> str:
    """From ``a(keys, tagged)`` to ``g``: tokens, and how many of them are content."""
    return f"""b AS (SELECT {keys}, tagged, replace(replace(trim(tagged, {_EDGE}), chr(10), ' ' || chr(10) || ' '), '  ', ' ') AS s FROM a),
        c AS (SELECT {keys}, tagged, string_split(replace(replace(s, '#', ' #'), '  ', ' '), ' ') AS raw FROM b),
        e AS (SELECT {keys}, tagged, list_transform(raw, lambda t: CASE WHEN starts_with(t, '#') THEN trim(t, {_EDGE}) ELSE t END) AS tok FROM c),
        f AS (SELECT *, list_transform(tok, lambda t: starts_with(trim(t, {_EDGE}), '#')) AS tag FROM e),
        g AS (SELECT *, coalesce(list_max(list_filter(range(1, len(tok) + 1), lambda i: NOT tag[i] AND NOT
              (i > 1 AND coalesce(tag[i - 1], false) AND coalesce(tag[i + 1], false)))), 0) AS n FROM f)"""


@BOOK.add(
    f"""WITH a AS (SELECT conv_id, turn, {_TAG_SOURCE} AS tagged FROM conversations),
        {_split_sql('conv_id, turn')}
        SELECT conv_id, turn, len(regexp_extract_all(tagged, '#[A-Za-z0-9_]+'))::INTEGER AS n_tags,
          md5(replace(replace(replace(array_to_string(tok[1:n], ' '), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)), '#', '')) AS content,
          trim(replace(replace(array_to_string(tok[n + 1:], ' '), chr(10), ''), '  ', ' '), ' ') AS hashtags FROM g"""
)
def hashtag_split(spark, d):
    turns = table(spark, d, "conversations")
    tagged = turns.select("conv_id", "turn", F.regexp_replace(ascii_text(F.col("text")), r"\b(of|de|la|the)\b", "#$1").alias("tagged"))
    out = tagged.select("conv_id", "turn", hashtag_count(F.col("tagged")).alias("n_tags"), split_hashtags(F.col("tagged")).alias("s"))
    return out.select("conv_id", "turn", "n_tags", F.md5("s.content").alias("content"), F.col("s.hashtags").alias("hashtags"))


_JOINED_TAGS = rf"regexp_replace({ASCII.format('full_text')}, '\b(of|de|la|the)\b', '#\1', 'g')"


@BOOK.add(
    f"""WITH o AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 60) ELSE text END AS full_text FROM documents),
        a AS (SELECT doc_id, source, {_JOINED_TAGS} AS tagged FROM o),
        {_split_sql('doc_id, source')},
        h AS (SELECT doc_id, source, replace(replace(replace(array_to_string(tok[1:n], ' '), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)), '#', '') AS content,
          trim(replace(replace(array_to_string(tok[n + 1:], ' '), chr(10), ''), '  ', ' '), ' ') AS hashtags FROM g)
        SELECT doc_id, hashtags, md5('{TITLE_MARK}' || chr(10) || chr(10) || coalesce(source, '') || chr(10) || chr(10) || chr(10) || '{CONTENT_MARK}' || chr(10) || chr(10) || content) AS combined FROM h"""
)
def attached_texts(spark, d):
    """Full texts joined to their posts; every seventh is missing and comes from the preview of the same post."""
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    tagged = lambda c: F.regexp_replace(ascii_text(c), r"\b(of|de|la|the)\b", "#$1")
    posts = docs.select("doc_id", F.col("source").alias("title"), tagged(F.substring("text", 1, 60)).alias("post_preview"))
    full = docs.select("doc_id", F.when(F.col("doc_id") % 7 != 0, tagged(F.col("text"))).alias("full_text"))
    out = attach_text(posts, full, key="doc_id")
    return out.select("doc_id", "hashtags", F.md5("combined").alias("combined"))


_REF = dt.date(2024, 2, 1)


@BOOK.add(
    """WITH t AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Yesterday' WHEN 'view' THEN (user_id % 30) || 'd'
         WHEN 'error' THEN (user_id % 24) || 'h' WHEN 'purchase' THEN strftime(ts, '%b %-d') ELSE 'soon' END AS said, * FROM events)
       SELECT event_id, said, CASE event_type WHEN 'click' THEN '2024-01-31'
         WHEN 'view' THEN strftime(DATE '2024-02-01' - (user_id % 30)::INTEGER, '%Y-%m-%d') WHEN 'error' THEN '2024-02-01'
         WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d') END AS posted FROM t"""
)
def relative_dates(spark, d):
    said = (
        F.when(F.col("event_type") == "click", "Yesterday")
        .when(F.col("event_type") == "view", F.concat((F.col("user_id") % 30).cast("string"), F.lit("d")))
        .when(F.col("event_type") == "error", F.concat((F.col("user_id") % 24).cast("string"), F.lit("h")))
        .when(F.col("event_type") == "purchase", F.date_format("ts", "MMM d"))
        .otherwise("soon")
    )
    rows = table(spark, d, "events").select("event_id", said.alias("said"))
    return rows.select("event_id", "said", day_text(relative_date(F.col("said"), _REF)).alias("posted"))


@BOOK.add(
    """SELECT o_orderkey, dayname(o_orderdate) AS day_of_week, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week,
       strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate <= TIMESTAMP '1998-01-01' AS early FROM orders"""
)
def calendar_columns(spark, d):
    when = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", day_name(when).alias("day_of_week"), day_text(week_start(when)).alias("week"), day_text(when).alias("day"),
        (when <= F.lit("1998-01-01").cast("timestamp_ntz")).alias("early"),
    )


_grid = ", ".join(repr(c) for c in log_grid(*fixed.C_GRID))


@BOOK.add(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_discount / 3, 3)::DOUBLE AS third, round(floor(l_tax / 0.05) * 0.05, 6) AS floored,
        round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS p, (1 / (1 + exp(-(l_quantity - 25) / 10)) >= 0.5)::INTEGER AS pred,
        round(([{_grid}])[1 + (l_partkey % 500)], 9) AS c FROM lineitem"""
)
def numeric_columns(spark, d):
    p = positive_probability((F.col("l_quantity") - 25) / 10)
    grid = F.array(*[F.lit(c) for c in log_grid(*fixed.C_GRID)])
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_discount") / 3, 3).alias("third"),
        r(floor_to(F.col("l_tax"), 0.05)).alias("floored"), r(p).alias("p"), predicted(p).alias("pred"),
        F.round(F.get(grid, (F.col("l_partkey") % 500).cast("int")), 9).alias("c"),
    )


@BOOK.add(
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings)
       SELECT vec_id, round(norm, 6) AS norm, round(v[1] / norm, 6) AS first, round(sqrt(list_sum(list_transform(v, lambda x: (x / norm) * (x / norm)))), 6) AS unit_norm FROM n"""
)
def unit_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", r(l2_norm(F.col("v"))).alias("norm"), r(F.col("u")[0]).alias("first"), r(l2_norm(F.col("u"))).alias("unit_norm"))


_SENT = r"""WITH t AS (SELECT doc_id, lower(text) AS s FROM documents),
 cut AS (SELECT doc_id, string_split(regexp_replace(replace(s, chr(10), chr(10) || chr(1)), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM t),
 shaped AS (SELECT doc_id, list_transform(list_filter(parts, lambda p: p <> ''), lambda p: trim(
   regexp_extract(p, '^\s*') || upper(substr(p, length(regexp_extract(p, '^\s*')) + 1, 1)) || substr(p, length(regexp_extract(p, '^\s*')) + 2), ' ')) AS parts FROM cut)
SELECT doc_id, md5(replace(array_to_string(parts, ' '), chr(10) || ' ', chr(10))) AS cased FROM shaped"""


@BOOK.add(_SENT)
def sentence_cased(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(sentence_case(F.col("text"))).alias("cased"))


_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


@BOOK.add(
    f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents)
        SELECT doc_id, len(ws)::INTEGER AS post_length, round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws))::DOUBLE / len(ws) ELSE 0 END, 6) AS type_token_ratio FROM w"""
)
def word_ratios(spark, d):
    t = F.col("text")
    return spread(table(spark, d, "documents")).select(
        "doc_id", word_count(t).alias("post_length"), r(type_token_ratio(t)).alias("type_token_ratio")
    )


_KINCAID = r"""SELECT post_id, ws, 0.39 * len(ws) / greatest(len(regexp_extract_all(text, '[.!?]+')), 1)
  + 11.8 * list_sum(list_transform(ws, lambda w: greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1))) / len(ws) - 15.59 AS grade
  FROM (SELECT post_id, text, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS ws FROM docs)"""


@BOOK.add(
    f"WITH {PLAIN_DOCUMENTS}, k AS ({_KINCAID}) SELECT post_id, round(CASE WHEN len(ws) > 0 THEN grade ELSE 0 END, 10) AS kincaid_grade FROM k"
)
def reading_grade(spark, d):
    return plain_documents(spark, d).select("post_id", r(kincaid_grade(F.col("text")), 10).alias("kincaid_grade"))


_JARGON = "|".join(fixed.JARGON)
_UNKNOWN = rf"""docwords AS (SELECT DISTINCT post_id, unnest(list_filter(string_split_regex(
    regexp_replace(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\b({_JARGON})\b', '', 'g'), '\s+'), lambda w: w <> '')) AS word FROM docs),
  known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
  missing AS (SELECT post_id, count(*) AS spell_errors FROM docwords WHERE word NOT IN (SELECT word FROM known) GROUP BY 1)"""


def benchmark_words(spark, d):
    """The distinct words of the benchmark items, as a dictionary."""
    listed = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "benchmark").select(F.explode(F.array_distinct(listed)).alias("word")).distinct()


@BOOK.add(f"WITH {PLAIN_DOCUMENTS}, {_UNKNOWN} SELECT post_id, spell_errors FROM missing")
def unknown_word_counts(spark, d):
    return unknown_words(plain_documents(spark, d), benchmark_words(spark, d), "post_id", "text")


@BOOK.add(
    f"""WITH {PLAIN_DOCUMENTS}, {_UNKNOWN}, k AS ({_KINCAID}), w AS (SELECT post_id, {_WORDS.format('text')} AS ws FROM docs)
        SELECT w.post_id, round(CASE WHEN len(w.ws) > 0 THEN len(list_distinct(w.ws))::DOUBLE / len(w.ws) ELSE 0 END, 6) AS type_token_ratio,
          len(w.ws)::INTEGER AS post_length, round(CASE WHEN len(w.ws) > 0 THEN grade ELSE 0 END, 10) AS kincaid_grade,
          coalesce(spell_errors, 0)::BIGINT AS spell_errors FROM w JOIN k USING (post_id) LEFT JOIN missing USING (post_id)"""
)
def semantic_measures(spark, d):
    out = semantic_features(plain_documents(spark, d), benchmark_words(spark, d), "post_id", "text")
    return out.select(
        "post_id", r("type_token_ratio").alias("type_token_ratio"), "post_length", r("kincaid_grade", 10).alias("kincaid_grade"), "spell_errors"
    )


# Frequent words of the test texts become cue words, so that the flags are not constant.
_SWAPS = [("the", "please"), ("of", "python"), ("in", "layoff"), ("and", "asap"), ("that", "we"), ("for", "laid off"),
          ("de", "engineer at"), ("la", "student"), ("are", "thanks"), ("der", "[ORG]")]


def _swapped(column):
    for old, new in _SWAPS:
        column = F.regexp_replace(column, rf"(?i)\b{old}\b", new)
    return column


def _swapped_sql(column: str) -> str:
    for old, new in _SWAPS:
        column = rf"regexp_replace({column}, '(?i)\b{old}\b', '{new}', 'g')"
    return column


def _flag_sql(name: str, pattern: str) -> str:
    test = sql_match("text", pattern)
    if name == "previous_experience":
        test = f"({test} OR {sql_match('text', fixed.POSITION_HELD)})"
    return f"{test} AS {name}"


_cue_text = f"t AS (SELECT conv_id, turn, {_swapped_sql(ASCII.format('text'))} AS text FROM conversations)"


def _cue_turns(spark, d):
    turns = spread(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return turns.select("conv_id", "turn", _swapped(ascii_text(F.col("text"))).alias("text"))


@BOOK.add(f"WITH {_cue_text} SELECT conv_id, turn, {', '.join(_flag_sql(n, p) for n, p in fixed.PLATFORM_CUES)} FROM t")
def platform_cue_flags(spark, d):
    return _cue_turns(spark, d).select("conv_id", "turn", *platform_flags(F.col("text")))


@BOOK.add(f"WITH {_cue_text} SELECT conv_id, turn, {', '.join(_flag_sql(n, p) for n, p in fixed.LITERATURE_CUES)} FROM t")
def literature_cue_flags(spark, d):
    return _cue_turns(spark, d).select("conv_id", "turn", *literature_flags(F.col("text")))


_long = " UNION ALL ".join(
    f"SELECT {sql_text(n)} AS feature, {sql_match('text', p)} AS value FROM t" for n, p in fixed.LITERATURE_CUES
)


@BOOK.add(
    f"""WITH {_cue_text}, long AS ({_long}) SELECT feature, value, count(*) AS n,
        round(count(*)::DOUBLE / (SELECT count(*) FROM t), 6) AS share FROM long GROUP BY feature, value"""
)
def cue_tabulation(spark, d):
    flags = _cue_turns(spark, d).select(*literature_flags(F.col("text")))
    return flag_shares(flags, flags.columns).withColumn("share", r("share"))
