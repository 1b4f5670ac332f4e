"""Text columns: ratios, hashtags, sentence case and readability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.columns import let, text_or_empty, words

# Characters stripped around a text and around a hashtag, and
# the markers of the title and content sections.
EDGE_CHARS = " \n\t.,!?-:;"
TITLE_MARK = "[TITLE]"
CONTENT_MARK = "[CONTENT]"


def combined_text(title: Column, text: Column) -> Column:
    """Title and text under their section markers; a missing text is empty."""
    return F.concat(
        F.lit(f"{TITLE_MARK}\n\n"), text_or_empty(title), F.lit(f"\n\n\n{CONTENT_MARK}\n\n"), text_or_empty(text)
    )


def hashtag_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)#\w+")), F.lit(0))


def split_hashtags(text: Column) -> Column:
    """Struct of the content and its trailing hashtags.

    The content ends at the last word that is no hashtag and does not stand
    between two hashtags. Tags inside the content lose their sign.
    """
    spaced = F.replace(F.btrim(text_or_empty(text), F.lit(EDGE_CHARS)), F.lit("\n"), F.lit(" \n "))
    spaced = F.replace(F.replace(spaced, F.lit("  "), F.lit(" ")), F.lit("#"), F.lit(" #"))
    raw = F.split(F.replace(spaced, F.lit("  "), F.lit(" ")), " ")
    tokens = F.transform(
        raw, lambda t: F.when(t.startswith("#"), F.btrim(t, F.lit(EDGE_CHARS))).otherwise(t)
    )

    def parts(t: Column) -> Column:
        tag = F.transform(t, lambda x: F.btrim(x, F.lit(EDGE_CHARS)).startswith("#"))

        def last_content(g: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(g) - 1)
            plain = F.filter(
                places,
                lambda i: ~F.get(g, i)
                & ~(
                    F.coalesce(F.when(i > 0, F.get(g, i - 1)), F.lit(False))
                    & F.coalesce(F.get(g, i + 1), F.lit(False))
                ),
            )
            return F.coalesce(F.array_max(plain), F.lit(-1)) + 1

        def build(n: Column) -> Column:
            content = F.array_join(F.slice(t, F.lit(1), n), " ")
            content = F.replace(F.replace(content, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
            tags = F.array_join(F.slice(t, n + 1, F.greatest(F.size(t) - n, F.lit(0))), " ")
            tags = F.replace(F.replace(tags, F.lit("\n"), F.lit("")), F.lit("  "), F.lit(" "))
            return F.struct(
                F.replace(content, F.lit("#"), F.lit("")).alias("content"),
                F.trim(tags).alias("hashtags"),
            )

        return let(let(tag, last_content), build)

    return let(tokens, parts)


def capital(c: Column) -> Column:
    """One character as one capital; a ligature that only upper-cases to several letters stays as it is."""
    upper, title = F.upper(c), F.initcap(c)
    single = lambda x: F.length(x) <= 1
    return F.when(c == "ß", "ẞ").when(single(upper), upper).when(single(title), title).otherwise(c)


def sentence_case(text: Column) -> Column:
    """Lower-case the text, then give every sentence a capital.

    A sentence ends at a word ending in ``.``, ``!`` or ``?``, at a new line and
    at a section marker; sentences that hold a marker are upper-cased.
    """
    mark = r"\[(?:title|content)\]\S*"
    sentence = rf"(?sdU)[^\n]*?(?:{mark}|[.!?](?=\s|\z)|\n)|[^\n]+"
    sentences = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(sentence), F.lit(0))

    def shaped(s: Column) -> Column:
        lead = F.regexp_extract(s, r"^(?U)\s*", 0)
        start = F.length(lead) + 1
        first = let(s.substr(start, F.lit(1)), capital)
        rest = s.substr(start + 1, F.length(s))
        return F.when(s.rlike(r"\[(?:title|content)\]"), F.upper(s)).otherwise(F.trim(F.concat(lead, first, rest)))

    joined = F.array_join(F.transform(sentences, shaped), " ")
    return F.replace(joined, F.lit("\n "), F.lit("\n"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def type_token_ratio(text: Column) -> Column:
    """Distinct words over words; 0 for a text without words."""
    return let(
        words(text),
        lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0)),
    )


def syllable_count(text: Column) -> Column:
    """Vowel groups per word, at least one per word."""
    counts = F.transform(
        words(F.lower(text)), lambda w: F.greatest(F.regexp_count(w, F.lit("[aeiouy]+")), F.lit(1))
    )
    return F.aggregate(counts, F.lit(0), lambda acc, c: acc + c)


def kincaid_grade(text: Column) -> Column:
    """Grade level from words per sentence and syllables per word."""
    n_words = word_count(text)
    n_sentences = F.greatest(F.regexp_count(text_or_empty(text), F.lit(r"[.!?]+")), F.lit(1))
    # The coefficients of the grade-level formula.
    grade = 0.39 * n_words / n_sentences + 11.8 * syllable_count(text) / n_words - 15.59
    return F.when(n_words > 0, grade).otherwise(F.lit(0.0))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")
