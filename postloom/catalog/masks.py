"""Lexicons, masks and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.catalog.common import ASCII, PLAIN_DOCUMENTS, Book, ascii_text, plain_documents, sql_text, table
from postloom.functions import fixed_values as fixed
from postloom.operators import masking
from postloom.operators.lexicons import (
    company_lexicon,
    lexicon_of,
    location_lexicon,
    ordered_lexicon,
    role_lexicon,
    role_phrases,
    without_phrases,
)
from postloom.session import spread

BOOK = Book()


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


# --- lexicons ---------------------------------------------------------------


@BOOK.add(
    f"""WITH n AS (SELECT DISTINCT lower(replace(source, 'ex-', '')) AS name FROM documents WHERE source IS NOT NULL),
        v AS (SELECT name AS phrase FROM n UNION SELECT replace(name, ' ', '') FROM n UNION SELECT lower(unnest({sql_list(fixed.EXTRA_FIRMS)})))
        SELECT phrase FROM v WHERE phrase NOT IN (SELECT unnest({sql_list(fixed.FIRM_EXCEPTIONS)})) AND trim(phrase) <> ''"""
)
def company_names(spark, d):
    return company_lexicon(table(spark, d, "documents"), "source").select("phrase")


_PLACES = [*fixed.EXTRA_PLACES, *fixed.STATE_CODES, *fixed.PLACE_CODES]


@BOOK.add(
    f"""WITH n AS (SELECT lower(strip_accents(n_name)) AS p FROM nation UNION SELECT lower(r_name) FROM region
          UNION SELECT lower(unnest({sql_list(_PLACES)})))
        SELECT p AS phrase FROM n UNION SELECT replace(p, ' ', '-') FROM n UNION SELECT replace(p, ' ', '') FROM n"""
)
def place_names(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    gazetteer = names.unionByName(table(spark, d, "region").select(F.col("r_name").alias("name")))
    return location_lexicon(spark, gazetteer).select("phrase")


_ENT = "|".join(fixed.ORG_EXCEPTIONS)


@BOOK.add(
    rf"""WITH {PLAIN_DOCUMENTS}, e AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\b[A-Z][a-z]+ [A-Z][a-z]+\b'))) AS name FROM docs)
        SELECT name AS phrase FROM e WHERE NOT regexp_matches(name, '(?i)(?:{_ENT})')"""
)
def recognised_names(spark, d):
    """Pairs of capitalised words stand in for the finds of a name recogniser."""
    found = F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"), F.lit(0))
    names = plain_documents(spark, d).select(F.explode(found).alias("name")).distinct()
    return masking.entity_lexicon(names, "name").select("phrase")


# --- phrase masks -----------------------------------------------------------

PHRASES = ["the of", "in the", "of the in", "the", "that", "and the", "de la", "der", "for", "es de", "and", "the, the", "are."]
_ordered = sorted(PHRASES, key=lambda p: -len(p.split()))
_alternatives = "|".join(p.replace(".", r"\.") for p in _ordered)


@BOOK.add(
    rf"""WITH {PLAIN_DOCUMENTS} SELECT post_id, md5(regexp_replace(text, '(?i)\b(?:{_alternatives})\b', '[ROLE]', 'g')) AS masked,
        len(regexp_extract_all(text, '(?i)\b(?:{_alternatives})\b')) AS n_masked FROM docs"""
)
def masked_phrases(spark, d):
    lexicon = ordered_lexicon(spark, PHRASES, "[ROLE]")
    out = masking.mask_phrases(plain_documents(spark, d), "post_id", "text", lexicon)
    return out.select(
        "post_id", F.md5("text").alias("masked"), F.regexp_count("text", F.lit(r"\[ROLE\]")).cast("long").alias("n_masked")
    )


def _bigram_lexicon(spark, d):
    """Pairs of neighbouring words and single long words of the benchmark."""
    lowered = table(spark, d, "benchmark").select(F.lower(ascii_text(F.col("text"))).alias("t"))
    pairs = F.regexp_extract_all("t", F.lit(r"\b[a-z]+ [a-z]+\b"), F.lit(0))
    singles = F.regexp_extract_all("t", F.lit(r"\b[a-z]{5,}\b"), F.lit(0))
    return lexicon_of(lowered.select(F.explode(F.concat(pairs, singles)).alias("p")), "p", "[ORG]")


_BIGRAMS = rf"""lex AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(t, '\b[a-z]+ [a-z]+\b'), regexp_extract_all(t, '\b[a-z]{{5,}}\b'))) AS phrase
    FROM (SELECT lower({ASCII.format('text')}) AS t FROM benchmark))"""


@BOOK.add(
    rf"""WITH {PLAIN_DOCUMENTS}, {_BIGRAMS}, p AS (SELECT post_id, regexp_extract_all(lower(text), '\w+|\s+|[^\w\s]') AS ps FROM docs),
        g AS (SELECT post_id, unnest(list_concat(ps, list_transform(range(1, greatest(len(ps) - 1, 1)), lambda i: ps[i] || ps[i + 1] || ps[i + 2]))) AS gram FROM p)
        SELECT phrase, count(*) AS n_hits, count(DISTINCT post_id) AS n_posts FROM g JOIN lex ON gram = phrase GROUP BY 1"""
)
def lexicon_hits(spark, d):
    hits = masking.phrase_matches(plain_documents(spark, d), "post_id", "text", _bigram_lexicon(spark, d))
    # hits of one post come from one task, so the first count is combined there
    per_post = hits.groupBy("phrase", "post_id").agg(F.count(F.lit(1)).alias("n"))
    return per_post.groupBy("phrase").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_posts"))


@BOOK.add(
    rf"""WITH {PLAIN_DOCUMENTS}, {_BIGRAMS}, pat AS (SELECT '(?i)\b(?:' || string_agg(phrase, '|' ORDER BY len(string_split(phrase, ' ')) DESC, length(phrase) DESC) || ')\b' AS re FROM lex)
        SELECT post_id, md5(regexp_replace(text, (SELECT re FROM pat), '[ORG]', 'g')) AS masked FROM docs"""
)
def masked_names(spark, d):
    """Names learned from one table, masked in another."""
    out = masking.mask_phrases(plain_documents(spark, d), "post_id", "text", _bigram_lexicon(spark, d))
    return out.select("post_id", F.md5("text").alias("masked"))


@BOOK.add(
    rf"""WITH {PLAIN_DOCUMENTS}, {_BIGRAMS}, firms AS (SELECT DISTINCT unnest(regexp_extract_all(lower({ASCII.format('text')}), '\b[a-z]{{5,}}\b')) AS phrase FROM conversations),
        kept AS (SELECT phrase FROM lex WHERE phrase NOT IN (SELECT phrase FROM firms)),
        pat AS (SELECT '(?i)\b(?:' || string_agg(phrase, '|' ORDER BY len(string_split(phrase, ' ')) DESC, length(phrase) DESC) || ')\b' AS re FROM kept)
        SELECT post_id, md5(regexp_replace(text, (SELECT re FROM pat), '[ORG]', 'g')) AS masked FROM docs"""
)
def masked_with_exceptions(spark, d):
    """Place masking: a lexicon without the phrases that another lexicon claims."""
    firms = F.regexp_extract_all(F.lower(ascii_text(F.col("text"))), F.lit(r"\b[a-z]{5,}\b"), F.lit(0))
    claimed = table(spark, d, "conversations").select(F.explode(firms).alias("phrase"))
    lexicon = without_phrases(_bigram_lexicon(spark, d), claimed)
    out = masking.mask_phrases(plain_documents(spark, d), "post_id", "text", lexicon)
    return out.select("post_id", F.md5("text").alias("masked"))


# --- number and term masks ---------------------------------------------------

# Frequent words of the test texts become cue words and numbers.
_SWAPS = [("the", "salary"), ("of", "150k"), ("in", "5 years"), ("and", "Level"), ("that", "3"), ("for", "senior"),
          ("de", "leetcode 200"), ("la", "fintech"), ("are", "http://x.y/z"), ("is", "#hiring"), ("with", "ex-firm"),
          ("on", "manager ii"), ("a", "TC: $200k"), ("to", "E4"), ("en", "7+ yoe"), ("que", "i"), ("les", "big tech,"),
          ("der", "lc, 90"), ("die", "intern"), ("und", "complex role ii")]


def _swapped(column):
    for old, new in _SWAPS:
        column = F.regexp_replace(column, rf"(?i)\b{old}\b", new.replace("$", r"\$"))
    return column


_swapped_sql = ASCII.format("text")
for _old, _new in _SWAPS:
    _swapped_sql = rf"regexp_replace({_swapped_sql}, '(?i)\b{_old}\b', '{_new}', 'g')"
_TURNS = f"turns AS (SELECT conv_id, turn, {_swapped_sql} AS text FROM conversations)"


def _turns(spark, d):
    rows = spread(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", _swapped(ascii_text(F.col("text"))).alias("text"))


def _sequence_sql(steps: list[tuple[str, str]]) -> str:
    """Replacements one after the other, as a chain of common table expressions."""
    ctes, last = [], "turns"
    for n in range(0, len(steps), 25):
        expr = "text"
        for pattern, tag in steps[n : n + 25]:
            expr = f"regexp_replace({expr}, {sql_text('(?i)' + pattern)}, {sql_text(tag)}, 'g')"
        ctes.append(f"s{n} AS MATERIALIZED (SELECT conv_id, turn, {expr} AS text FROM {last})")
        last = f"s{n}"
    return f"WITH {_TURNS}, {', '.join(ctes)} SELECT conv_id, turn, md5(text) AS masked, length(text) AS size FROM {last}"


def _shown(df, text):
    return df.select("conv_id", "turn", text.alias("t")).select(
        "conv_id", "turn", F.md5("t").alias("masked"), F.length("t").cast("long").alias("size")
    )


def _both_ways(terms, before, after, tag):
    steps = []
    for t in [*terms, *[f"{t}," for t in terms]]:
        steps += [(before.replace("TERM", t), tag), (after.replace("TERM", t), tag)]
    return steps


_pay_terms = [f"{a} {t}" for a in fixed.PAY_LEADS for t in fixed.PAY_TERMS] + fixed.PAY_TERMS


@BOOK.add(_sequence_sql(_both_ways(_pay_terms, rf"\b{fixed.PAY_AMOUNT}\s*TERM\b", rf"\bTERM\s*[:=]?\s*{fixed.PAY_AMOUNT}\b", "[SALARY]")))
def masked_pay(spark, d):
    return _shown(_turns(spark, d), masking.mask_pay(F.col("text")))


@BOOK.add(_sequence_sql(_both_ways(fixed.EXPERIENCE_TERMS, r"\b(\d+)\+?\s*TERM\b", r"\bTERM\s*[:=]?\s*(\d+)\+?\b", "[YEARS]")))
def masked_experience(spark, d):
    return _shown(_turns(spark, d), masking.mask_experience(F.col("text")))


@BOOK.add(
    _sequence_sql(_both_ways(fixed.SCORE_TERMS, r"\b(\d+)\+?[kK]?\+?\s*TERM\b", r"\bTERM\s*[:=]?\s*(\d+)\+?[kK]?\+?\b", "[LEETCODE]"))
)
def masked_scores(spark, d):
    return _shown(_turns(spark, d), masking.mask_scores(F.col("text")))


# The written rule for levels as a table: the form of the number, whose names are meant, and the shapes in which
# such a name is masked, in this order. N is the name, # the number, + a word that leads to a level; shapes marked
# "long" hold for names of three letters and more.
LEVEL_RULE = [
    ("decimal", "manager", ["N#"]),
    ("decimal", "ladder", ["N#"]),
    ("integer", "manager", ["N#"]),
    ("integer", "ladder", ["N#"]),
    ("roman", "manager", ["N#", "N"]),
    ("roman", "ladder", ["N#", "+N", "long N"]),
]
LEVEL_TAGS = {"manager": "[MANAGER]", "ladder": "[ICLEVEL]"}
AFTER_LEVELS = [(fixed.BARE_SENIORITY, "[ICLEVEL]"), (r"\[+", "["), (r"\]+", "]")]


def level_passes() -> list[tuple[str, str]]:
    """(pattern, tag) of every single replacement, in order; bare seniorities and doubled brackets come last."""
    spelled = [f"{s}{joint}level" + r"\s?" for joint in (" ", "-") for s in fixed.SENIORITIES]
    names = {"manager": fixed.MANAGER_LEVELS, "ladder": [*spelled, *fixed.LEVEL_NAMES]}
    numbers = dict(zip(("decimal", "integer", "roman"), fixed.LEVEL_NUMBERS))
    table = [
        (shape, name + comma, numbers[form], LEVEL_TAGS[group])
        for form, group, shapes in LEVEL_RULE
        for comma in ("", ",")
        for name in names[group]
        for shape in shapes
    ]
    fill = {"N#": "{n}{number}", "N": "{n}", "long N": "{n}", "+N": fixed.LEVEL_LEADS.replace("{", "{{").replace("}", "}}") + r"\s*{n}"}
    kept = [row for row in table if row[0] != "long N" or len(row[1]) > 2]
    return [(r"\b" + fill[shape].format(n=n, number=number) + r"\b", tag) for shape, n, number, tag in kept] + AFTER_LEVELS


@BOOK.add(_sequence_sql(level_passes()))
def masked_levels(spark, d):
    return _shown(_turns(spark, d), masking.single_brackets(masking.mask_levels(F.col("text"))))


_industries = "|".join(rf"\b{t}\b" for t in [*fixed.INDUSTRIES, *[t + "," for t in fixed.INDUSTRIES]])


@BOOK.add(_sequence_sql([(_industries, "[INDUSTRY]")]))
def masked_industries(spark, d):
    return _shown(_turns(spark, d), masking.mask_industries(F.col("text")))


@BOOK.add(
    _sequence_sql(
        [(r"http\S+", "[URL]"), (r"\bwww\.\S+", "[URL]"), (r"#(\w+)", r"\1"), (r"@(\w+)", r"\1"), (r"\bex[- ]", "")]
    )
)
def masked_links(spark, d):
    return _shown(_turns(spark, d), masking.mask_links(F.col("text")))


_caps = "replace(replace(replace(replace(text, 'i''m', 'I''m'), ' i ', ' I '), ' ii', ' II'), 'ii ', 'II ')"
for _t in fixed.CAPITAL_TERMS:
    _caps = rf"regexp_replace({_caps}, '(?i)\b{_t}\b', '{_t.upper()}', 'g')"


@BOOK.add(f"WITH {_TURNS}, u AS (SELECT conv_id, turn, {_caps} AS text FROM turns) SELECT conv_id, turn, md5(text) AS masked, length(text) AS size FROM u")
def fixed_capitals(spark, d):
    return _shown(_turns(spark, d), masking.fix_capitals(F.col("text")))


_tokens = "|".join(rf"\[{s}\]" for t in fixed.MASK_TOKENS for s in (t[1:-1], t[1:-1].title(), t[1:-1].lower()))


@BOOK.add(
    rf"""WITH {_TURNS}, m AS (SELECT conv_id, turn, regexp_replace(text, '(?i)\b(salary|senior|manager)\b', '[[\1]]', 'g') AS text FROM turns),
        b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(upper(text), '\[+', '[', 'g'), '\]+', ']', 'g') AS text FROM m),
        n AS (SELECT conv_id, turn, replace(replace(text, 'SENIOR', 'Role'), 'MANAGER', 'ORG') AS text FROM b),
        s AS (SELECT conv_id, turn, replace(regexp_replace(regexp_replace(text, '({_tokens})', ' \1 ', 'g'), ' {{2,}}', ' ', 'g'), ' ,', ',') AS text FROM n)
        SELECT conv_id, turn, md5(text) AS masked, length(text) AS size FROM s"""
)
def spaced_masks(spark, d):
    text = F.regexp_replace("text", r"(?i)\b(salary|senior|manager)\b", "[[$1]]")
    text = masking.single_brackets(F.upper(text))
    text = F.replace(F.replace(text, F.lit("SENIOR"), F.lit("Role")), F.lit("MANAGER"), F.lit("ORG"))
    return _shown(_turns(spark, d), masking.space_mask_tokens(text))


# --- tokens -----------------------------------------------------------------

_STOPS = ["the", "of", "and", "in", "to", "a", "de", "la", "der", "die", "that"]
_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


@BOOK.add(
    rf"""WITH {PLAIN_DOCUMENTS}, a AS (SELECT post_id, array_to_string(list_filter({_WORDS.format('text')}, lambda w: NOT list_contains({sql_list(_STOPS)}, w)), ' ') AS t FROM docs),
        b AS (SELECT post_id, list_filter({_WORDS.format("regexp_replace(t, '[^" + chr(92) + "w" + chr(92) + "s" + chr(92) + "[" + chr(92) + "]]', ' ', 'g')")}, lambda w: NOT list_contains({sql_list(_STOPS)}, w)) AS ws FROM a),
        c AS (SELECT post_id, list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '^\[.*\]') THEN upper(w)
          WHEN regexp_matches(w, '(?i)(?:ss|us|is)$') OR length(w) < 4 THEN w
          WHEN regexp_matches(w, '(?i)[a-z]ies$') AND length(w) > 4 THEN regexp_replace(w, '(?i)ies$', 'y') ELSE regexp_replace(w, '(?i)s$', '') END) AS ws FROM b)
        SELECT post_id, len(ws)::INTEGER AS n_tokens, md5(array_to_string(ws, ' ')) AS tokens FROM c"""
)
def token_texts(spark, d):
    out = masking.process_tokens(plain_documents(spark, d), "text", "tokens", _STOPS)
    n = F.when(F.col("tokens") == "", 0).otherwise(F.size(F.split("tokens", " ")))
    return out.select("post_id", n.alias("n_tokens"), F.md5("tokens").alias("tokens"))


@BOOK.add(
    rf"""WITH {PLAIN_DOCUMENTS}, lem AS (SELECT DISTINCT w AS word, upper(substr(w, 1, 3)) AS lemma FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)),
        a AS (SELECT post_id, list_filter({_WORDS.format("regexp_replace(array_to_string(list_filter(" + _WORDS.format('text') + ", lambda w: NOT list_contains(" + sql_list(_STOPS) + ", w)), ' '), '[^" + chr(92) + "w" + chr(92) + "s" + chr(92) + "[" + chr(92) + "]]', ' ', 'g')")}, lambda w: NOT list_contains({sql_list(_STOPS)}, w)) AS ws FROM docs),
        u AS (SELECT post_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
        j AS (SELECT post_id, i, CASE WHEN regexp_matches(w, '^\[.*\]') THEN upper(w) ELSE coalesce(lemma, w) END AS r FROM u LEFT JOIN lem ON word = w),
        s AS (SELECT post_id, string_agg(r, ' ' ORDER BY i) AS t FROM j GROUP BY 1)
        SELECT d.post_id, md5(coalesce(regexp_replace(t, '(?i)\bdatum\b', 'data', 'g'), '')) AS tokens FROM docs d LEFT JOIN s USING (post_id)"""
)
def looked_up_roots(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    listed = table(spark, d, "benchmark").select(F.explode(F.array_distinct(words)).alias("word")).distinct()
    lemmas = listed.withColumn("lemma", F.upper(F.substring("word", 1, 3)))
    out = masking.process_tokens(plain_documents(spark, d), "text", "tokens", _STOPS, lemmas)
    return out.select("post_id", F.md5("tokens").alias("tokens"))


@BOOK.add()
def masked_documents(spark, d):
    """The whole masking sequence on all documents, with lexicons from the other tables."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("combined"))
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    out = masking.mask_posts(
        spread(docs), role_lexicon(spark), company_lexicon(table(spark, d, "documents"), "source"), location_lexicon(spark, names)
    )
    return out.select("post_id", F.md5("combined_mask").alias("masked"), F.length("combined_mask").alias("size"))


@BOOK.add(
    rf"""WITH {PLAIN_DOCUMENTS}, t AS (SELECT post_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bthe\b', 'software', 'g'), '(?i)\bof\b', 'engineer', 'g'), '(?i)\b(and|in)\b', 'data', 'g') AS text FROM docs)
        SELECT post_id, md5(regexp_replace(text, {sql_text('(?i)' + chr(92) + 'b(?:' + '|'.join(masking._literal(p) for p in sorted(dict.fromkeys(x.lower() for x in role_phrases()), key=lambda p: -len(p.split()))) + ')' + chr(92) + 'b')}, '[ROLE]', 'g')) AS masked FROM t"""
)
def masked_roles(spark, d):
    docs = plain_documents(spark, d)
    text = F.regexp_replace(F.regexp_replace("text", r"(?i)\bthe\b", "software"), r"(?i)\bof\b", "engineer")
    docs = docs.select("post_id", F.regexp_replace(text, r"(?i)\b(and|in)\b", "data").alias("text"))
    out = masking.mask_phrases(docs, "post_id", "text", role_lexicon(spark))
    return out.select("post_id", F.md5("text").alias("masked"))
