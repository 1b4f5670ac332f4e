"""Rule labels, classes, the time split and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.catalog.common import (
    ASCII,
    COMMENTS,
    CUE_CANDIDATE,
    CUE_EXCLUDE,
    CUE_FLAG,
    CUE_INCLUDE,
    CUES,
    PLAIN_DOCUMENTS,
    Book,
    ascii_text,
    comments_table,
    plain_documents,
    r,
    sql_any,
    sql_match,
    sql_text,
    table,
)
from postloom.functions import fixed_values as fixed
from postloom.functions.columns import any_phrase
from postloom.functions.rules import offer_flag, referral_flag, request_flag
from postloom.operators.describe import label_checks, split_sizes, violations
from postloom.operators.labels import (
    add_offer_counts,
    class_labels,
    firm_rates,
    flag_offers,
    flag_requests,
    format_columns,
    label_offers,
    mark_train_test,
    nontext_features,
    rule_counts,
    stratified_folds,
    stratified_split,
    target_encoding,
)
from postloom.operators.quantiles import quantile_class
from postloom.session import scratch_path, settle, spread
from postloom.streaming.labels import write_stream

BOOK = Book()


def edges_sql(value: str, q: int, source: str, where: str = "true") -> str:
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont({value}::DOUBLE, [{probs}]))) FROM {source} WHERE {where})"


def bin_sql(value: str, edges: str) -> str:
    return f"len(list_filter({edges}[2:len({edges}) - 1], lambda e: e < {value}::DOUBLE))"


@BOOK.add(
    f"""WITH {COMMENTS}, agg AS (SELECT post_id, sum({CUE_FLAG}::INTEGER)::BIGINT AS n FROM comments GROUP BY post_id),
        e AS (SELECT {edges_sql('n_chars', 5, 'documents')} AS edges)
        SELECT doc_id AS post_id, coalesce(n, 0)::BIGINT AS num_offers, (coalesce(n, 0) > 0)::INTEGER AS class_offers,
          {bin_sql('n_chars', 'edges')}::INTEGER AS class_views FROM documents CROSS JOIN e LEFT JOIN agg ON doc_id = post_id"""
)
def labelled_documents(spark, d):
    """Offers per post and the classes of every post: the flagship query."""
    posts = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.col("n_chars").alias("num_views"))
    counted = add_offer_counts(posts, flag_offers(comments_table(spark, d), **CUES))
    out = class_labels(counted, "num_views", ["num_offers"], source=posts)
    return out.select("post_id", "num_offers", "class_offers", "class_views")


@BOOK.add(f"WITH {COMMENTS} SELECT post_id, comment_id, {CUE_FLAG} AS referral_offer FROM comments")
def offer_flags(spark, d):
    return flag_offers(comments_table(spark, d), **CUES).select("post_id", "comment_id", "referral_offer")


_case = " ".join(f"WHEN {sql_match('text', p)} THEN {sql_text(n)}" for n, p in reversed([*CUE_INCLUDE, *CUE_EXCLUDE]))


@BOOK.add(
    f"""WITH {COMMENTS} SELECT post_id, comment_id, CASE WHEN {sql_match('text', CUE_CANDIDATE)}
        THEN CASE {_case} ELSE '(no match)' END END AS patterns FROM comments"""
)
def offer_rule_labels(spark, d):
    return label_offers(comments_table(spark, d), **CUES).select("post_id", "comment_id", "patterns")


@BOOK.add(
    f"""WITH {COMMENTS}, l AS (SELECT CASE WHEN {sql_match('text', CUE_CANDIDATE)}
        THEN CASE {_case} ELSE '(no match)' END END AS patterns FROM comments)
        SELECT patterns, count(*) AS n FROM l WHERE patterns IS NOT NULL GROUP BY 1"""
)
def offer_rule_counts(spark, d):
    return rule_counts(label_offers(comments_table(spark, d), **CUES))


_offer = f"({sql_match('text', fixed.OFFER_CANDIDATE)} AND {sql_any('text', fixed.OFFER_INCLUDE)} AND NOT {sql_any('text', fixed.OFFER_EXCLUDE)})"
_mention = sql_match("text", fixed.REFERRAL_MENTION)
_request = sql_match("text", any_phrase(fixed.REQUEST_PHRASES))

# The test texts hold none of the real cues, so their most frequent words are
# rewritten to cue words; the rules then decide on derived text of full length.
_rewrites = [("the", "dm"), ("of", "for"), ("to", "me"), ("and", "please"), ("in", "need"), ("that", "sent"), ("la", "referral"), ("de", "dm")]


def _cued(column):
    for old, new in _rewrites:
        column = F.regexp_replace(column, rf"(?i)\b{old}\b", new)
    return column


def _cued_sql(column: str) -> str:
    for old, new in _rewrites:
        column = rf"regexp_replace({column}, '(?i)\b{old}\b', '{new}', 'g')"
    return column


@BOOK.add(
    f"""WITH t AS (SELECT conv_id, turn, {_cued_sql(ASCII.format('text'))} AS text FROM conversations)
        SELECT conv_id, turn, {_offer} AS referral_offer, {_mention} AS is_referral, {_request} AS is_request FROM t"""
)
def fixed_rule_flags(spark, d):
    turns = spread(table(spark, d, "conversations")).select("conv_id", "turn", _cued(ascii_text(F.col("text"))).alias("text"))
    return turns.select(
        "conv_id", "turn", offer_flag(F.col("text")).alias("referral_offer"),
        referral_flag(F.col("text")).alias("is_referral"), request_flag(F.col("text")).alias("is_request"),
    )


_title_text = f"({_cued_sql('t.title')} || ' ' || {_cued_sql('t.text')})"


@BOOK.add(
    f"""WITH {PLAIN_DOCUMENTS}, t AS (SELECT post_id, substr(text, 1, 30) AS title, text FROM docs),
        u AS (SELECT post_id, {_title_text} AS text FROM t)
        SELECT post_id, {_mention} AS is_referral, {_request} AS is_request, {_mention} AND {_request} AS referral_request FROM u"""
)
def request_flags(spark, d):
    docs = plain_documents(spark, d)
    posts = docs.select(
        "post_id", _cued(F.substring("text", 1, 30)).alias("title"), _cued(F.col("text")).alias("text")
    )
    return flag_requests(posts).select("post_id", "is_referral", "is_request", "referral_request")


@BOOK.add(
    f"""WITH e AS (SELECT {edges_sql('p_size', 5, 'part')} AS edges), f AS (SELECT {edges_sql('p_retailprice', 20, 'part')} AS edges2)
        SELECT p_partkey, {bin_sql('p_size', 'edges')}::INTEGER AS size_class, {bin_sql('p_retailprice', 'edges2')}::INTEGER AS price_class
        FROM part, e, f"""
)
def quantile_classes(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = quantile_class(quantile_class(part, "p_size", 5, "size_class"), "p_retailprice", 20, "price_class")
    return out.select("p_partkey", "size_class", "price_class")


# --- orders as posts, customers' segments as firms ---------------------------

_ORDER_POSTS = """posts AS (SELECT o_orderkey AS post_id, o_orderdate AS date, o_orderstatus <> 'P' AS referral_request,
    CASE WHEN o_custkey % 3 = 0 THEN 'ex-' ELSE '' END || CASE WHEN o_custkey % 500 = 7 THEN c_name ELSE c_mktsegment END AS user_firm,
    (o_totalprice > 250000)::INTEGER AS class_likes, (o_orderpriority < '3')::INTEGER AS class_comments,
    (o_orderstatus = 'F')::INTEGER AS class_offers FROM orders JOIN customer ON o_custkey = c_custkey),
cut AS (SELECT quantile_cont(epoch_us(date)::DOUBLE, 0.8) AS c FROM posts WHERE referral_request),
split AS (SELECT p.*, referral_request AND epoch_us(date) <= c AS train, referral_request AND epoch_us(date) > c AS test FROM posts p, cut)"""

_RATES = """names AS (SELECT user_firm AS raw, replace(user_firm, 'ex-', '') AS recoded, count(*) AS n, sum(class_likes) AS l,
    sum(class_comments) AS c, sum(class_offers) AS o FROM split WHERE train GROUP BY 1, 2),
rates AS (SELECT CASE WHEN n < 10 THEN 'SMALL_FIRM' ELSE recoded END AS firm, sum(n) AS n, sum(l) / sum(n)::DOUBLE AS firm_prop_likes,
    sum(c) / sum(n)::DOUBLE AS firm_prop_comments, sum(o) / sum(n)::DOUBLE AS firm_prop_offers FROM names GROUP BY 1)"""


def order_posts(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    named = orders.join(customer.select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    marker = F.when(F.col("o_custkey") % 3 == 0, "ex-").otherwise("")
    firm = F.when(F.col("o_custkey") % 500 == 7, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    return named.select(
        F.col("o_orderkey").alias("post_id"),
        F.col("o_orderdate").alias("date"),
        (F.col("o_orderstatus") != "P").alias("referral_request"),
        F.concat(marker, firm).alias("user_firm"),
        (F.col("o_totalprice") > 250000).cast("int").alias("class_likes"),
        (F.col("o_orderpriority") < "3").cast("int").alias("class_comments"),
        (F.col("o_orderstatus") == "F").cast("int").alias("class_offers"),
    )


@BOOK.add(f"WITH {_ORDER_POSTS} SELECT post_id, train, test FROM split")
def time_split(spark, d):
    return mark_train_test(order_posts(spark, d)).select("post_id", "train", "test")


@BOOK.add(
    f"""WITH {_ORDER_POSTS}, {_RATES} SELECT firm AS user_firm_recoded, n::BIGINT AS firm_rows, round(firm_prop_likes, 6) AS firm_prop_likes,
        round(firm_prop_comments, 6) AS firm_prop_comments, round(firm_prop_offers, 6) AS firm_prop_offers FROM rates"""
)
def firm_rate_table(spark, d):
    split = mark_train_test(order_posts(spark, d))
    out = firm_rates(split.filter("train"))
    return out.select("user_firm_recoded", "firm_rows", *[r(c).alias(c) for c in out.columns[2:]])


@BOOK.add(
    f"""WITH {_ORDER_POSTS}, {_RATES}, pool AS (SELECT * FROM rates WHERE firm = 'SMALL_FIRM')
        SELECT post_id, round(coalesce(r.firm_prop_likes, p.firm_prop_likes), 6) AS firm_prop_likes,
          round(coalesce(r.firm_prop_comments, p.firm_prop_comments), 6) AS firm_prop_comments,
          round(coalesce(r.firm_prop_offers, p.firm_prop_offers), 6) AS firm_prop_offers
        FROM split s LEFT JOIN rates r ON r.firm = replace(s.user_firm, 'ex-', ''), pool p"""
)
def target_encoded_firms(spark, d):
    out = target_encoding(mark_train_test(order_posts(spark, d)))
    return out.select("post_id", *[r(c).alias(c) for c in ("firm_prop_likes", "firm_prop_comments", "firm_prop_offers")])


_TAGGED = rf"regexp_replace({ASCII.format('text')}, '\b(of|de|la)\b', '#\1', 'g')"


@BOOK.add(
    f"""WITH {COMMENTS}, agg AS (SELECT post_id, sum({CUE_FLAG}::INTEGER)::BIGINT AS n FROM comments GROUP BY post_id),
        base AS (SELECT doc_id AS post_id, {_TAGGED} AS hashtags, {ASCII.format('text')} AS text, source AS user_firm, n_chars,
            TIMESTAMP '2024-01-01' + to_days((n_chars % 300)::INTEGER) AS date, coalesce(n, 0)::BIGINT AS num_offers
          FROM documents LEFT JOIN agg ON doc_id = post_id),
        flagged AS (SELECT *, {sql_match('text', chr(92) + 'bthe' + chr(92) + 'b')} AS is_referral, {sql_match('text', 'a')} AS is_request FROM base),
        posts AS (SELECT *, is_referral AND is_request AS referral_request, (n_chars % 7 > 2)::INTEGER AS class_likes,
            (n_chars % 5 > 1)::INTEGER AS class_comments, (num_offers > 0)::INTEGER AS class_offers FROM flagged),
        cut AS (SELECT quantile_cont(epoch_us(date)::DOUBLE, 0.8) AS c FROM posts WHERE referral_request),
        split AS (SELECT p.*, referral_request AND epoch_us(date) <= c AS train, referral_request AND epoch_us(date) > c AS test FROM posts p, cut),
        {_RATES}, overall AS (SELECT avg(class_likes) AS l, avg(class_comments) AS c, avg(class_offers) AS o FROM split WHERE train),
        pool AS (SELECT max(firm_prop_likes) AS l, max(firm_prop_comments) AS c, max(firm_prop_offers) AS o FROM rates WHERE firm = 'SMALL_FIRM'),
        e AS (SELECT {edges_sql('n_chars', 5, 'documents')} AS edges)
        SELECT s.post_id, s.num_offers, s.class_offers, s.class_comments, s.class_likes, {bin_sql('n_chars', 'edges')}::INTEGER AS class_views,
          is_referral, is_request, referral_request, train, test, dayname(date) AS day_of_week,
          len(regexp_extract_all(hashtags, '#[A-Za-z0-9_]+'))::INTEGER AS num_hashtags,
          round(coalesce(r.firm_prop_likes, pool.l, overall.l), 6) AS firm_prop_likes,
          round(coalesce(r.firm_prop_comments, pool.c, overall.c), 6) AS firm_prop_comments,
          round(coalesce(r.firm_prop_offers, pool.o, overall.o), 6) AS firm_prop_offers
        FROM split s LEFT JOIN rates r ON r.firm = replace(s.user_firm, 'ex-', ''), pool, overall, e"""
)
def basic_table(spark, d):
    """The labelled table from documents and conversations, with cue words as rules."""
    from postloom.functions.columns import contains

    docs = spread(table(spark, d, "documents"))
    text = ascii_text(F.col("text"))
    posts = docs.select(
        F.col("doc_id").alias("post_id"),
        F.regexp_replace(text, r"\b(of|de|la)\b", "#$1").alias("hashtags"),
        F.col("source").alias("user_firm"),
        F.col("n_chars").alias("num_views"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 300).cast("int")).alias("date"),
        F.greatest(F.col("n_chars") % 7 - 2, F.lit(0)).alias("num_likes"),
        F.greatest(F.col("n_chars") % 5 - 1, F.lit(0)).alias("num_comments"),
        contains(text, r"\bthe\b").alias("is_referral"),
        contains(text, "a").alias("is_request"),
    ).withColumn("referral_request", F.col("is_referral") & F.col("is_request"))
    counted = settle(add_offer_counts(posts, flag_offers(comments_table(spark, d), **CUES)))
    out = format_columns(nontext_features(mark_train_test(class_labels(counted))))
    return out.withColumns({c: r(c) for c in ("firm_prop_likes", "firm_prop_comments", "firm_prop_offers")})


@BOOK.add(
    f"""WITH {_ORDER_POSTS} SELECT count(*) FILTER (train) AS n_train, count(*) FILTER (test) AS n_test,
        count(*) FILTER (referral_request) AS n_requests, count(*) FILTER (train) > count(*) FILTER (test) AS train_is_larger FROM split"""
)
def split_checks(spark, d):
    return split_sizes(mark_train_test(order_posts(spark, d)))


@BOOK.add(
    """WITH n AS (SELECT count(*) FILTER (o_totalprice < 100000 OR o_totalprice IS NULL) AS a, count(*) FILTER (o_orderdate > TIMESTAMP '2000-01-01') AS b,
         count(*) FILTER (o_orderstatus = '') AS c FROM orders)
       SELECT 'price_range' AS "check", a AS n_bad FROM n UNION ALL SELECT 'early', b FROM n UNION ALL SELECT 'not_empty', c FROM n"""
)
def table_checks(spark, d):
    return violations(
        table(spark, d, "orders"),
        {
            "price_range": F.col("o_totalprice") >= 100000,
            "early": F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp_ntz"),
            "not_empty": F.col("o_orderstatus") != "",
        },
    )


# Rows of the labelled table that are broken on purpose, by the remainder of their number.
_BROKEN = {"num_views": 11, "class_offers": 13, "train": 17, "referral_request": 19}


def _some(name: str):
    return F.col("post_id") % _BROKEN[name] == 0


_SOME = {name: f"doc_id % {by} = 0" for name, by in _BROKEN.items()}


@BOOK.add(
    f"""WITH d AS (SELECT doc_id, n_chars, coalesce(regexp_matches(text, '(?i)e') AND regexp_matches(text, '(?i)a'), false) AS both_ FROM documents),
       n AS (SELECT count(*) FILTER ({_SOME["num_views"]}) AS views, count(*) FILTER ({_SOME["class_offers"]}) AS offers,
         count(*) FILTER ({_SOME["referral_request"]}) AS request, count(*) FILTER ({_SOME["train"]}) AS split,
         count(*) FILTER ((both_ OR {_SOME["train"]}) <> (both_ <> ({_SOME["referral_request"]}))) AS requests FROM d)
       SELECT unnest(['num_views_range', 'num_likes_range', 'num_comments_range', 'num_offers_range', 'class_views_range', 'class_likes_agrees', 'class_comments_agrees',
         'class_offers_agrees', 'request_is_both', 'one_split', 'requests_are_split']) AS "check", unnest([views, 0, 0, 0, 0, 0, 0, offers, request, split, requests]) AS n_bad FROM n"""
)
def label_invariants(spark, d):
    """The checks of the labelled table on the documents: the rows broken on purpose are found, and no others."""
    from postloom.functions.columns import contains

    posts = table(spark, d, "documents").select(
        F.col("doc_id").alias("post_id"), F.col("n_chars").alias("num_views"),
        (F.col("n_chars") % 7).alias("num_likes"), (F.col("n_chars") % 3).alias("num_comments"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 300).cast("int")).alias("date"),
        contains(F.col("text"), "e").alias("is_referral"), contains(F.col("text"), "a").alias("is_request"),
    ).withColumn("referral_request", F.col("is_referral") & F.col("is_request"))
    counted = add_offer_counts(posts, flag_offers(comments_table(spark, d), **CUES))
    labelled = mark_train_test(class_labels(counted, source=posts))
    broken = labelled.withColumns(
        {
            "num_views": F.when(_some("num_views"), F.lit(-1)).otherwise(F.col("num_views")),
            "class_offers": F.when(_some("class_offers"), 1 - F.col("class_offers")).otherwise(F.col("class_offers")),
            "train": F.col("train") | _some("train"),
            "test": F.col("test") | _some("train"),
            "referral_request": F.col("referral_request") != _some("referral_request"),
        }
    )
    return violations(broken, label_checks())


@BOOK.add(
    """WITH o AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('95:' || doc_id)) AS place,
         count(*) OVER (PARTITION BY quality) AS n FROM labels)
       SELECT doc_id, quality, place <= round_even(0.8 * n, 0) AS fit FROM o"""
)
def stratified_rows(spark, d):
    out = stratified_split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")
    return out.select("doc_id", "quality", "fit")


@BOOK.add(
    """WITH o AS (SELECT o_orderkey, o_custkey, md5('42:' || o_orderkey) AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42:' || o_orderkey)) AS place,
         count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
       SELECT o_orderkey, o_custkey, (place > round_even(0.2 * n, 0))::INTEGER + (place > round_even(0.4 * n, 0))::INTEGER
         + (place > round_even(0.6 * n, 0))::INTEGER + (place > round_even(0.8 * n, 0))::INTEGER AS fold FROM o"""
)
def stratified_fold_rows(spark, d):
    """Five folds of the orders, even within every customer."""
    return stratified_folds(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


@BOOK.add(f"WITH {COMMENTS} SELECT post_id, comment_id, {CUE_FLAG} AS referral_offer FROM comments")
def streamed_offer_flags(spark, d):
    """The offer flags on a stream over the conversations table."""
    schema = table(spark, d, "conversations").schema
    # a pattern, as a stream takes no path of a single file; the table may be a file or a folder of files
    stream = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]")
    comments = stream.select(
        F.col("conv_id").alias("post_id"), F.concat_ws("-", "conv_id", "turn").alias("comment_id"),
        ascii_text(F.col("text")).alias("text"),
    )
    flagged = comments.withColumn("referral_offer", offer_flag(F.col("text"), **CUES)).drop("text")
    out, mark = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-mark")
    write_stream(flagged, out, mark).awaitTermination()
    return spark.read.schema(flagged.schema).parquet(out)
