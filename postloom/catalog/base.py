"""Sources and sinks, columns, joins, aggregates, sorting and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.catalog.common import (
    COMMENTS,
    CUE_FLAG,
    CUES,
    PLAIN_DOCUMENTS,
    SCORES,
    Book,
    comments_table,
    plain_documents,
    r,
    score_rows,
    table,
)
from postloom.functions.columns import cap
from postloom.functions.dates import micros
from postloom.functions.vectors import dot, l2_norm, vector_columns
from postloom.operators import describe
from postloom.operators.evaluate import performance
from postloom.operators.joins import fill_by_key, flag_from_subset, lookup_join, repeated_keys, restrict
from postloom.operators.labels import add_offer_counts, flag_offers, group_share, rename_rare_flags
from postloom.operators.lexicons import lexicon_of, union_lexicons, without_phrases
from postloom.operators.models import best_of_grid, export_probabilities
from postloom.operators.quantiles import exact_quantiles
from postloom.session import scratch_path
from postloom.sources import pages as page_source
from postloom.sources import tables

BOOK = Book()


@BOOK.add("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    customer = table(spark, d, "customer")
    path = scratch_path(spark, "customer-csv")
    tables.write_csv(customer, path)
    return tables.read_csv(spark, path, customer.schema.simpleString()[7:-1].replace(":", " "))


@BOOK.add(
    "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS l_tax FROM lineitem"
)
def table_rewrite(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_extendedprice", "l_discount")
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    out = tables.recompute_column(lines, "l_tax", net, scratch_path(spark, "lineitem"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_tax")


@BOOK.add("SELECT vec_id, len(embedding) AS size, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def embedding_store(spark, d):
    stored = tables.write_embeddings(
        table(spark, d, "embeddings"), scratch_path(spark, "embeddings"), "vec_id", "embedding"
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return stored.select("vec_id", F.size("embedding").cast("long").alias("size"), r(total).alias("total"))


@BOOK.add(
    """SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
       regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading,
       len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links,
       len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages"""
)
def page_outlines(spark, d):
    out = page_source.page_outline(table(spark, d, "pages"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_links", "n_paragraphs")})


@BOOK.add(
    """SELECT page_id, (i - 1)::BIGINT AS position, replace(replace(links[i], 'http://', ''), '/post/', '') AS link
       FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages) t,
       LATERAL (SELECT unnest(range(1, len(links) + 1)) AS i) u"""
)
def page_link_list(spark, d):
    out = page_source.page_links(table(spark, d, "pages"), base_url="http://")
    return out.withColumn("position", F.col("position").cast("long"))


def _article(link, firm=None, user=None, when=None, title=None, text=None, counts=None):
    """One listed post in the markup of a page; parts that are not given are left out."""
    parts = [F.lit('<article><div><a href="https://forum.example/post/'), link, F.lit('">x</a></div>')]
    if firm is not None:
        parts += [F.lit('<div class="h-full items-center text-xs"><a>'), firm, F.lit("</a><span>"), user, F.lit("</span><i>"), when, F.lit("</i></div>")]
    if title is not None:
        parts += [F.lit('<h2 class="big pointer-events-none">'), title, F.lit("</h2>")]
    if text is not None:
        parts += [F.lit('<p class="pointer-events-none">'), text, F.lit("</p>")]
    if counts is not None:
        buttons = [
            F.concat(F.lit(f'<button aria-label="{label}" data-count="'), n.cast("string"), F.lit('">x</button>'))
            for label, n in counts.items()
        ]
        parts += [F.lit("<div>"), *buttons, F.lit("</div>")]
    return F.concat(*parts, F.lit("</article>"))


def _html_pages(spark, d):
    """A listing page per conversation turn: a bare link, the turn, posts that lack one part, and a pinned post about it."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    when = F.when(F.col("role") == "user", "Yesterday").when(F.col("role") == "assistant", "3d").otherwise("Oct 14")
    name = F.concat_ws("-", "conv_id", "turn")
    likes = {"Like this": F.col("turn"), "Views": F.length("text")}
    turn = _article(
        F.concat(F.lit("p"), name), F.col("role"), F.concat(F.lit("user"), F.col("turn")), when,
        F.concat(F.lit("Turn "), F.col("turn")), text, likes,
    )
    untitled = _article(F.concat(F.lit("t"), name), F.lit("f"), F.lit("u"), F.lit("2m"), None, F.lit("only text"), likes)
    no_poster = _article(F.concat(F.lit("n"), name), title=F.lit("Only title"), counts=likes)
    pinned = _article(
        F.concat(F.lit("q"), name), F.lit("ex-mod"), F.lit("mod"), F.lit("5h"), F.lit("Pinned"), F.lit("about <b>it</b> again"),
        {"Like this": F.lit(1), "Comment on this": F.col("turn")},
    )
    bare = _article(F.concat(F.lit("b"), name))
    page = F.concat(F.lit("<html><body><h2 class='pointer-events-none'>Site</h2>"), bare, turn, untitled, no_poster, pinned, F.lit("</body></html>"))
    return table(spark, d, "conversations").select(name.alias("page_id"), page.alias("html"))


@BOOK.add(
    """WITH c AS (SELECT conv_id || '-' || turn AS page_id, turn, role, text, turn::INTEGER AS likes, length(text)::INTEGER AS views FROM conversations)
       SELECT page_id, 'p' || page_id AS post_id, 'user' || turn AS user_name, role AS user_firm,
       CASE role WHEN 'user' THEN '2024-11-16' WHEN 'assistant' THEN '2024-11-14' ELSE '2024-10-14' END AS date,
       '2024-11-17' AS scrape_date, likes AS num_likes, 0 AS num_comments, views AS num_views,
       'Turn ' || turn AS title, text AS post_preview, 0 AS parts_missing FROM c
       UNION ALL SELECT page_id, 'q' || page_id, 'mod', 'ex-mod', '2024-11-17', '2024-11-17', 1, likes, 0, 'Pinned', 'about ', 0 FROM c
       UNION ALL SELECT page_id, 't' || page_id, 'u', 'f', '2024-11-17', '2024-11-17', likes, 0, views, NULL, 'only text', 1 FROM c
       UNION ALL SELECT page_id, 'n' || page_id, NULL, NULL, NULL, '2024-11-17', likes, 0, views, 'Only title', NULL, 2 FROM c
       UNION ALL SELECT page_id, 'b' || page_id, NULL, NULL, NULL, '2024-11-17', 0, 0, 0, NULL, NULL, 4 FROM c"""
)
def page_posts(spark, d):
    posts = page_source.extract_posts(_html_pages(spark, d), "https://forum.example", "2024-11-17")
    return posts.drop("position").withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("date", "scrape_date")})


METRICS_SQL = """counts AS (SELECT model, split, count(*) FILTER (y = 1 AND pred = 1)::DOUBLE AS tp,
    count(*) FILTER (y <> 1 AND pred = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND pred <> 1)::DOUBLE AS fn,
    count(*) FILTER (y <> 1 AND pred <> 1)::DOUBLE AS tn FROM scores GROUP BY model, split),
ranked AS (SELECT model, split, y, rank() OVER (PARTITION BY model, split ORDER BY p)
    + (count(*) OVER (PARTITION BY model, split, p) - 1) / 2.0 AS rk FROM scores),
area AS (SELECT model, split, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))::DOUBLE AS a
    FROM ranked GROUP BY model, split),
metrics AS (SELECT c.model, c.split, round_even((tp + tn) / (tp + fp + fn + tn), 3)::DOUBLE AS accuracy,
    round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 3)::DOUBLE AS precision,
    round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 3)::DOUBLE AS recall,
    round_even((2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / (tp + fp + fn + tn), 3)::DOUBLE AS f1_weighted,
    round_even(a, 3)::DOUBLE AS roc_auc FROM counts c JOIN area USING (model, split))"""


@BOOK.add(f"WITH {SCORES}, {METRICS_SQL} SELECT * FROM metrics")
def metrics_report(spark, d):
    path = scratch_path(spark, "metrics")
    tables.append_metrics(performance(score_rows(spark, d)), path)
    return tables.read_metrics(spark, path).select(
        "model", "split", "accuracy", "precision", "recall", "f1_weighted", "roc_auc"
    )


@BOOK.add(
    f"""WITH {SCORES} SELECT post_id, round(max(p) FILTER (model = 'length'), 6) AS length,
        round(max(p) FILTER (model = 'digest'), 6) AS digest FROM scores WHERE split = 'train' GROUP BY post_id"""
)
def score_export(spark, d):
    wide = export_probabilities(score_rows(spark, d), ["length", "digest", "baseline_train"], "post_id")
    return wide.select("post_id", r("length").alias("length"), r("digest").alias("digest"))


# --- columns and filters ----------------------------------------------------


@BOOK.add(
    """SELECT l_shipdate::DATE::VARCHAR AS date, l_orderkey AS post_id, l_linenumber AS place, l_quantity AS num_views,
       l_returnflag AS user_firm FROM lineitem"""
)
def column_maintenance(spark, d):
    lines = table(spark, d, "lineitem").drop("l_tax", "l_discount", "l_comment")
    named = lines.withColumnsRenamed(
        {"l_orderkey": "post_id", "l_linenumber": "place", "l_quantity": "num_views", "l_returnflag": "user_firm"}
    )
    first = ["post_id", "place"]
    return named.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), *first, "num_views", "user_firm")


@BOOK.add(
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice > 1000
       AND o_orderdate < TIMESTAMP '1999-01-01' AND o_custkey IS NOT NULL AND NOT (o_orderpriority = '5-LOW')"""
)
def filtered_rows(spark, d):
    orders = table(spark, d, "orders")
    return orders.filter(
        F.col("o_orderstatus").isin("O", "F")
        & (F.col("o_totalprice") > 1000)
        & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
        & F.col("o_custkey").isNotNull()
        & ~(F.col("o_orderpriority") == "5-LOW")
    ).select("o_orderkey", "o_orderstatus", "o_totalprice")


@BOOK.add(
    """SELECT d.doc_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 'clean' WHEN toxic = 1 THEN 'toxic'
         ELSE 'unknown' END AS state, coalesce(quality, 0)::BIGINT AS quality, (coalesce(quality, 0) = 1)::INTEGER AS good,
       (coalesce(quality = 1, false) AND NOT coalesce(toxic = 1, false)) OR lang = 'en' AS either
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def conditional_columns(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return rows.select(
        "doc_id",
        F.when(good & ~bad, "clean").when(bad, "toxic").otherwise("unknown").alias("state"),
        F.coalesce("quality", F.lit(0)).cast("long").alias("quality"),
        good.cast("int").alias("good"),
        ((good & ~bad) | (F.col("lang") == "en")).alias("either"),
    )


@BOOK.add("SELECT least(n_chars, 500) AS num_views, count(*) AS n FROM documents GROUP BY 1")
def capped_counts(spark, d):
    views = table(spark, d, "documents").select(cap(F.col("n_chars"), 500).cast("long").alias("num_views"))
    return views.groupBy("num_views").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    """SELECT doc_id AS post_id, CASE WHEN n_chars < 500 THEN coalesce(substr(text, 1, 40), '') ELSE text END AS full_text
       FROM documents"""
)
def preview_fill(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "post_id")
    full = docs.select("post_id", F.when(F.col("n_chars") >= 500, F.col("text")).alias("full_text"))
    previews = docs.select("post_id", F.substring("text", 1, 40).alias("post_preview"))
    return fill_by_key(full, previews, "post_id", "full_text", "post_preview")


RARE = {"the": r"\bthe\b", "der": r"\bder\b", "los": r"\blos\b", "digits": r"\d{3}", "license": "licen[cs]e"}
_rare_sql = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, regexp_matches(text, '(?i){p}') AS f FROM docs" for n, p in RARE.items()
)


@BOOK.add(
    f"""WITH {PLAIN_DOCUMENTS}, long AS ({_rare_sql})
        SELECT CASE WHEN avg(f::INTEGER) < 0.05 THEN 'below5_' ELSE '' END || feature AS feature, count(*) FILTER (f) AS n_true
        FROM long GROUP BY long.feature"""
)
def rare_flag_names(spark, d):
    docs = plain_documents(spark, d)
    flags = docs.select("post_id", *[F.col("text").rlike("(?i)" + p).alias(n) for n, p in RARE.items()])
    renamed = rename_rare_flags(flags, list(RARE))
    names = [c for c in renamed.columns if c != "post_id"]
    return renamed.agg(*[F.count_if(c).alias(c) for c in names]).unpivot([], names, "feature", "n_true")


# --- joins ------------------------------------------------------------------


@BOOK.add(
    f"""WITH {COMMENTS}, agg AS (SELECT post_id, sum({CUE_FLAG}::INTEGER)::BIGINT AS n FROM comments GROUP BY post_id)
        SELECT doc_id AS post_id, coalesce(n, 0)::BIGINT AS num_offers FROM documents LEFT JOIN agg ON doc_id = post_id"""
)
def offers_per_document(spark, d):
    posts = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"))
    return add_offer_counts(posts, flag_offers(comments_table(spark, d), **CUES))


@BOOK.add(
    f"""WITH {COMMENTS}, c AS (SELECT * FROM comments)
        SELECT v.conv_id, v.turn, v.role, {CUE_FLAG.replace('text', 'c.text')} AS referral_offer FROM conversations v
        JOIN c ON c.post_id = v.conv_id AND c.comment_id = v.conv_id || '-' || v.turn"""
)
def composite_key_join(spark, d):
    turns = table(spark, d, "conversations").withColumn("comment_id", F.concat_ws("-", "conv_id", "turn"))
    turns = turns.withColumnRenamed("conv_id", "post_id").drop("text")
    flags = flag_offers(comments_table(spark, d), **CUES).select("post_id", "comment_id", "referral_offer")
    joined = turns.join(flags, ["post_id", "comment_id"], "inner")
    return joined.select(F.col("post_id").alias("conv_id"), "turn", "role", "referral_offer")


@BOOK.add(
    """SELECT d.doc_id, coalesce(l.toxic = 1, false) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def subset_flag_join(spark, d):
    labels = table(spark, d, "labels")
    return flag_from_subset(table(spark, d, "documents").select("doc_id"), labels, "doc_id", "toxic")


@BOOK.add(
    """SELECT 'documents' AS name, count(*) AS repeated FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'lines', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
       UNION ALL SELECT 'turns', count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1)"""
)
def key_checks(spark, d):
    parts = [
        ("documents", repeated_keys(table(spark, d, "documents"), "doc_id")),
        ("lines", repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])),
        ("turns", repeated_keys(table(spark, d, "conversations"), "conv_id")),
    ]
    sums = [p.agg(F.count(F.lit(1)).alias("repeated")).select(F.lit(n).alias("name"), "repeated") for n, p in parts]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


@BOOK.add(
    """SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm
       FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)"""
)
def restricted_vectors(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"))
    kept = restrict(table(spark, d, "embeddings"), ids, "vec_id")
    return kept.select("vec_id", "label", r(l2_norm(F.col("embedding"))).alias("norm"))


@BOOK.add(
    """SELECT e.vec_id, d.lang, d.n_chars, round(e.embedding[1]::DOUBLE, 6) AS enc1 FROM embeddings e
       LEFT JOIN documents d ON d.doc_id = e.vec_id"""
)
def vectors_with_features(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "n_chars")
    joined = table(spark, d, "embeddings").join(docs, "vec_id", "left")
    return joined.select("vec_id", "lang", "n_chars", r(F.col("embedding")[0].cast("double")).alias("enc1"))


@BOOK.add(
    """SELECT c_mktsegment, r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       GROUP BY 1, 2"""
)
def chained_joins(spark, d):
    # the orders are reduced to customers before any lookup, so no hot segment is shuffled
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s")
    )
    joined = (
        spent.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("c_mktsegment", "r_name").agg(
        F.sum("n").alias("n_orders"), F.round(F.sum("s").cast("double"), 2).alias("total")
    )


# --- aggregates -------------------------------------------------------------


@BOOK.add(
    """SELECT l_returnflag, l_linestatus, sum((l_discount > 0.05)::INTEGER)::BIGINT AS n_discounted, round(avg(l_quantity), 6) AS mean_quantity,
       count(l_orderkey) AS n, round(avg(l_tax), 6) AS mean_tax, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1, 2"""
)
def group_aggregates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum((F.col("l_discount") > 0.05).cast("long")).alias("n_discounted"),
        r(F.avg("l_quantity")).alias("mean_quantity"),
        F.count("l_orderkey").alias("n"),
        r(F.avg("l_tax")).alias("mean_tax"),
        F.countDistinct("l_suppkey").alias("n_suppliers"),
    )


@BOOK.add("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM events GROUP BY 1")
def value_shares(spark, d):
    out = describe.value_shares(table(spark, d, "events"), "event_type")
    return out.withColumn("percent", r("percent"))


@BOOK.add(
    """SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""
)
def most_common_category(spark, d):
    return describe.most_common(table(spark, d, "part"), "p_type")


@BOOK.add("SELECT DISTINCT replace(lower(source), 'ex-', '') AS name FROM documents WHERE source IS NOT NULL")
def distinct_names(spark, d):
    docs = table(spark, d, "documents").filter(F.col("source").isNotNull())
    return docs.select(F.replace(F.lower("source"), F.lit("ex-"), F.lit("")).alias("name")).distinct()


@BOOK.add(
    """SELECT round(quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.8), 0) AS cut, count(*) AS n FROM orders
       WHERE o_orderstatus = 'O'"""
)
def date_percentile(spark, d):
    orders = table(spark, d, "orders").filter(F.col("o_orderstatus") == "O")
    cut = exact_quantiles(orders, micros(F.col("o_orderdate")), [0.8])
    return orders.agg(F.round(F.lit(cut[0]).cast("double"), 0).alias("cut"), F.count(F.lit(1)).alias("n"))


@BOOK.add(
    """SELECT round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem"""
)
def interval_bounds(spark, d):
    low, high = exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.025, 0.975], distinct_limit=1_000)
    return spark.range(1).select(F.round(F.lit(low), 6).alias("low"), F.round(F.lit(high), 6).alias("high"))


_five = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6)::DOUBLE AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c}), 6)::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
        round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c}), 6)::DOUBLE AS max FROM {t}"""
    for c, t in (("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"))
)


@BOOK.add(_five)
def five_number_summary(spark, d):
    out = describe.five_numbers(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("feature", "count", *[r(c).alias(c) for c in out.columns[2:]])


@BOOK.add(
    """SELECT min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) FILTER (value IS NULL) AS n_null,
       count(*) FILTER (event_type = 'error') AS n_error, round(avg((event_type = 'purchase')::INTEGER), 6) AS base_rate FROM events"""
)
def global_aggregates(spark, d):
    return table(spark, d, "events").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), r(F.avg("value")).alias("mean"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.count_if(F.col("event_type") == "error").alias("n_error"),
        r(F.avg((F.col("event_type") == "purchase").cast("int"))).alias("base_rate"),
    )


@BOOK.add(
    """WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w, count(*) AS n FROM orders),
       x AS (SELECT least(floor((o_totalprice - lo) / w) + 1, 20)::INTEGER AS bin, lo, w, n FROM orders, b)
       SELECT bin, round(lo + w * (bin - 1), 4) AS left_edge, count(*) AS n, round(count(*) * 100.0 / max(x.n), 6)::DOUBLE AS percent
       FROM x GROUP BY bin, lo, w"""
)
def equal_width_histogram(spark, d):
    out = describe.histogram(table(spark, d, "orders"), "o_totalprice")
    return out.select("bin", r("left_edge", 4).alias("left_edge"), "n", r("percent").alias("percent"))


@BOOK.add(
    """WITH f AS (SELECT p_size::DOUBLE AS c, p_brand AS fold, avg(p_retailprice) AS s FROM part GROUP BY 1, 2),
       m AS (SELECT c, avg(s) AS mean_score FROM f GROUP BY 1)
       SELECT c, round(mean_score, 6) AS mean_score FROM m ORDER BY m.mean_score DESC, c LIMIT 1"""
)
def grid_choice(spark, d):
    folds = table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("c"), "p_brand").agg(
        F.avg("p_retailprice").alias("s")
    )
    return best_of_grid(folds, "c", "s").withColumn("mean_score", r("mean_score"))


@BOOK.add(
    """SELECT doc_id, source, round(count(*) OVER (PARTITION BY source) * 1.0 / count(*) OVER (), 6)::DOUBLE AS pct_activity FROM documents"""
)
def group_shares(spark, d):
    shares = group_share(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")
    return shares.select("doc_id", "source", r("pct_activity").alias("pct_activity"))


@BOOK.add(
    """SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, s.s_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey"""
)
def salted_lookup(spark, d):
    """The lookup join on its way for large lookup sides."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    out = lookup_join(
        lines, table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "inner",
        ["l_orderkey", "l_linenumber"], tasks=8, max_rows=1,
    )
    return out.select("l_orderkey", "l_linenumber", F.col("s_suppkey").alias("l_suppkey"), "s_name")


# --- sorting and sets -------------------------------------------------------


@BOOK.add(
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 500"""
)
def top_rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return orders.orderBy(F.desc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(500)


@BOOK.add(
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey))::INTEGER AS place FROM orders
       QUALIFY row_number() OVER (ORDER BY md5('7:' || o_orderkey)) <= 20"""
)
def random_sample(spark, d):
    from pyspark.sql import Window as W

    from postloom.operators.labels import hash_order

    # the top-k runs per task; only 20 rows are numbered
    picked = table(spark, d, "orders").select("o_orderkey", hash_order(F.col("o_orderkey"), 7).alias("h")).orderBy("h").limit(20)
    return picked.select("o_orderkey", F.row_number().over(W.orderBy("h")).alias("place"))


BENCH_WORDS = """words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS phrase FROM benchmark),
docwords AS (SELECT DISTINCT unnest(regexp_extract_all(lower(left_words), '[a-z]+')) AS phrase FROM
  (SELECT text AS left_words FROM conversations))"""


def _word_table(df, text="text"):
    listed = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return df.select(F.explode(F.array_distinct(listed)).alias("phrase")).distinct()


def _benchmark_lexicon(spark, d):
    return lexicon_of(_word_table(table(spark, d, "benchmark")), "phrase", "[ORG]")


def _turn_lexicon(spark, d):
    return lexicon_of(_word_table(table(spark, d, "conversations")), "phrase", "[ORG]")


@BOOK.add(f"WITH {BENCH_WORDS} SELECT phrase FROM words UNION SELECT phrase FROM docwords")
def lexicon_union(spark, d):
    return union_lexicons(_benchmark_lexicon(spark, d), _turn_lexicon(spark, d)).select("phrase")


@BOOK.add(f"WITH {BENCH_WORDS} SELECT phrase FROM words EXCEPT SELECT phrase FROM docwords")
def lexicon_difference(spark, d):
    return without_phrases(_benchmark_lexicon(spark, d), _turn_lexicon(spark, d)).select("phrase")


@BOOK.add(
    """WITH p AS (SELECT DISTINCT lower(s_name || ' ' || n_name) AS phrase FROM supplier JOIN nation ON s_nationkey = n_nationkey)
       SELECT phrase, (-(len(string_split_regex(trim(phrase), '\\s+')) * 100000 + length(phrase)))::BIGINT AS priority FROM p"""
)
def lexicon_priority(spark, d):
    named = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    phrases = named.select(F.concat_ws(" ", "s_name", "n_name").alias("p"))
    return lexicon_of(phrases, "p", "[GPE]").select("phrase", F.col("priority").cast("long").alias("priority"))


@BOOK.add(
    f"""SELECT vec_id, {", ".join(f"round(embedding[{i}]::DOUBLE, 6) AS enc{i}" for i in range(1, 65))},
       round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self_product FROM embeddings"""
)
def vector_entries(spark, d):
    rows = table(spark, d, "embeddings")
    out = rows.select("vec_id", *vector_columns(F.col("embedding"), 64), dot(F.col("embedding"), F.col("embedding")).alias("self_product"))
    return out.select("vec_id", *[r(F.col(c).cast("double")).alias(c) for c in out.columns[1:]])
