"""Feature preparation, TF-IDF, encoders, classifiers and coefficients."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postloom.catalog.common import PLAIN_DOCUMENTS, Book, plain_documents, r, sql_text, table
from postloom.functions import fixed_values as fixed
from postloom.functions.columns import log_grid
from postloom.functions.vectors import l2_norm
from postloom.operators.coefficients import first_and_last, named_coefficients, wald_table
from postloom.operators.evaluate import auroc, performance
from postloom.operators.features import assemble, balanced_weights, encode_text, one_hot, one_hot_vectors, prepare_features, standard_scale, vector_parts
from postloom.operators.joins import repeated_keys
from postloom.operators.models import (
    Registry,
    fit_boosted,
    fit_l1_logit,
    fit_plain_logit,
    random_baseline,
    score,
    score_table,
    train_grid,
)
from postloom.operators.penalty import TOLERANCE, fit_wide, held_out_scores, prepared, search
from postloom.operators.similarity import most_similar
from postloom.operators.tfidf import fit_vocabulary, term_counts, text_table, text_vectors
from postloom.session import scratch_path, settle, spread

BOOK = Book()


# --- scaling, encoding, weights -----------------------------------------------


@BOOK.add(
    """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, avg(o_custkey) AS m2, stddev_pop(o_custkey) AS s2
         FROM orders WHERE o_orderstatus = 'F')
       SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice, round((o_custkey - m2) / s2, 6) AS o_custkey FROM orders, s"""
)
def scaled_columns(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", (F.col("o_orderstatus") == "F").alias("train"))
    out = standard_scale(rows, ["o_totalprice", "o_custkey"])
    return out.select("o_orderkey", r("o_totalprice").alias("o_totalprice"), r("o_custkey").alias("o_custkey"))


@BOOK.add(
    """WITH c AS (SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') AS n_train, count(*) AS n FROM orders GROUP BY 1),
       m AS (SELECT p FROM c ORDER BY n_train DESC, p LIMIT 1)
       SELECT 'o_orderpriority_' || p AS name, n AS n_rows FROM c WHERE n_train > 0 AND p NOT IN (SELECT p FROM m)"""
)
def one_hot_columns(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("train"))
    out = one_hot(rows, "o_orderpriority")
    names = [c for c in out.columns if c.startswith("o_orderpriority_")]
    sums = out.agg(*[F.sum(F.col(f"`{c}`").cast("long")).alias(c) for c in names])
    return sums.unpivot([], [F.col(f"`{c}`") for c in names], "name", "n_rows")


@BOOK.add(
    """WITH c AS (SELECT o_custkey::VARCHAR AS term, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
       top AS (SELECT term FROM c ORDER BY n DESC, term LIMIT 1), kept AS (SELECT term FROM c WHERE term NOT IN (SELECT term FROM top)),
       i AS (SELECT term, (row_number() OVER (ORDER BY md5(term), term) - 1)::INTEGER AS idx FROM kept)
       SELECT o_orderkey, (SELECT count(*) FROM kept)::INTEGER AS size, CASE WHEN idx IS NULL THEN [] ELSE [idx] END AS indices,
         CASE WHEN idx IS NULL THEN [] ELSE [1.0::DOUBLE] END AS weights FROM orders LEFT JOIN i ON i.term = o_custkey::VARCHAR"""
)
def one_hot_sparse(spark, d):
    """A category of thousands of values as one sparse vector."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("train"))
    parts = vector_parts(one_hot_vectors(rows, "o_custkey", "o_orderkey"))
    return parts.select("o_orderkey", "features.size", "features.indices", F.col("features.values").alias("weights"))


@BOOK.add(
    """WITH n AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT quality) AS k FROM labels), c AS (SELECT quality, count(*) AS nc FROM labels GROUP BY 1)
       SELECT doc_id, labels.quality, round(n / (k * nc), 6) AS w FROM labels JOIN c USING (quality), n"""
)
def class_weights(spark, d):
    out = balanced_weights(table(spark, d, "labels").select("doc_id", "quality"), "quality")
    return out.select("doc_id", "quality", r("w").alias("w"))


def _labelled(spark, d):
    """Labelled documents with a split by language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    both = docs.join(table(spark, d, "labels"), "doc_id")
    return both.select(
        F.col("doc_id").alias("post_id"), (F.col("lang") == "en").alias("train"), (F.col("lang") != "en").alias("test"),
        F.col("quality").alias("class_offers"),
    )


@BOOK.add(
    """WITH b AS (SELECT d.doc_id AS post_id, lang = 'en' AS train, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
       f AS (SELECT doc_id AS post_id, n_chars::DOUBLE AS n_chars, length(text)::DOUBLE AS size, toxic FROM documents LEFT JOIN labels USING (doc_id)),
       j AS (SELECT b.post_id, train, quality, n_chars, size, toxic FROM b LEFT JOIN f USING (post_id)),
       s AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(size) AS m2, stddev_pop(size) AS s2 FROM j WHERE train)
       SELECT post_id, train, quality AS class_offers, round((n_chars - m1) / s1, 6) AS n_chars, round((size - m2) / s2, 6) AS size, toxic FROM j, s"""
)
def prepared_features(spark, d):
    feats = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("post_id"), F.col("n_chars").cast("double").alias("n_chars"),
        F.length("text").cast("double").alias("size"), "toxic",
    )
    out, _ = prepare_features(_labelled(spark, d), feats, nums=["n_chars", "size"])
    return out.select("post_id", "train", "class_offers", r("n_chars").alias("n_chars"), r("size").alias("size"), "toxic")


@BOOK.add(
    """WITH j AS (SELECT vec_id, embedding::DOUBLE[] AS v, n_chars, lang, label FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
       s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM j WHERE label < 7)
       SELECT vec_id, list_append(list_transform(v, lambda x: round(x, 5)), coalesce(round((n_chars - m) / s, 5), 0)) AS features FROM j, s"""
)
def mixed_vectors(spark, d):
    """Vectors together with a scaled feature, as one ML vector."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("n_chars").cast("double").alias("n_chars"))
    rows = table(spark, d, "embeddings").withColumn("train", F.col("label") < 7)
    both = standard_scale(rows.join(docs, "vec_id", "left"), ["n_chars"])
    out = assemble(both, ["embedding", "n_chars"]).select("vec_id", vector_to_array("features").alias("x"))
    return out.select("vec_id", F.transform("x", lambda v: F.round(v, 5)).alias("features"))


@BOOK.add(
    """SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents"""
)
def encoded_texts(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return encode_text(docs, "doc_id", "text").select("doc_id", F.round(l2_norm(F.col("embedding")), 4).alias("norm"))


@BOOK.add(
    """WITH n AS (SELECT doc_id, length(text)::DOUBLE AS a, len(string_split(text, ' '))::DOUBLE AS b FROM documents)
       SELECT doc_id, round(CASE WHEN a * a + b * b > 0 THEN a / sqrt(a * a + b * b) ELSE 0 END, 5) AS first,
         round(CASE WHEN a * a + b * b > 0 THEN b / sqrt(a * a + b * b) ELSE 0 END, 5) AS second FROM n"""
)
def batch_encoded_texts(spark, d):
    """A user-supplied encoder on Arrow batches."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    out = encode_text(docs, "doc_id", "text", encoder=lambda texts: [[len(t), len(t.split(" "))] for t in texts])
    at = lambda i: F.round(F.col("embedding")[i].cast("double"), 5)
    return out.select("doc_id", at(0).alias("first"), at(1).alias("second"))


# --- TF-IDF -------------------------------------------------------------------

_STOPS = ["the", "of", "and", "in", "to", "de", "la", "der", "les", "que"]
_STOP_SQL = "[" + ", ".join(sql_text(s) for s in _STOPS) + "]"

_TERMS = rf"""toks AS (SELECT post_id, list_filter(regexp_extract_all(text, '\b\w\w+\b|\[[A-Z]+\]'), lambda t: NOT list_contains({_STOP_SQL}, t)) AS t FROM docs),
 grams AS (SELECT post_id, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM toks),
 tf AS (SELECT post_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
 fit AS (SELECT doc_id AS post_id FROM documents WHERE lang = 'en'),
 vocab AS (SELECT term, count(*) AS df FROM tf WHERE post_id IN (SELECT post_id FROM fit) GROUP BY 1
   HAVING count(*) >= 5 AND count(*) <= 0.95 * (SELECT count(*) FROM fit))"""


def _fitted(spark, d, indexed=False):
    """The vocabulary of the English documents."""
    ids = table(spark, d, "documents").filter(F.col("lang") == "en").select(F.col("doc_id").alias("post_id"))
    # texts are left out before their terms are taken
    if repeated_keys(table(spark, d, "documents"), "doc_id").isEmpty():
        docs = plain_documents(spark, d, F.col("lang") == "en").filter("post_id is not null")
    else:
        docs = plain_documents(spark, d).join(ids, "post_id", "left_semi")
    return fit_vocabulary(term_counts(docs, "post_id", "text", _STOPS), ids.count(), indexed=indexed)


@BOOK.add(
    f"""WITH {PLAIN_DOCUMENTS}, {_TERMS}, raw AS (SELECT post_id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM fit)) / (1 + df)) + 1) AS r FROM tf JOIN vocab USING (term))
        SELECT post_id, term, round(r / sqrt(sum(r * r) OVER (PARTITION BY post_id)), 6) AS weight FROM raw"""
)
def tfidf_table(spark, d):
    out = text_table(plain_documents(spark, d), _fitted(spark, d), "post_id", "text", _STOPS)
    return out.select("post_id", "term", r("weight").alias("weight"))


@BOOK.add(f"WITH {PLAIN_DOCUMENTS}, {_TERMS} SELECT term, df, (SELECT count(*) FROM vocab) AS vocabulary FROM vocab ORDER BY df DESC, term LIMIT 20")
def frequent_terms(spark, d):
    vocabulary = _fitted(spark, d)
    return vocabulary.most_frequent(20).select("term", "df", F.lit(vocabulary.size()).cast("long").alias("vocabulary"))


@BOOK.add(
    f"""WITH {PLAIN_DOCUMENTS}, {_TERMS}, raw AS (SELECT post_id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM fit)) / (1 + df)) + 1) AS r FROM tf JOIN vocab USING (term)),
         n AS (SELECT term, row_number() OVER (ORDER BY md5(term), term) - 1 AS idx FROM vocab),
         w AS (SELECT post_id, idx, r / sqrt(sum(r * r) OVER (PARTITION BY post_id)) AS v FROM raw JOIN n USING (term)),
         e AS (SELECT post_id, list(idx::INTEGER ORDER BY idx) AS indices, list(round(v, 6) ORDER BY idx) AS weights FROM w GROUP BY 1)
        SELECT post_id, coalesce(array_to_string(indices, ','), '') AS indices, coalesce(weights, []) AS weights,
          (SELECT count(*) FROM vocab)::INTEGER AS size FROM docs LEFT JOIN e USING (post_id)"""
)
def tfidf_sparse_vectors(spark, d):
    """Sparse ML vectors: places and weights of the entries of every text, and the dimension."""
    vocabulary = _fitted(spark, d, indexed=True)
    vectors = text_vectors(plain_documents(spark, d), vocabulary, "post_id", "text", _STOPS)
    # stored once: the parts are read from the vectors
    return vectors.select("post_id", F.unwrap_udt("features").alias("features")).select(
        "post_id", F.array_join(F.col("features.indices").cast("array<string>"), ",").alias("indices"),
        F.transform("features.values", lambda v: F.round(v, 6)).alias("weights"), "features.size",
    )


# --- classifiers --------------------------------------------------------------


def _vectors(spark, d):
    """Labelled vectors: the label is the lower half of the groups, the split a digest of the id."""
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("post_id"), "embedding", (F.col("label") < 5).cast("int").alias("class_offers"),
        (F.md5(F.col("vec_id").cast("string")) < "cc").alias("train"),
    ).withColumn("test", ~F.col("train"))
    return assemble(rows, ["embedding"]).drop("embedding")


def _scored(model, rows):
    split = F.when(F.col("train"), "train").otherwise("test")
    out = score(model, rows.withColumn("split", split), ["post_id", "split", F.col("class_offers").alias("y")])
    return out.withColumn("p", r("p", 4))


_TRAIN_SIZES = "n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (yes) AS n1, count(*) FILTER (NOT yes) AS n0 FROM v WHERE train)"
_PLACES = " + ".join(f"(place > round_even({i / 5} * m, 0))::INTEGER" for i in range(1, 5))


def _vector_sql(embedding: str = "embedding") -> str:
    """Vectors with an entry of one, balanced weights and stratified folds, as relation ``v`` and, for train rows, ``t``."""
    return f"""v AS (SELECT vec_id AS id, label < 5 AS yes, list_append({embedding}::DOUBLE[], 1.0) AS x, md5(vec_id::VARCHAR) < 'cc' AS train FROM embeddings),
 {_TRAIN_SIZES},
 p AS (SELECT id, yes, x, row_number() OVER (PARTITION BY yes ORDER BY md5('42:' || id)) AS place, count(*) OVER (PARTITION BY yes) AS m FROM v WHERE train),
 t AS MATERIALIZED (SELECT id, yes::INTEGER::DOUBLE AS y, x, n.n / (2 * CASE WHEN yes THEN n1 ELSE n0 END) AS w, {_PLACES} AS fold, len(x) - 1 AS d FROM p, n)"""


def _descent_sql(models: str, steps: int, momentum: float) -> str:
    """Models ``(c, fold)`` fitted by accelerated proximal descent in a recursion, as relation ``fit(c, fold, b)``; a null c has no penalty.

    Half of the curvature's bound goes to the intercept and half to the features, whose bound is the Frobenius norm.
    """
    return f"""models AS ({models}),
 e AS (SELECT id, w, unnest(list_slice(x, 1, d)) AS v, unnest(range(d)) AS j FROM t),
 gram AS (SELECT sum(a.w * a.v * b.v) AS s FROM e a JOIN e b USING (id) GROUP BY a.j, b.j),
 bound AS (SELECT sqrt(sum(s * s)) / 2 AS l, (SELECT sum(w) FROM t) / 2 AS l0, (SELECT any_value(d) FROM t) AS d FROM gram),
 it AS (SELECT 0 AS k, c, fold, list_transform(range(d + 1), lambda i: 0.0::DOUBLE) AS now, list_transform(range(d + 1), lambda i: 0.0::DOUBLE) AS ahead FROM models, bound
  UNION ALL
  SELECT k + 1, c, fold, new, list_transform(list_zip(new, now), lambda z: z[1] + {momentum} * (z[1] - z[2]))
  FROM (SELECT k, c, fold, now, list_transform(list_zip(ahead, g, range(d + 1)), lambda z: CASE WHEN z[3] = d THEN z[1] - z[2] / l0
      ELSE sign(z[1] - z[2] / l) * greatest(abs(z[1] - z[2] / l) - coalesce(1 / (c * l), 0), 0) END) AS new
    FROM (SELECT k, c, fold, any_value(now) AS now, any_value(ahead) AS ahead, list(s ORDER BY j) AS g
      FROM (SELECT k, c, fold, any_value(now) AS now, any_value(ahead) AS ahead, j, sum(e * xj) AS s
        FROM (SELECT it.k, it.c, it.fold, it.now, it.ahead, w * (1 / (1 + exp(-list_dot_product(x, ahead))) - y) AS e, unnest(x) AS xj, unnest(range(d + 1)) AS j
          FROM it JOIN t ON t.fold <> it.fold WHERE k < {steps})
        GROUP BY k, c, fold, j) GROUP BY k, c, fold), bound)),
 fit AS MATERIALIZED (SELECT c, fold, now AS b FROM it WHERE k = {steps})"""


def _scores_sql(models: str, steps: int, momentum: float, embedding: str = "embedding") -> str:
    return f"""WITH RECURSIVE {_vector_sql(embedding)}, {_descent_sql(models, steps, momentum)},
 s AS (SELECT id, train, yes, list_dot_product(x, b) AS z FROM v, fit)
SELECT id AS post_id, CASE WHEN train THEN 'train' ELSE 'test' END AS split, yes::INTEGER AS y, round(1 / (1 + exp(-z)), 4) AS p, (z > 0)::INTEGER AS pred FROM s"""


@BOOK.add(_scores_sql("SELECT NULL::DOUBLE AS c, -1 AS fold", 1500, 0.93))
def plain_logit_scores(spark, d):
    rows = _vectors(spark, d)
    return _scored(fit_plain_logit(rows.filter("train").cache(), "class_offers"), rows)


@BOOK.add(_scores_sql("SELECT 1.0::DOUBLE AS c, -1 AS fold", 400, 0.85))
def l1_logit_scores(spark, d):
    rows = _vectors(spark, d)
    return _scored(fit_l1_logit(rows.filter("train").cache(), "class_offers", c=1.0), rows)


@BOOK.add(
    f"""WITH {_vector_sql()}, f AS (SELECT unnest(range(5))::INTEGER AS fold),
 share AS (SELECT f.fold, sum(w * y) / sum(w) AS p0 FROM f JOIN t ON t.fold <> f.fold GROUP BY 1),
 e AS (SELECT fold, unnest(list_slice(x, 1, d)) AS x, unnest(range(d)) AS j, w, y FROM t),
 g AS (SELECT share.fold, j, abs(sum(w * (p0 - y) * x)) AS g FROM share JOIN e ON e.fold <> share.fold GROUP BY ALL),
 most AS (SELECT fold, max(g) AS g FROM g GROUP BY 1),
 held AS (SELECT fold, count(*) AS held_out, count(*) FILTER (y = 1) AS positive FROM t GROUP BY 1),
 grid AS (SELECT {fixed.C_GRID[0]} * pow({fixed.C_GRID[1]} / {fixed.C_GRID[0]}, i / {fixed.C_GRID[2] - 1}.0::DOUBLE) AS c FROM range({fixed.C_GRID[2]}) r(i))
SELECT round(c, 8) AS c, fold, held_out, positive, 1 / c >= g AS empty, CASE WHEN 1 / c >= g THEN 0.5::DOUBLE END AS chance, true AS settled, true AS at_most_chosen
FROM grid, held JOIN most USING (fold)"""
)
def penalty_search(spark, d):
    """The whole path of penalties in five stratified folds.

    Models that keep no feature, their score, the optimality bound, and that no mean score is above the chosen one.
    """
    rows = _vectors(spark, d).filter("train").cache()
    best, facts, _, found = search(rows, "class_offers", "post_id", log_grid(*fixed.C_GRID))
    sizes = found.rows.groupBy("fold").agg(F.count(F.lit(1)).alias("held_out"), F.count_if(F.col("y") == 1).alias("positive"))
    means = facts.groupBy("c").agg(F.avg("auroc").alias("mean"))
    top = means.filter(F.col("c") == F.lit(best)).select(F.col("mean").alias("top"))
    out = facts.join(sizes, "fold").join(means, "c").crossJoin(F.broadcast(top))
    empty = F.col("n_features") == 0
    return out.select(
        F.round("c", 8).alias("c"), "fold", "held_out", "positive", empty.alias("empty"), F.when(empty, F.col("auroc")).alias("chance"),
        (F.col("violation") <= TOLERANCE).alias("settled"), (F.col("mean") <= F.col("top")).alias("at_most_chosen"),
    )


@BOOK.add(
    f"""WITH RECURSIVE {_vector_sql()}, {_descent_sql("SELECT c, fold::INTEGER AS fold FROM (SELECT unnest([0.4, 0.8]::DOUBLE[]) AS c), range(5) AS f(fold)", 240, 0.8)},
 s AS (SELECT c, fit.fold, y, round(list_dot_product(x, b), 9) AS z FROM fit JOIN t ON t.fold = fit.fold),
 a AS (SELECT p.c, p.fold, avg((p.z > q.z)::INTEGER + (p.z = q.z)::INTEGER / 2) AS auroc FROM s p JOIN s q ON p.c = q.c AND p.fold = q.fold AND p.y = 1 AND q.y = 0 GROUP BY 1, 2),
 l AS (SELECT c, fold, sum(w * (ln(1 + exp(list_dot_product(x, b))) - y * list_dot_product(x, b))) AS loss FROM (SELECT fit.c, fit.fold, b, w, x, y FROM fit JOIN t ON t.fold <> fit.fold) GROUP BY 1, 2)
SELECT c, fold, len(list_filter(list_slice(b, 1, -2), lambda v: v <> 0))::INTEGER AS n_features, round(auroc, 6) AS auroc,
  round(list_sum(list_transform(list_slice(b, 1, -2), lambda v: abs(v))) + c * loss, 4) AS objective, c = max_by(c, mean) OVER () AS chosen
FROM fit JOIN a USING (c, fold) JOIN l USING (c, fold) JOIN (SELECT c, avg(auroc) AS mean FROM a GROUP BY 1) USING (c)"""
)
def penalty_scores(spark, d):
    """Two penalties in five folds: features kept, score on the fold held out, and the value that was minimised."""
    rows = _vectors(spark, d).filter("train").cache()
    grid = [0.4, 0.8]
    best, facts, path, found = search(rows, "class_offers", "post_id", grid, tolerance=1e-9)
    coefs = settle(path.coefficients(spark), "coefficients")
    others = found.rows.select(F.col("fold").alias("own"), "key", "y", "w", F.posexplode(F.concat("values", F.array(F.lit(1.0)))).alias("place", "x"))
    wide = F.lit(found.width)
    entries = others.withColumn("idx", F.when(F.col("place") < wide, F.col("place")).otherwise(-1))
    met = entries.join(F.broadcast(coefs), "idx").filter(F.col("own") != F.col("fold"))
    z = met.groupBy("c", "fold", "key", "y", "w").agg(F.sum(F.col("x") * F.col("coef")).alias("z"))
    loss = z.groupBy("c", "fold").agg(F.sum(F.col("w") * (F.log1p(F.exp("z")) - F.col("y") * F.col("z"))).alias("loss"))
    norm = coefs.groupBy("c", "fold").agg(F.sum(F.when(F.col("idx") >= 0, F.abs("coef")).otherwise(0.0)).alias("norm"))
    # exact scores of both values; the search takes exactly only those that can be the largest
    exact = auroc(held_out_scores(found, coefs, 5), ["c", "fold"], "y", "z").withColumnRenamed("roc_auc", "auroc")
    out = facts.drop("auroc").join(exact, ["c", "fold"]).join(loss, ["c", "fold"]).join(norm, ["c", "fold"])
    objective = F.col("norm") + F.col("c") * F.col("loss")
    return out.select("c", "fold", "n_features", r("auroc").alias("auroc"), r(objective, 4).alias("objective"), (F.col("c") == F.lit(best)).alias("chosen"))


@BOOK.add()
def model_grid_metrics(spark, d):
    """Both classifiers on two feature sets, saved, loaded again and evaluated on both splits."""
    registry = Registry(spark, scratch_path(spark, "models"))
    rows = _vectors(spark, d)
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), (F.col("n_chars") / 1000.0).alias("size"))
    entries = table(spark, d, "embeddings").select(F.col("vec_id").alias("post_id"), "embedding")
    both = rows.drop("features").join(entries, "post_id").join(sizes, "post_id", "left")
    mixed = assemble(both, ["embedding", "size"]).drop("embedding", "size")
    names = train_grid(registry, {"vectors": rows, "mixed_vectors": mixed}, "class_offers", ["logit", "xgb"])
    return performance(score_table(registry, names, "post_id", "class_offers"))


@BOOK.add(_scores_sql("SELECT 1.0::DOUBLE AS c, -1 AS fold", 400, 0.85).replace("SELECT id AS post_id", "SELECT 'vectors_logit' AS model, id AS post_id"))
def saved_model_scores(spark, d):
    """Scores of a model that was saved with its features, found by its name in the index, and loaded again."""
    registry = Registry(spark, scratch_path(spark, "models"))
    names = train_grid(registry, {"vectors": _vectors(spark, d)}, "class_offers", ["logit"])
    out = score_table(registry, names, "post_id", "class_offers")
    return out.select("model", "post_id", "split", "y", r("p", 4).alias("p"), "pred")


_SOFT = "sign({0}) * greatest(abs({0}) - 0.1, 0)"
_WORTH = "pow(greatest(abs({0}) - 0.1, 0), 2) / ({1} + 1)"


def _cut_sql(name: str, rows: str, by: str) -> str:
    """The best cut of every node of ``rows(node, x, g, h)``, as relation ``name(node, f, edge)``."""
    return f"""{name}_e AS (SELECT {by} AS node, unnest(x[1:64]) AS v, unnest(range(64)) AS f, g, h FROM {rows}),
 {name}_s AS (SELECT a.node, a.f, e.edge, sum(g) FILTER (v <= edge) AS gl, sum(h) FILTER (v <= edge) AS hl, sum(g) AS g, sum(h) AS h FROM {name}_e a JOIN edges e USING (f) GROUP BY ALL),
 {name}_g AS (SELECT *, round(({_WORTH.format('gl', 'hl')} + {_WORTH.format('(g - gl)', '(h - hl)')} - {_WORTH.format('g', 'h')}) / 2, 10) AS gain FROM {name}_s WHERE hl >= 5 AND h - hl >= 5),
 {name} AS (SELECT node, f, edge FROM {name}_g WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, edge) = 1)"""


@BOOK.add(
    f"""WITH {_vector_sql()}, r AS (SELECT t.id, x, w * (0.5 - y) AS g, w * 0.25 AS h, 1 AS node FROM t),
 ee AS (SELECT unnest(x[1:64]) AS v, unnest(range(64)) AS f FROM r),
 edges AS (SELECT DISTINCT f, unnest(q) AS edge FROM (SELECT f, quantile_disc(v, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM ee GROUP BY f)),
 {_cut_sql("one", "r", "node")},
 a AS (SELECT r.id, r.x, r.g, r.h, 2 + (x[one.f + 1] > one.edge)::INTEGER AS node FROM r, one),
 {_cut_sql("two", "a", "node")},
 b AS (SELECT a.*, CASE WHEN two.f IS NULL THEN a.node ELSE 2 * a.node + (a.x[two.f + 1] > two.edge)::INTEGER END AS leaf FROM a LEFT JOIN two USING (node)),
 leaf AS (SELECT leaf, -0.5 * {_SOFT.format('sum(g)')} / (sum(h) + 1) AS value FROM b GROUP BY leaf),
 placed AS (SELECT v.id, 2 + (v.x[one.f + 1] > one.edge)::INTEGER AS node, v.x FROM v, one),
 q AS (SELECT s.id, CASE WHEN two.f IS NULL THEN s.node ELSE 2 * s.node + (s.x[two.f + 1] > two.edge)::INTEGER END AS leaf FROM placed s LEFT JOIN two USING (node))
SELECT id AS post_id, round(value, 6) AS margin, (value > 0)::INTEGER AS pred FROM q JOIN leaf USING (leaf)"""
)
def boosted_leaves(spark, d):
    """One tree of two levels on bins between eighths: the leaf of every vector."""
    rows = _vectors(spark, d)
    model = fit_boosted(rows.filter("train"), "class_offers", trees=1, depth=2, rate=0.5, rows=1.0, columns=1.0, bins=8)
    out = score(model, rows, ["post_id"])
    return out.select("post_id", r(F.log(F.col("p") / (1 - F.col("p")))).alias("margin"), "pred")


@BOOK.add(
    """WITH b AS (SELECT doc_id, quality, lang = 'en' AS train FROM documents JOIN labels USING (doc_id)), p AS (SELECT avg(quality) AS r FROM b WHERE train)
       SELECT doc_id, quality, (('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < r)::INTEGER AS prediction FROM b, p"""
)
def random_baseline_rows(spark, d):
    rows = _labelled(spark, d).select(F.col("post_id").alias("doc_id"), "train", F.col("class_offers").alias("quality"))
    return random_baseline(rows, "doc_id", "quality").select("doc_id", "quality", "prediction")


# Features with little variance are left out; a few entries of the vectors are below this.
_LEAST_VARIANCE = 0.0145


@BOOK.add(
    f"""WITH RECURSIVE {_vector_sql()}, {_descent_sql("SELECT NULL::DOUBLE AS c, -1 AS fold", 1500, 0.93)},
 vars AS (SELECT j, var_pop(v) AS var FROM e GROUP BY j),
 used AS (SELECT j, row_number() OVER (ORDER BY j) AS place FROM (SELECT j FROM vars WHERE var > {_LEAST_VARIANCE} UNION ALL SELECT 64)),
 q AS (SELECT id, x, w / (1 + exp(-list_dot_product(x, b))) * (1 - 1 / (1 + exp(-list_dot_product(x, b)))) AS v FROM t, fit),
 u AS (SELECT id, v, unnest(x) AS xv, unnest(range(65)) AS j FROM q),
 cells AS (SELECT a.place AS i, c.place AS k, s FROM (SELECT l.j AS j1, r.j AS j2, sum(l.v * l.xv * r.xv) AS s FROM u l JOIN u r USING (id) GROUP BY ALL) JOIN used a ON a.j = j1 JOIN used c ON c.j = j2),
 lines AS (SELECT i, list(s ORDER BY k) AS line FROM cells GROUP BY i),
 m AS (SELECT count(*) AS m FROM lines),
 wide AS (SELECT list(list_concat(line, list_transform(range(1, m + 1), lambda k: (k = i)::INTEGER::DOUBLE)) ORDER BY i) AS rows FROM lines, m),
 solve AS (SELECT 1 AS step, rows FROM wide UNION ALL
   SELECT step + 1, list_transform(rows, lambda row, i: CASE WHEN i = step THEN list_transform(row, lambda z: z / rows[step][step])
     ELSE list_transform(list_zip(row, rows[step]), lambda z: z[1] - row[step] / rows[step][step] * z[2]) END) FROM solve, m WHERE step <= m),
 errors AS (SELECT used.j, b[used.j + 1] AS coef, sqrt(rows[place][m + place]) AS error FROM solve, m, used, fit WHERE step = m + 1 AND used.j < 64),
 z AS (SELECT *, abs(coef / error) / sqrt(2) AS z FROM errors),
 pv AS (SELECT *, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(80), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(z) - lgamma(n + 1)) / (2 * n + 1))) AS pval FROM z)
SELECT 'enc' || (j + 1) AS names, round(coef, 3) AS coefs, round(error, 4) AS sterr, pval < 0.05 AS statsig, round(pval, 4) AS pvals FROM pv"""
)
def wald_coefficients(spark, d):
    rows = balanced_weights(_vectors(spark, d).filter("train"), "class_offers").cache()
    model = fit_plain_logit(rows.drop("w"), "class_offers")
    out = wald_table(rows, model, [f"enc{i + 1}" for i in range(64)], var_thresh=_LEAST_VARIANCE)
    return out.select("names", r("coefs", 3).alias("coefs"), r("sterr", 4).alias("sterr"), "statsig", r("pvals", 4).alias("pvals"))


@BOOK.add()
def ranked_term_coefficients(spark, d):
    """Non-zero terms of an L1 model on TF-IDF vectors, largest and smallest."""
    vocabulary = _fitted(spark, d, indexed=True)
    # only texts with a label have a row in the join below
    labels = _labelled(spark, d)
    vectors = text_vectors(plain_documents(spark, d).join(labels, "post_id", "left_semi"), vocabulary, "post_id", "text", _STOPS)
    rows = prepared(labels.join(vectors, "post_id"), "class_offers", "post_id", 0)
    names = vocabulary.table.select("idx", F.col("term").alias("names"))
    top, bottom = first_and_last(settle(named_coefficients(fit_wide(rows, c=5.0)[0], names), "coefficients"), "coefs")
    return top.withColumn("end", F.lit("top")).unionByName(bottom.withColumn("end", F.lit("bottom")))


# --- similar posts ------------------------------------------------------------


@BOOK.add(
    """WITH i AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
       m AS (SELECT label, i, avg(x) AS x FROM i GROUP BY 1, 2), q AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1),
       s AS (SELECT q.label AS query_id, vec_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS cosine FROM q, embeddings)
       SELECT query_id, vec_id, round(cosine, 5) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INTEGER AS rank
       FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 5"""
)
def similar_vectors(spark, d):
    """The five vectors closest to the mean vector of each label."""
    rows = table(spark, d, "embeddings")
    entries = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    means = entries.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    queries = means.groupBy(F.col("label").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e"))
    queries = queries.select("query_id", F.col("e.x").alias("embedding"))
    out = most_similar(queries, rows.select("vec_id", "embedding"), 5, key="vec_id")
    return out.select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"), "rank")
