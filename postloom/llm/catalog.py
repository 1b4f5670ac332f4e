"""The queries over the shared test tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.catalog.common import Book
from postloom.llm import bpe, jaccard, mixing, ordinal, quality, repair, substrings, suffix_tree, token_store, toxicity, vectors, warc, whitening

BOOK = Book()

REPEATED_WINDOWS = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS t FROM w, unnest(range(1, len(words) - 33)) AS r(i)),
twice AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN twice USING (t), unnest(range(0, 35)) AS r(j)),
parts AS (SELECT w.doc_id, p, words[p] AS word, c.p IS NOT NULL AS gone FROM
  (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w) w LEFT JOIN covered c USING (doc_id, p)),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM parts GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN sums USING (doc_id)"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@BOOK.add(REPEATED_WINDOWS)
def op10_super_kmers(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.without_repeats(documents(spark, folder))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS t FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (t) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)"""


@BOOK.add(JACCARD)
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, folder)).withColumnRenamed("component", "component_id")


@BOOK.add()
def op6_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.decoded(bpe.encoded(documents(spark, folder), path), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@BOOK.add()
def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    files = token_store.write_tokens(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return token_store.read_tokens(spark, files, with_ids=False)


@BOOK.add()
def op7_zipped_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"))
    out = warc.read_archives(spark, archives, with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Target weights of the mixture; names that are not listed weigh 1.
MIX = {
    "domain": {"crawl": 3, "reference": 4, "forum": 3},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {"src3": 2, "src12": 2},
}
EPOCHS = 2
SEED = 17
WORD_SQL = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"


def with_domain(docs: DataFrame) -> DataFrame:
    """``doc_id``, the levels of the tree and the words of each document."""
    domain = F.when(F.col("source") == "src0", "crawl").when(F.col("source").rlike("^src[1-9]$"), "reference").otherwise("forum")
    return docs.select("doc_id", domain.alias("domain"), "lang", "source", mixing.n_words(F.col("text")).alias("tokens"))


def _weight_sql(level: str) -> str:
    return "(CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX[level].items()) + " ELSE 1 END)::BIGINT"


def _level_sql(depth: int) -> str:
    """The budgets of the nodes at one depth from those one level up."""
    names = mixing.LEVELS[:depth]
    key = lambda cols: "to_json([" + ", ".join(cols) + "])" if cols else "'[]'"
    up = f"b{depth - 1}"
    return f"""k{depth} AS (SELECT {key(names[:-1])} AS parent, {key(names)} AS node, sum(cap)::BIGINT AS cap, {_weight_sql(names[-1])} AS w
  FROM leaves GROUP BY {", ".join(names)}),
o{depth} AS (SELECT k.*, budget AS pb, CASE WHEN w > 0 THEN cap::DOUBLE / w ELSE 'infinity'::DOUBLE END AS lst FROM k{depth} k JOIN {up} u ON u.node = k.parent),
f{depth} AS (SELECT *, w > 0 AND cap * sum(w) OVER (PARTITION BY parent ORDER BY lst, node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= w * (pb - coalesce(sum(cap) OVER (PARTITION BY parent ORDER BY lst, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM o{depth}),
g{depth} AS (SELECT *, pb - coalesce(sum(cap) FILTER (full_) OVER (PARTITION BY parent), 0) AS rest, sum(w) FILTER (NOT full_) OVER (PARTITION BY parent) AS ws FROM f{depth}),
h{depth} AS (SELECT *, CASE WHEN full_ THEN cap WHEN ws > 0 THEN (w * rest) // ws ELSE 0 END AS part FROM g{depth}),
b{depth} AS (SELECT node, (part + CASE WHEN NOT full_ AND w > 0 AND row_number() OVER (PARTITION BY parent ORDER BY full_ OR w = 0, lst, node)
  <= rest - coalesce(sum(part) FILTER (NOT full_) OVER (PARTITION BY parent), 0) THEN 1 ELSE 0 END)::BIGINT AS budget FROM h{depth})"""


MIX_SQL = f"""WITH docs AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_matches(source, '^src[1-9]$') THEN 'reference' ELSE 'forum' END AS domain,
  lang, source, {WORD_SQL}::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply, (sum(tokens) * {EPOCHS})::BIGINT AS cap FROM docs GROUP BY ALL),
b0 AS (SELECT '[]' AS node, least(sum(supply), sum(cap))::BIGINT AS budget FROM leaves),
{_level_sql(1)}, {_level_sql(2)}, {_level_sql(3)},
given AS (SELECT l.domain, l.lang, l.source, budget // supply AS whole, budget % supply AS rest FROM leaves l
  JOIN b3 ON b3.node = to_json([l.domain, l.lang, l.source]) WHERE budget > 0),
placed AS (SELECT doc_id, tokens, whole, rest, sum(tokens) OVER (PARTITION BY d.domain, d.lang, d.source
  ORDER BY ('0x' || substr(md5('{SEED}|' || whole || '|' || doc_id), 1, 13))::BIGINT, doc_id) AS run
  FROM docs d JOIN given g ON g.domain = d.domain AND g.lang IS NOT DISTINCT FROM d.lang AND g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, tokens, (whole + CASE WHEN tokens > 0 AND run <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM placed
WHERE whole + CASE WHEN tokens > 0 AND run <= rest THEN 1 ELSE 0 END > 0"""


@BOOK.add(MIX_SQL)
def op4_target_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(with_domain(documents(spark, folder)), MIX, epochs=EPOCHS, seed=SEED)


COSINE = """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b USING (label) WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least"""


@BOOK.add(COSINE)
def op9_pca_tiles(spark: SparkSession, folder: str) -> DataFrame:
    out = vectors.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    out = out.withColumnRenamed("component", "component_id")
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@BOOK.add()
def op5_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.language_scores(documents(spark, folder), ~suffix_tree.held_out(F.col("doc_id")))


@BOOK.add()
def op2_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(documents(spark, folder))


def with_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a grade: 0 toxic, 1 of low quality, 2 good."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return documents(spark, folder).select("doc_id", "text").join(labels.select("doc_id", grade.alias("grade")), "doc_id")


@BOOK.add()
def op3_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    model = ordinal.fit(with_grades(spark, folder), n_grades=3)
    return ordinal.graded_quality(documents(spark, folder), model, select_from=2)


@BOOK.add()
def op12_run_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return repair.repair_digest(conversations, *repair.repaired(repair.damaged(conversations), n="n"))


@BOOK.add()
def op11_feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(spark.read.parquet(f"{folder}/embeddings.parquet"))


def fold(doc_id: Column) -> Column:
    """Remainder that names a document's fold; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def with_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents outside the held-out fold."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return documents(spark, folder).select("doc_id", "text").join(labels.filter(fold(F.col("doc_id")) != 0), "doc_id")


@BOOK.add()
def op13_attention_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    model = toxicity.fit(with_toxicity(spark, folder))
    out = toxicity.toxicity(documents(spark, folder), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
