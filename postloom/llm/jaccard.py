"""Exact Jaccard join of word-shingle sets, with adaptive multi-match prefixes.

Shingles get one global order: rare before frequent, by counts in a fixed number
of hash buckets, then by hash. If two sets need an overlap of ``o``, they share
at least ``l`` tokens among the first ``size - o + l`` of each, for every ``l``.
With ``l = 1`` this gives candidates: documents that share one token at places
that their sizes allow. Each document also picks an ``l`` of its own: a longer
prefix is longer to compare, but more of its tokens must be shared before a pair
is verified, which pays where the prefix holds frequent tokens. For two
documents the smaller of their ``l`` counts. Before any pair is made, the
longest ``l`` is asked of each document alone: with fewer prefix tokens that
stand in another prefix at all, it has no partner.

Equal word sequences are one class and travel once. A group of documents that
share a prefix token is not turned into all its pairs while these are many: its
members meet one leader, links are joined to components, members of one
component need no more comparing, and the next leader meets only members of
other components. When few pairs of different components are left they are
compared in one go. So no link between components is missed, and a large group
of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.graph import components
from postloom.llm.words import Block, Hashes, as_long, blocks, ragged
from postloom.session import settle

SHINGLE = 5
PERCENT = 80
LONGEST = 16
VERIFY_COST = 8.0
BUCKET_BITS = 26
MOST_BUCKETS = 1 << 21  # frequent buckets that are told apart at most
PAIRS_PER_ROW = 2  # pairs left that are compared in one go, for each row of the prefix groups


def overlap(n: str, m: str, percent: int) -> str:
    """The overlap that sets of two sizes need."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def shingle_sets(block: Block, hashes: Hashes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every distinct shingle, by text; a text with fewer words has its whole sequence as one."""
    words = hashes.of_bytes(block.data, block.starts, block.ends)
    wins = hashes.windows(words, size)
    inside = np.flatnonzero(block.doc[: len(wins)] == block.doc[size - 1 :]) if len(wins) else np.empty(0, np.int64)
    n = block.n_words
    short = np.flatnonzero((n > 0) & (n < size))
    doc = np.concatenate([block.doc[inside], short])
    h = np.concatenate([wins[inside], hashes.word_ranges(words, block.first[short], block.first[short + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _bucket_counts(text: str, size: int, bits: int):
    """Buckets that a task has met twice or more, and the number of shingles as bucket -1.

    Only the order of shingles hangs on these counts, not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, total = Hashes(), np.zeros(1 << bits, np.uint8), 0
        for part in blocks(batches, text):
            _, h = shingle_sets(Block(part.column(text), lower=True), hashes, size)
            at, c = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            counts[at] = np.minimum(counts[at] + c, 255)
            total += len(h)
        large = np.flatnonzero(counts >= 2)
        for at in range(0, len(large), 1 << 17):
            part = large[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part].astype(np.int64))], ["bucket", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total], pa.int64())], ["bucket", "c"])

    return run


def frequent_buckets(texts: DataFrame, text: str, size: int = SHINGLE, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that stand out, at most ``MOST_BUCKETS``, and their counts as powers of two."""
    sums = settle(texts.mapInArrow(_bucket_counts(text, size, bits), "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")), "buckets")
    total = sums.filter("bucket = -1").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    least = max(6, 4 * total / (1 << bits))
    known = sums.filter("bucket >= 0")
    while known.filter(F.col("c") >= least).count() > MOST_BUCKETS:
        least *= 2
    large = known.filter(F.col("c") >= least).toArrow()
    if not large.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    return large["bucket"].to_numpy(), np.log2(large["c"].to_numpy()).astype(np.uint8)


def _prefixes(text: str, size: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hashes(), Hashes(second=True)
        level, shift = np.zeros(1 << BUCKET_BITS, np.uint8), np.uint64(64 - BUCKET_BITS)
        level[levels.value[0]] = levels.value[1]
        for part in blocks(batches, text):
            block = Block(part.column(text), lower=True)
            doc, h = shingle_sets(block, one, size)
            rank = level[(h >> shift).astype(np.int64)]
            order = np.lexsort((h, rank, doc))
            h, rank = h[order], rank[order]
            n = np.bincount(doc, minlength=block.n_texts)
            base = np.concatenate([[0], np.cumsum(n)])[:-1]
            least = (percent * n + 99) // 100
            cost = np.concatenate([[0.0], np.cumsum(np.where(rank > 0, np.exp2(rank.astype(float)), 0.0))])
            best, chosen = np.full(len(n), np.inf), np.zeros(len(n), np.int64)
            for l in range(1, LONGEST + 1):
                end = n - least + l
                may = (l <= least) & (n > 0)
                stop = base + np.where(may, end, 0)
                this = np.where(may, end + VERIFY_COST * (cost[stop] - cost[base]) / l, np.inf)
                chosen = np.where(this < best, l, chosen)
                best = np.minimum(best, this)
            length = np.where(n > 0, n - least + np.minimum(LONGEST, least), 0)
            place = np.arange(len(h)) - np.repeat(base, n)
            keep = place < np.repeat(length, n)
            sums = [f.word_ranges(f.of_bytes(block.data, block.starts, block.ends), block.first[:-1], block.first[1:]) for f in (one, two)]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(n), as_long(sums[0]), as_long(sums[1]), pa.array(chosen.astype(np.int32)), ragged(as_long(h[keep]), length)],
                ["key", "n", "d1", "d2", "l", "prefix"],
            )

    return run


def _verified(size: int, percent: int):
    """Pairs of texts whose shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for part in blocks(batches, "text_b"):
            sides = [shingle_sets(Block(part.column(c), lower=True), hashes, size) for c in ("text_a", "text_b")]
            sizes = [np.bincount(doc, minlength=part.num_rows) for doc, _ in sides]
            doc, h = (np.concatenate(x) for x in zip(*sides, strict=True))
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
            shared = np.bincount(doc[1:][same], minlength=part.num_rows)
            union = sizes[0] + sizes[1] - shared
            hit = pa.array((100 * shared >= percent * union) & (union > 0))
            yield part.select(["a", "b"]).filter(hit)

    return run


def shared_tokens(tokens: DataFrame, percent: int) -> DataFrame:
    """``(token, node, n, pos, smallest)`` of the prefix tokens that stand in several prefixes, with the smallest size of these.

    Most tokens stand in one prefix alone, and all of them are shuffled: rows are
    kept short, and a token, which a node has once, is only counted.
    """
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("smallest")).filter("c > 1").select("token", "smallest")
    sent = tokens.select("token", "node", F.expr(f"cast(n as bigint) * {1 << 32} + pos").alias("place"))
    held = sent.join(shared, "token").select("token", "node", F.expr("cast(shiftright(place, 32) as int)").alias("n"), F.expr(f"cast(place & {(1 << 32) - 1} as int)").alias("pos"), "smallest")
    # of tokens beyond the places for l = 1 it is only asked whether they are shared at all
    return held.filter(f"{overlap('n', 'smallest', percent)} - {LONGEST - 1} <= n - pos")


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``(key, n_shingles, component)`` for every document.

    Words are lower-cased (A-Z) and cut at ASCII white space; the set of a text
    is its distinct ``size``-word shingles, or its whole sequence if shorter. Two
    documents link when ``100 * shared >= percent * union``; the component is the
    smallest key reachable by links. Null and empty texts have no shingle, link
    with nothing and are their own component. Keys must be unique and not null.
    Further columns are not read; an empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    levels = spark.sparkContext.broadcast(frequent_buckets(texts, "text", size))
    sets = settle(
        texts.mapInArrow(_prefixes("text", size, percent, levels), f"key {kind}, n bigint, d1 bigint, d2 bigint, l int, prefix array<bigint>"), "prefixes"
    )
    classes = sets.filter("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("node"))
    members = settle(sets.filter("n > 0").select("key", "d1", "d2").join(classes, ["d1", "d2"]).select("key", "node"), "members")
    single = sets.filter("n > 0").join(members.filter("key <> node").select("key"), "key", "left_anti")
    tokens = single.select(F.posexplode("prefix").alias("pos", "token"), F.col("key").alias("node"), F.col("n").cast("int"))
    held = settle(shared_tokens(tokens, percent), "shared-tokens")
    share = f"({percent} * n + 99) div 100"
    # a partner has at least that share of this size, so its own longest l is at least this
    asks = F.expr(f"least({LONGEST}, ({percent} * ({share}) + 99) div 100)")
    active = held.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).filter(F.col("c") >= asks).select("node")
    active = settle(active, "nodes")
    groups = held.join(active, "node").filter(f"{overlap('n', 'smallest', percent)} <= n - pos")
    groups = settle(groups.select("token", "node", "n", "pos"), "groups")
    most = PAIRS_PER_ROW * groups.count()
    # texts that can be asked for, so that a round does not shuffle all of them
    nodes = active.withColumnRenamed("node", "key")
    asked = settle(texts.join(nodes, "key", "left_semi"), "asked-texts")
    asked_sets = settle(sets.join(nodes, "key", "left_semi").select("key", "n", "l", "prefix"), "asked-sets")

    needs = overlap("a.n", "b.n", percent)
    may = f"{needs} <= a.n - a.pos and {needs} <= b.n - b.pos"

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs ``(a, b)``: first by shared prefix tokens, then by whole sets."""
        a, b = (asked_sets.select(*[F.col(c).alias(f"{c}_{x}") for c in asked_sets.columns]) for x in "ab")
        near = pairs.distinct().join(a, F.col("a") == F.col("key_a")).join(b, F.col("b") == F.col("key_b"))
        near = near.withColumn("need", F.expr(overlap("n_a", "n_b", percent))).withColumn("l", F.least("l_a", "l_b", "need"))
        parts = [F.slice(f"prefix_{x}", F.lit(1), (F.col(f"n_{x}") - F.col("need") + F.col("l")).cast("int")) for x in "ab"]
        near = settle(near.filter(F.size(F.array_intersect(*parts)) >= F.col("l")).select("a", "b"), "candidates")
        whole = near.join(asked.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        whole = whole.join(asked.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        return settle(whole.select("a", "b", "text_a", "text_b").mapInArrow(_verified(size, percent), f"a {kind}, b {kind}"), "links")

    links: DataFrame | None = None
    found: DataFrame | None = None
    while True:
        if found is None:
            left = groups.withColumn("component", F.col("node"))
        else:
            left = groups.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = left.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
        open_ = sizes.groupBy("token").agg(
            F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("inside"), F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "component")).alias("most")
        ).filter("k > 1")
        open_ = settle(open_.select("token", "m", "inside", F.col("most.component").alias("most")), "open-groups")
        rows, pairs = open_.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("inside")) / 2), F.lit(0))).first()
        if not rows:
            break
        left = settle(left.join(open_.select("token", "most"), "token"), "left")
        last = found is not None and pairs <= most  # leaders come first, as most pairs then lie inside components
        if last:
            # one of two components is not the largest of the group
            minor = left.filter("component <> most")
            met = minor.alias("a").join(left.alias("b"), F.expr(f"a.token = b.token and a.component <> b.component and (a.node < b.node or b.component = b.most) and {may}"))
            met = met.select(F.expr("least(a.node, b.node)").alias("a"), F.expr("greatest(a.node, b.node)").alias("b"))
        else:
            # the leader has the token earliest, so it has the fewest rare tokens of its own
            first = left.groupBy("token").agg(F.min(F.struct("pos", "node", "n", "component")).alias("first")).select("token", "first.*")
            met = left.alias("b").join(first.alias("a"), F.expr(f"a.token = b.token and a.component <> b.component and {may}"))
            met = met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
            rest = left.join(first.select("token", F.col("node").alias("leader")), "token").filter("node <> leader")
            groups = settle(rest.select("token", "node", "n", "pos"), "groups")
        more = verified(met)
        links = more if links is None else links.union(more)
        found = settle(components(links), "components")
        if last:
            break

    if found is None:
        found = members.select("node", F.col("node").alias("component")).limit(0)
    out = sets.select("key", F.col("n").alias("n_shingles")).join(members, "key", "left")
    out = out.join(found, "node", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("component", "node", "key").alias("component"))
