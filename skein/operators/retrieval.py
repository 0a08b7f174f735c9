"""Nearest neighbours by BM25 and by cosine, and pools of the pairs that they find."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import pair_id
from ..functions.text import lexical_tokens
from . import vectorblocks
from .graph import cut

#: Vectors of one block of the blocked comparison, and its bytes at most; bytes of vectors that a task searches, and partitions of blocks at most.
BLOCK, BLOCK_BYTES = 4096, 1 << 20
RIGHT_BYTES, MOST_PARTS = 1 << 25, 512


def top_k(scored: DataFrame, source: str, score: str, tie: str, k: int) -> DataFrame:
    """Adds `rank` from 1 to k by falling score, ties by rising `tie`."""
    order = Window.partitionBy(source).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score, rank: for each (query_id, text) the k best (doc_id, text) by BM25 over distinct query terms.

    Only documents that share a term are scored. Terms and counts aggregate before any shuffle; documents are read once
    for postings and lengths, and only postings of terms that occur in queries are joined. Ranks use rounded scores, as sums
    come in no fixed order.
    """
    words = corpus.select("doc_id", lexical_tokens(F.col("text")).alias("words"))
    lengths = words.select("doc_id", F.size("words").alias("length"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    tf = words.select("doc_id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    wanted = queries.select("query_id", F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("term"))
    hits = tf.join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean = F.col("n").cast("double"), F.when(F.col("mean_length") > 0, F.col("length") / F.col("mean_length")).otherwise(0.0)
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * mean))
    # One row of totals.
    weighted = hits.join(df, "term").join(F.broadcast(totals)).select("term", "doc_id", part.alias("part"))
    pairs = wanted.join(weighted, "term")
    if exclude_self:
        pairs = pairs.where(F.col("query_id") != F.col("doc_id"))
    scored = pairs.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), digits).alias("score"))
    return top_k(scored, "query_id", "score", "doc_id", k).select("query_id", "doc_id", "score", "rank")


def dense_topk(vectors: DataFrame, k: int = 10, group: Column | None = None, exclude: Column | None = None, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """source, neighbor, score, rank: the k nearest others of each (id, vec) by cosine.

    `group`: only within equal groups; `exclude`: never of an equal value. Exact search is quadratic, so it goes block against block as matrix
    products. Vectors are sorted by (group, id) into blocks once, and each task has one partition of blocks for sources and up to RIGHT_BYTES of
    them to search, so its memory is bounded; nothing is shuffled but the vectors and k rows for each source and RIGHT_BYTES of vectors.
    """
    kind = "float" if vectors.schema["vec"].dataType.elementType.simpleString() == "float" else "double"
    width = 4 if kind == "float" else 8
    keyed = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(f"array<{kind}>").alias("vec"), (F.lit("") if group is None else group.cast("string")).alias("grp"), (F.lit(None) if exclude is None else exclude).cast("string").alias("tag")).where("id is not null and vec is not null and grp is not null")
    n, numbers = keyed.agg(F.count(F.lit(1)), F.sum(F.size("vec"))).first()
    size = width * (numbers or 0)
    parts = min(MOST_PARTS, max(1, math.ceil(size / BLOCK_BYTES), math.ceil(n / block)))
    most = max(1, min(block, BLOCK_BYTES * max(n, 1) // max(size, 1)))
    in_order = keyed.repartitionByRange(parts, "grp", "id").sortWithinPartitions("grp", "id")
    blocks = cut(in_order.mapInArrow(partial(vectorblocks.pack, most=most, kind=f"f{width}"), vectorblocks.SCHEMA).withColumn("block", F.monotonically_increasing_id()))
    left, right = (rows.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side, rows in (("l", blocks), ("r", blocks.coalesce(max(1, math.ceil(size / RIGHT_BYTES))))))
    # Every partition of the left with every one of the right, in which only blocks with a common group meet.
    both = left.join(right.hint("shuffle_replicate_nl"), (F.col("l_first") <= F.col("r_last")) & (F.col("r_first") <= F.col("l_last")))
    work = partial(vectorblocks.search, k=k, kind=f"f{width}", digits=digits)
    return top_k(both.mapInArrow(work, "source long, neighbor long, score double"), "source", "score", "neighbor", k)


def pool_pairs(neighbors: DataFrame) -> DataFrame:
    """pair_id, left_id, right_id, method, hits, directions, best_rank, worst_rank, best_score from (method, source, neighbor, rank, score)."""
    a, b = F.col("source"), F.col("neighbor")
    rows = neighbors.select("method", F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id"), "source", "rank", "score")
    rolled = rows.groupBy("left_id", "right_id", "method").agg(
        F.count(F.lit(1)).alias("hits"),
        F.countDistinct("source").alias("directions"),
        F.min("rank").alias("best_rank"),
        F.max("rank").alias("worst_rank"),
        F.max("score").alias("best_score"),
    )
    return rolled.withColumn("pair_id", pair_id(F.col("left_id"), F.col("right_id")))


def stratum(dense: Column, reciprocal: Column, dense_rank: Column, lexical_rank: Column) -> Column:
    """The label of a pair by which methods found it, in both directions or one, and at what rank."""
    prefix = F.when(reciprocal, "qwen_mutual").otherwise("qwen_oneway")
    near = F.when(dense_rank <= 3, "_top3").when(dense_rank <= 10, "_rank4_10").otherwise("_rank11_30")
    return F.when(dense, F.concat(prefix, near)).when(lexical_rank <= 10, "bm25_only_top10").otherwise("bm25_only_rank11_30")


def pair_features(pool: DataFrame, dense: str = "dense", lexical: str = "bm25") -> DataFrame:
    """One row a pair: presence, reciprocity, ranks and scores of both methods, and the stratum."""
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    rows = pool.groupBy("pair_id", "left_id", "right_id").agg(
        F.max((F.col("method") == dense).cast("int")).cast("boolean").alias("dense_present"),
        F.max((F.col("method") == lexical).cast("int")).cast("boolean").alias("lexical_present"),
        F.coalesce(pick(dense, "directions") == 2, F.lit(False)).alias("dense_reciprocal"),
        pick(dense, "best_rank").alias("dense_best_rank"),
        pick(dense, "best_score").alias("dense_best_score"),
        pick(lexical, "best_rank").alias("lexical_best_rank"),
    )
    return rows.withColumn("stratum", stratum(F.col("dense_present"), F.col("dense_reciprocal"), F.col("dense_best_rank"), F.col("lexical_best_rank")))
