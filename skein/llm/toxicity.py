"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, release, scratch, session, slices, up_to
from .linear import BITS, SIZES, SLICE, Model, distinct_hits, grams, logistic

#: Labelled documents that training takes, chosen by a hash of their ids: about so many where there are more.
TRAIN_ROWS = 16_000
#: n-grams must be in so many training documents, and differ between the classes by this chi-square value (a chance of 0.001)
#: and this log-count ratio at least; the ratio keeps out n-grams that only tell long texts from short ones.
LEAST_DOCUMENTS, LEAST_CHI2, LEAST_RATIO, MOST_FEATURES = 4, 10.8, 1.0, 1 << 14
#: n-grams kept in all training documents together, 12 bytes each in the driver: fewer documents are taken if they have more.
TRAIN_ENTRIES = 16_000_000
#: Tasks that read the training documents, whose number is bounded.
TASKS = 16
SMOOTHING = 1.0


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of about `rows` labelled documents at most, none of them held out.

    Repeated labels of a document count as one, the largest; null labels and ids are none. The chosen ids are broadcast:
    their number is bounded by `rows`, which is a parameter, and not by the input. Of rows with one doc_id, the smallest
    text is taken, so a repeated document does not make the training rows many.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("double").alias("y"))
    chosen = bounded_sample(known, rows, 7, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return own.repartition(TASKS, "doc_id")


def train(rows: DataFrame, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> Model:
    """Fits the model to (text, y) rows. To the driver go selected n-grams and their places in the training rows only."""
    spark = session(rows)
    rows = scratch(rows, "toxicity-rows")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), np.int64)
        for batch in slices(batches, most=SLICE):
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False) > 0.5
            found = np.unique(np.concatenate([np.zeros(0, np.int64), *[o.astype(np.int64) << bits | b for o, b in grams(texts, sizes, bits)]]))
            positive = y[found >> bits]
            for k in (0, 1):
                totals[k] += np.bincount(found[positive == bool(k)] & ((1 << bits) - 1), minlength=1 << bits)
        seen = np.flatnonzero(totals.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(totals[1, seen]), pa.array(totals[0, seen])], names=["bucket", "pos", "neg"])

    texts = rows.select("text", "y")
    counts = scratch(texts.mapInArrow(count, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxicity-counts")
    n_pos, n = (float(x or 0) for x in rows.agg(F.sum("y"), F.count("y")).first())
    n_neg = n - n_pos
    sum_pos, sum_neg = (float(x or 0) for x in counts.agg(F.sum(F.col("pos") + SMOOTHING), F.sum(F.col("neg") + SMOOTHING)).first())
    if not n_pos or not n_neg:
        return Model(np.zeros(1 << bits, np.float32), -4.0 if not n_pos else 4.0, sizes, bits)
    both = F.col("pos") + F.col("neg")
    expected = both * F.lit(n_pos / n)
    chi2 = F.pow(F.col("pos") - expected, 2) / (expected * F.lit(n_neg / n) * (1 - both / F.lit(n + 1)))
    ratio = F.log((F.col("pos") + SMOOTHING) / sum_pos) - F.log((F.col("neg") + SMOOTHING) / sum_neg)
    chosen = counts.where(both >= LEAST_DOCUMENTS).withColumn("chi2", chi2).where((F.col("chi2") >= LEAST_CHI2) & (F.abs(ratio) >= LEAST_RATIO)).orderBy(F.desc("chi2"), "bucket").limit(MOST_FEATURES).collect()
    buckets = np.array([x["bucket"] for x in chosen], np.int64)
    ratio = np.array([np.log((x["pos"] + SMOOTHING) / sum_pos) - np.log((x["neg"] + SMOOTHING) / sum_neg) for x in chosen])
    place = np.zeros(1 << bits, np.int32)
    place[buckets] = np.arange(1, len(buckets) + 1)
    shared = spark.sparkContext.broadcast(place)

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            owner, bucket = distinct_hits(batch.column(0).to_pylist(), shared.value, sizes, bits)
            columns = np.split((shared.value[bucket] - 1).astype("<i4"), np.searchsorted(owner, np.arange(1, batch.num_rows)))
            lengths = pa.array([len(x) for x in columns], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2), lengths, pa.array([x.tobytes() for x in columns], pa.binary()), batch.column(1)], names=["_hash", "size", "columns", "y"])

    keyed = texts.withColumn("_hash", F.xxhash64("text"))
    matrix = scratch(keyed.mapInArrow(entries, "_hash long, size long, columns binary, y double"), "toxicity-matrix")
    matrix = up_to(matrix, "size", TRAIN_ENTRIES).drop("_hash").toArrow()
    which = np.repeat(np.arange(matrix.num_rows, dtype=np.int32), matrix.column("size").to_numpy())
    flat = np.frombuffer(b"".join(matrix.column("columns").to_pylist()), "<i4")
    weights, bias = logistic(which, flat, ratio.astype(np.float32)[flat] if len(flat) else np.zeros(0, np.float32), matrix.column("y").to_numpy(), len(buckets))
    del matrix, which, flat
    table = np.zeros(1 << bits, np.float32)
    table[buckets] = ratio * weights
    shared.destroy()
    release(spark)
    return Model(table, bias, sizes, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score of 0.5 or more) of every whole text; a null text scores as an empty one."""
    shared = session(docs).sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            values = shared.value.scores([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; only labels of documents outside fold 0 are learnt.

    A null text scores as an empty one, a null doc_id is not held out, repeated rows are scored each, other columns are
    ignored. Without labels of both classes all scores are near 0 or near 1. An empty table gives none.
    """
    model = train(training_rows(docs, labels, "toxic", rows))
    return score(docs, model).select("doc_id", (F.coalesce(fold() == 0, F.lit(False))).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` that score under 0.5, with their own columns, in one pass after training; nulls and repeats as in classify()."""
    shared = session(docs).sparkContext.broadcast(train(training_rows(docs, labels, "toxic", rows)))
    at = docs.columns.index("text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            values = shared.value.scores([x or "" for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(values < 0.5))

    return docs.mapInArrow(work, docs.schema)
