"""From documents to packed training sequences. Each stage gets all that its predecessor kept, as a table of its own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import line_dedup, ngram_join, packing, toxicity, weak_labels
from skein.llm.common import documents, labels, scratch


#: Chunks that a tokenising worker remembers here; its memory also holds what earlier stages used.
CACHE = 40_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.keep_clean(docs, labels(spark, sf_dir))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 go."""
    return weak_labels.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go but for their first occurrence; so do documents of which nothing else is left. n_chars follows."""
    out = line_dedup.clean(docs, "source")
    # The last column counts removed lines, whatever its name among those of the table.
    removed = F.col(out.columns[-1])
    left = (removed == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    n_chars = F.when(removed > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.where(left).withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a similarity of 0.8 or more in shingles of five words, the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1, cache=CACHE)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
