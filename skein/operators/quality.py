"""Summaries, histograms and thresholds over scored and reviewed pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges of the score histogram, the thresholds of cumulative error, recall targets and score cuts.
EDGES = [0.0, 0.85, 0.90, 0.95, 1.0000001]
CONFIDENCES = [0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]
TARGETS, CUTS = [1.0, 0.95, 0.90], [0.80, 0.85, 0.90, 0.92, 0.95]


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def numeric_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, min, max, mean and median (the mean of the two middle values) of what isn't null."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"))


def quantiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """min, p10, p25, p50, p75, p90 and max with linear interpolation."""
    parts = F.percentile(F.col(value), F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("q")
    rows = df.groupBy(*keys).agg(F.min(value).alias("min"), parts, F.max(value).alias("max"))
    return rows.select(*keys, "min", *[F.round(F.col("q")[k], 6).alias(f"p{p}") for k, p in enumerate((10, 25, 50, 75, 90))], "max")


def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, missing, min, the upper of the two middle values, and max.

    Rows aggregate by value before a running count over the distinct values of a key.
    """
    by = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    known, whole = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0), Window.partitionBy(*keys)
    ranked = by.withColumn("_upto", F.sum(known).over(whole.orderBy(value))).withColumn("_known", F.sum(known).over(whole))
    middle = F.col(value).isNotNull() & (F.col("_upto") >= F.floor(F.col("_known") / 2) + 1)
    return ranked.groupBy(*keys).agg(F.sum(known).alias("n"), F.sum(F.col("_n") - known).alias("missing"), F.min(value).alias("min"), F.max(value).alias("max"), F.min(F.when(middle, F.col(value))).alias("upper_median"))


def histogram(df: DataFrame, score: str, relation: str, relations: list[str], edges: list[float] | None = None, wrong: Column | None = None) -> DataFrame:
    """low, high, n, a count for each relation, and with `wrong` its count and rate; bins without rows don't appear."""
    edges = EDGES if edges is None else edges
    bins = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        bins = F.when((F.col(score) >= edges[k - 1]) & (F.col(score) < edges[k]), k - 1).otherwise(bins)
    counts = [F.count_if(F.col(relation) == r).alias(r) for r in relations]
    errors = [] if wrong is None else [F.count_if(wrong).alias("false_count"), F.round(F.avg(wrong.cast("int")), 6).alias("false_rate")]
    rows = df.withColumn("_bin", bins).where(F.col("_bin").isNotNull()).groupBy("_bin").agg(F.count(F.lit(1)).alias("n"), *counts, *errors)
    low, high = F.array(*map(F.lit, edges[:-1])), F.array(*map(F.lit, edges[1:]))
    return rows.select(F.get(low, F.col("_bin")).alias("low"), F.get(high, F.col("_bin")).alias("high"), *rows.columns[1:])


def quartile_edges(df: DataFrame, value: str) -> list[float]:
    """Distinct quartiles of the whole column, the last one a little higher; one value gives a narrow bin."""
    found = df.agg(F.percentile(F.col(value), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))).first()[0]
    edges = list(dict.fromkeys(found or []))
    if len(edges) == 1:
        edges.append(edges[0])
    return [*edges[:-1], edges[-1] + 1e-9] if edges else []


def cumulative_error(df: DataFrame, confidence: str, wrong: Column, thresholds: list[float] | None = None) -> DataFrame:
    """threshold, n, errors and rate among rows with at most that confidence; thresholds without rows don't appear."""
    found = CONFIDENCES if thresholds is None else thresholds
    steps = F.filter(F.array(*map(F.lit, found)), lambda t: F.col(confidence) <= t)
    rows = df.select(wrong.cast("int").alias("_wrong"), F.explode(steps).alias("threshold"))
    return rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("_wrong").alias("errors"), F.round(F.avg("_wrong"), 6).alias("rate"))


def threshold_for_recall(df: DataFrame, score: str, positive: Column, targets: list[float] | None = None) -> DataFrame:
    """target, threshold: the highest score of a positive row at which so large a share of positives scores as high; null scores are misses.

    Positives are read once: they aggregate by score before a running sum over their distinct scores, null the last of them.
    """
    by = df.where(positive).groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    upto, total = F.sum("_n").over(Window.orderBy(F.desc_nulls_last(score))), F.sum("_n").over(Window.partitionBy())
    running = by.withColumn("_recall", upto / total).where(F.col(score).isNotNull())
    wanted = F.explode(F.array(*map(F.lit, TARGETS if targets is None else targets))).alias("target")
    return running.select(score, "_recall", wanted).where("_recall >= target - 1e-12").groupBy("target").agg(F.max(score).alias("threshold"))


def threshold_sensitivity(df: DataFrame, score: str, positive: Column, cuts: list[float] | None = None) -> DataFrame:
    """threshold, positive_recall, negatives_filtered, pool_retained; null scores are filtered at every threshold."""
    rows = df.select(positive.alias("_p"), F.col(score).alias("_s"), F.explode(F.array(*map(F.lit, CUTS if cuts is None else cuts))).alias("threshold"))
    kept = F.coalesce(F.col("_s") >= F.col("threshold"), F.lit(False))
    p, n = F.count_if(F.col("_p")), F.count_if(~F.col("_p"))
    return rows.groupBy("threshold").agg(
        F.round(ratio(F.count_if(F.col("_p") & kept), p), 6).alias("positive_recall"),
        F.round(ratio(F.count_if(~F.col("_p") & ~kept), n), 6).alias("negatives_filtered"),
        F.round(ratio(F.count_if(kept), F.count(F.lit(1))), 6).alias("pool_retained"),
    )
