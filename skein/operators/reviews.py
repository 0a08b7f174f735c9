"""Reviews of relation decisions: matching, merging, searching, and scores for choosing what to audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import latest_by


def match_queue(reviews: DataFrame, queue: DataFrame, key: str, seq: str) -> DataFrame:
    """The last review of each key with `matched`: whether the queue has the key."""
    last = latest_by(reviews, [key], [seq])
    known = queue.select(F.col(key).alias("_q")).distinct()
    return last.join(known, F.col(key) == F.col("_q"), "left").withColumn("matched", F.col("_q").isNotNull()).drop("_q")


def best_score_of(wanted: DataFrame, evidence: DataFrame, key: str, method: str) -> DataFrame:
    """`wanted` and the best score by `method` of its pairs; evidence (key, method, score) of other pairs is dropped before it aggregates."""
    near = evidence.where(F.col("method") == method).join(wanted.select(key).distinct(), key, "left_semi")
    return wanted.join(near.groupBy(key).agg(F.max("score").alias("best_score")), key, "left")


def dense_score(evidence: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, score): the best over all methods whose name begins with `prefix`."""
    return evidence.where(F.startswith("method", F.lit(prefix))).groupBy(key).agg(F.max("score").alias("score"))


def dense_pairs(pairs: DataFrame, least: float, other_tool: bool = False) -> DataFrame:
    """Pairs (score, left_tool, right_tool) with a score of `least` or more and, if asked, of two tools; the best first by `place`."""
    keep = F.col("score").isNotNull() & (F.col("score") >= least)
    return pairs.where(keep & (F.col("left_tool") != F.col("right_tool")) if other_tool else keep)


def union_by_priority(tables: list[DataFrame], key: str, last_wins: bool = True) -> DataFrame:
    """One row for each key of several tables with the same columns: of the last table that has it, or of the first."""
    rows = None
    for k, t in enumerate(tables):
        marked = t.withColumn("_priority", F.lit(k if last_wins else -k))
        rows = marked if rows is None else rows.unionByName(marked)
    return latest_by(rows, [key], ["_priority"]).drop("_priority")


def merge_human(rows: DataFrame, sheet: DataFrame, log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`rows` with human `columns`: those of the log where it has a value, else those of the sheet, else empty."""
    a = sheet.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = log.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = rows.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_b_{c}", f"_a_{c}", F.lit("")).alias(c) for c in columns])


def search(rows: DataFrame, fields: list[str], needle: str | None = None, **equal) -> DataFrame:
    """Rows whose `fields` hold the needle, whatever its case, and whose columns have the values asked for (a pair is a range)."""
    for column, value in equal.items():
        rows = rows.where(F.col(column).between(*value)) if isinstance(value, tuple) else rows.where(F.col(column) == value)
    if needle:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in fields])), F.lit(needle.lower())))
    return rows


def provenance(own: Column, source: Column, field: str, default: str = "unknown") -> Column:
    """`field` of a decision's provenance, of that of its source, or the default."""
    return F.coalesce(own[field], source[field], F.lit(default))


def bin_label(low: Column, high: Column, last: Column, digits: int = 2) -> Column:
    """[low, high) with so many digits; the last bin is closed."""
    return F.concat(F.format_string(f"[%.{digits}f, %.{digits}f", low, high), F.when(last, "]").otherwise(")"))


def histogram(rows: DataFrame, value: str, edges: list[float], wrong: Column, digits: int = 2) -> DataFrame:
    """bin, label, n, errors and rate over edges as quality.quartile_edges() gives them; empty bins have no row."""
    low, high, last = F.array(*map(F.lit, edges[:-1])), F.array(*map(F.lit, edges[1:])), len(edges) - 2
    place = F.lit(None).cast("int")
    for k in range(last, -1, -1):
        place = F.when((F.col(value) >= edges[k]) & (F.col(value) < edges[k + 1]), k).otherwise(place)
    counted = rows.withColumn("bin", place).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"))
    return counted.select("bin", bin_label(F.get(low, "bin"), F.get(high, "bin"), F.col("bin") == last, digits).alias("label"), "n", "errors", F.round(F.col("errors") / F.col("n"), 6).alias("rate"))


def neighbor_summary(neighbors: DataFrame, *flags: Column) -> DataFrame:
    """pairs, mean, median, min and max score, and how many have each flag."""
    s = F.col("score")
    return neighbors.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(s), 6).alias("mean"), F.round(F.percentile(s, F.lit(0.5)), 6).alias("median"), F.min(s).alias("min"), F.max(s).alias("max"), *[F.count_if(f).alias(f"flag{k}") for k, f in enumerate(flags)])


def pool_statistics(pool: DataFrame) -> DataFrame:
    """(method, pairs) for each method, and `several` for pairs that more than one found. The pool is read once."""
    found = pool.select("pair_id", "method").distinct().groupBy("pair_id").agg(F.collect_list("method").alias("_m")).groupBy(F.array_sort("_m").alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    names = F.when(F.size("_m") > 1, F.array_append("_m", F.lit("several"))).otherwise(F.col("_m"))
    rows = found.select(F.explode(names).alias("method"), F.col("_n")).unionByName(pool.sparkSession.range(1).select(F.lit("several").alias("method"), F.lit(0).cast("long").alias("_n")))
    return rows.groupBy("method").agg(F.sum("_n").alias("pairs"))


def cluster_support(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """root, decisions: the sorted ids of the equivalences inside each cluster; a list grows with its cluster."""
    inside = decisions.where("relation = 'interchangeable'").join(labels.select(F.col("id").alias("left_id"), "root"), "left_id")
    return inside.groupBy("root").agg(F.array_sort(F.collect_set("decision_id")).alias("decisions"))


def audit_scores(name: Column, description: Column, contained: Column, same_description: Column, same_name: Column, same_signature: Column, same_tool: Column, scope: Column, reciprocal: Column, similarity: Column) -> dict[str, Column]:
    """Scores by which pairs are chosen for an audit of each relation; `name` and `description` are Jaccard similarities, flags booleans."""
    one = lambda c: c.cast("int")
    middle = one((name >= 0.25) & (name <= 0.75))
    # Weights.
    return {
        "duplicate": 5 * one(same_description) + 3 * one(same_name) + 2 * one(same_signature) + one(reciprocal) + similarity,
        "interchangeable": 3 * name + 2 * description + 1.5 * one(same_signature) + one(reciprocal) + similarity - 5 * one(same_description),
        "contains": 3 * contained + 2 * one(scope) + 1.5 * one(same_tool) + one(reciprocal) + similarity,
        "boundary": similarity + description + middle + 0.5 * one(same_tool),
    }
