"""Ranks within keys, latest and best rows, and samples that depend on a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import UNIT


def seeded_order(seed: int, name: Column | str, key: Column) -> Column:
    n = F.lit(name) if isinstance(name, str) else name
    return F.sha2(F.concat_ws(UNIT, F.lit(str(seed)), n, key.cast("string")), 256)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; `order` should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_by(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """The last event of each key by max_by, which aggregates before its shuffle, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_last"))
    return packed.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def interleave(df: DataFrame, stratum: str, order: list[str]) -> DataFrame:
    """Adds `position`: the first of each stratum by name, then the second of each, and so on. Strata are few; their counts go to the driver."""
    counts = dict(df.groupBy(stratum).count().collect())
    if not counts:
        return df.withColumn("position", F.lit(None).cast("long"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order)).cast("long")
    ranked = df.withColumn("_rn", rank)
    # What comes before: all earlier ranks of every stratum, and this rank of the strata whose names come first.
    before = F.lit(0).cast("long")
    for name, n in counts.items():
        here = (F.lit(name) <= F.col(stratum)) & (F.col("_rn") <= n)
        before = before + F.least(F.lit(n), F.col("_rn") - 1) + F.when(here, 1).otherwise(0)
    return ranked.withColumn("position", before).drop("_rn")


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int, order: list[str] | None = None) -> DataFrame:
    """`size` rows in equal quotas by stratum, the remainder to the first strata of `order` (by name); strata that are too
    small leave the rest to a draw from all rows not yet chosen. The stratum counts, a few rows, set the quotas.
    """
    counts = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    names = [s for s in (order or sorted(counts)) if counts.get(s)]
    if not names:
        return df.limit(0)
    target = min(size, sum(counts.values()))
    base, more = divmod(target, len(names))
    quota = {s: base + (k < more) for k, s in enumerate(names)}
    quotas = F.create_map(*[x for s, q in quota.items() for x in (F.lit(s), F.lit(q))])
    w = Window.partitionBy(stratum).orderBy(seeded_order(seed, F.col(stratum), F.col(key)), key)
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumn("_quota", F.element_at(quotas, F.col(stratum)))
    chosen = ranked.where("_rn <= _quota").drop("_rn", "_quota")
    missing = target - sum(min(q, counts[s]) for s, q in quota.items())
    if missing:
        rest = ranked.where("_rn > _quota").drop("_rn", "_quota").orderBy(seeded_order(seed, "redistribution", F.col(key)), key).limit(missing)
        chosen = chosen.unionByName(rest)
    return chosen


def greedy_select(df: DataFrame, key: str, scorers: list[tuple[str, Column]], count: int) -> DataFrame:
    """The `count` best rows for each (target, score) in turn, none twice; adds `target` and `score`."""
    left, out = df, None
    for target, score in scorers:
        best = left.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), key).limit(count).withColumn("target", F.lit(target))
        out = best if out is None else out.unionByName(best)
        left = left.join(best.select(key), key, "left_anti")
    return out
