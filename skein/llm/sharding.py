"""Shards cut from a Hilbert curve over several metadata dimensions, in built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, salt, salted_rank, scratch

#: Accuracy of the quantiles at which numbers are cut: an error of a thousandth of the rows.
ACCURACY = 1000


def hilbert_indices(dims: int, bits: int) -> list[int]:
    """Places along the curve of all cells of a grid with 2**bits levels a side; a cell's number has its first dimension highest.

    By exclusive-or and Gray code: from the highest bit to the lowest, a level's bit either inverts the lower bits of the
    first dimension or exchanges them with its own.
    """
    out = []
    for cell in range(1 << dims * bits):
        x = [cell >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)]
        for q in (1 << b for b in range(bits - 1, 0, -1)):
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[d]) & (q - 1)
                    x[0] ^= t
                    x[d] ^= t
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        t = 0
        for q in (1 << b for b in range(bits - 1, 0, -1)):
            if x[-1] & q:
                t ^= q - 1
        x = [v ^ t for v in x]
        index = 0
        for b in range(bits - 1, -1, -1):
            for v in x:
                index = index << 1 | v >> b & 1
        out.append(index)
    return out


@dataclass(frozen=True)
class Dimension:
    """A metadata column; whole strings are compared."""

    name: str
    value: Column
    is_text: bool = False


def text_cuts(df: DataFrame, value: Column, parts: list[float]) -> list[str]:
    """The smallest strings up to which shares `parts` of the rows that aren't null go.

    Distinct strings are counted first and their counts summed up in ranges of strings, so no task has them all.
    """
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch(counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part")), "text-counts")
    sums = counts.groupBy("part").agg(F.sum("n").alias("_all"))
    # A row for each partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    upto = F.col("_start") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    rows = counts.join(F.broadcast(starts), "part").select("v", upto.alias("upto"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = rows.agg(*[F.min(F.when(F.col("upto") >= total * x, F.col("v"))).alias(f"c{k}") for k, x in enumerate(parts)]).first()
    return [x for x in found if x is not None]


def quantise(df: DataFrame, dimensions: list[Dimension], bits: int) -> list[Column]:
    """A level from 0 to 2**bits - 1 for each dimension, cut at quantiles of all rows; nulls have level 0."""
    parts = [k / (1 << bits) for k in range(1, 1 << bits)]
    values = {d.name: d.value.cast("string" if d.is_text else "double") for d in dimensions}
    numbers = [d.name for d in dimensions if not d.is_text]
    cuts = df.agg(*[F.percentile_approx(values[n], parts, ACCURACY).alias(n) for n in numbers]).first().asDict() if numbers else {}
    cuts |= {d.name: text_cuts(df, values[d.name], parts) for d in dimensions if d.is_text}
    levels = []
    for d in dimensions:
        level = F.lit(0)
        for cut in sorted(set(cuts[d.name] or []), key=lambda x: x.encode() if d.is_text else x):
            level = level + F.when(values[d.name] > F.lit(cut), 1).otherwise(0)
        levels.append(F.coalesce(level, F.lit(0)))
    return levels


def hilbert_rank(df: DataFrame, dimensions: list[Dimension], order: list[str], bits: int = 4, salts: int = SALTS) -> DataFrame:
    """Adds `cell` (place on the curve) and `rank` (from 0, gapless, along the curve) to all rows.

    Rows of one cell are ordered by salt, then `order`. A cell that holds a third of all rows is ranked by `salts` tasks;
    the running sums over cells use one row a cell, at most 2**(bits * dimensions).
    """
    levels, number = quantise(df, dimensions, bits), F.lit(0)
    for level in levels:
        number = number * (1 << bits) + level
    curve = F.lit(hilbert_indices(len(dimensions), bits))
    columns = df.columns
    placed = df.select("*", number.alias("_number"))
    placed = placed.select(*columns, F.get(curve, F.col("_number")).alias("cell"), salt(*order, salts=salts).alias("_salt"))
    ranked = salted_rank(placed, ["cell"], "_salt", order, "_inside")
    starts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("cell").alias("_cell"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # At most 2**(bits * dimensions) rows.
    joined = ranked.join(F.broadcast(starts), F.col("cell") == F.col("_cell"))
    return joined.select(*columns, "cell", (F.col("_start") + F.col("_inside")).cast("long").alias("rank"))


def shards(df: DataFrame, dimensions: list[Dimension], order: list[str], n: int = 8, bits: int = 4) -> DataFrame:
    """Cuts the curve into `n` runs whose row counts are at most one apart; adds `cell`, `shard` and `slot`.

    Every row gets a shard, repeated ones each their own slot. Rows that are equal in `order` may exchange slots. Fewer rows
    than shards leave shards empty; an empty table stays empty.
    """
    ranked, total = hilbert_rank(df, dimensions, order, bits), max(1, df.count())
    shard = F.expr(f"cast((rank * {n}) div {total} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {n - 1}) div {n}")
    return ranked.withColumn("shard", shard).withColumn("slot", (F.col("rank") - first).cast("long")).drop("rank")


def shard_documents(docs: DataFrame, n: int = 8) -> DataFrame:
    """All rows of documents (doc_id, text, source, lang) in `n` shards along the curve of source, language and size.

    A null text has size 1 and no checksum. Texts themselves are never shuffled: their narrow metadata is written to a
    scratch table first, and later steps read that.
    """
    text = F.col("text").cast("string")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    narrow = scratch(narrow, "shard-keys")
    dimensions = [Dimension("source", F.col("source"), True), Dimension("lang", F.col("lang"), True), Dimension("size", F.col("size"))]
    cut = shards(narrow, dimensions, ["doc_id", "size", "text_crc32"], n)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell", "source", "lang")


def write_shards(docs: DataFrame, path: str, n: int = 8) -> None:
    """Writes whole documents as Parquet folders shard=K, in curve order within a shard, for pruning by file statistics.

    Repeated rows (equal doc_id, size and checksum) share a place. A shard is dealt over many tasks by its slots.
    """
    text = F.col("text").cast("string")
    places = shard_documents(docs, n).groupBy("doc_id", "size", "text_crc32").agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    size, crc = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    same = docs["doc_id"].cast("long").eqNullSafe(places["doc_id"]) & size.eqNullSafe(places["size"]) & crc.eqNullSafe(places["text_crc32"])
    placed = docs.join(places, same).select(*[docs[c] for c in docs.columns if c not in ("shard", "slot")], places["shard"], places["slot"])
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
