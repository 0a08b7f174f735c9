"""What several operators share: scratch tables in the cluster's shared folder, salted ranks, text batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sub-ranges into which a rank over one key is split, so that a key with a third of all rows is ranked by many tasks.
SALTS = 64


#: Rows of an Arrow batch for a Python worker, which keeps both ends of the pipe small where texts are long.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH_ROWS in sessions where nobody has chosen another number."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="skein-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = session(df)
    small_batches(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salt(*cols: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_rank(df: DataFrame, keys: list[str], salt_col: str, order: list[str], out: str) -> DataFrame:
    """Adds `out`: the gapless rank from 0 of each row among those with equal `keys`, ordered by salt, then `order`.

    Counts by (keys, salt) aggregate before their shuffle; their running sums use a window over at most as many
    rows a key as there are salts. The ranks themselves use windows by (keys, salt), so no key lands in one task.
    Rows that tie in every column of `order` get their ranks in any order.
    """
    counts = df.groupBy(*keys, salt_col).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(salt_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, salt_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, salt_col).orderBy(*order)
    ranked = df.withColumn("_own", F.row_number().over(own))
    same = None
    for c in [*keys, salt_col]:
        cond = ranked[c].eqNullSafe(starts[c])
        same = cond if same is None else same & cond
    joined = ranked.join(starts, same, "left")
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_own") - 1 + F.col("_before")).cast("long").alias(out))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (one row at least), which bounds a worker's memory."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        sizes = pa.compute.binary_length(batch.column(i)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for k, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += int(n) + 16
        if start < batch.num_rows:
            yield batch.slice(start)


def free_names(taken: list[str], *names: str) -> list[str]:
    """`names`, each with as many underscores after it as it takes to be no name of `taken`, whatever its case."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def bounded_sample(df: DataFrame, rows: int, seed: int, *keys: str) -> DataFrame:
    """About `rows` rows of `df` where it has more, all of them otherwise: those whose hash of `keys` is low.

    The threshold has 63 bits, so a table of any size gives a sample. If the first key alone chooses no row or far too many, as
    where most rows share it, all keys are hashed; rows that are alike in all of them are taken as they come.
    """
    n = df.count()
    if n <= rows:
        return df
    threshold = F.lit(min((1 << 63) - 1, (rows << 63) // n))
    for chosen in {1: keys[:1], len(keys): keys}.values():
        found = df.where(F.shiftrightunsigned(F.xxhash64(*chosen, F.lit(seed)), 1) < threshold)
        if 0 < found.limit(2 * rows + 1).count() <= 2 * rows:
            return found
    return df.limit(rows)


def up_to(df: DataFrame, size: str, most: int) -> DataFrame:
    """The rows of a bounded sample whose sizes in the column `size` sum up to `most` at least or to all of it, by rising `_hash`."""
    table = df.select("_hash", size).toArrow().sort_by("_hash").to_pydict()
    ends, total = table["_hash"], 0
    for end, n in zip(ends, table[size], strict=True):
        total += n
        if total >= most:
            return df.where(F.col("_hash") <= end)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; Python workers on this machine are also told where this package is."""
    small_batches(spark)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop(table: DataFrame) -> None:
    """Deletes a scratch table from which everything has been read that will be."""
    spark = session(table)
    for folder in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark find out which shuffles nothing needs any more, so that their files go."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()
