"""Lines that spread over many sites, found by HyperLogLog sketches, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, scratch

#: A line on so many distinct sites is boilerplate. Shorter lines than this many words are left alone.
SITES, LEAST_WORDS = 5, 3
#: Base-2 logarithm of a sketch's size, and the sketch's relative standard error: 1.04 / sqrt(2**LG_K).
LG_K = 8
ERROR = 1.04 / 2 ** (LG_K / 2)
#: Estimates within so many standard errors of the threshold are counted exactly.
BAND = 4.0
#: Up to so many rows of two numbers are broadcast, about 100 MB in an executor; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Parts into which a hot line's rows are dealt when its table is too large to broadcast.
SALTS = 32


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(doc_id.cast("long"), F.lit(-1)), F.xxhash64(doc_id, text)


def exploded(docs: DataFrame, site: str, least_words: int) -> DataFrame:
    """(h1, h2, site, doc, dh, pos) of every line with at least `least_words` words; h1 and h2 make a key of 128 bits.

    A null site is told from an empty one by the letter before it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a, b = row_key(F.col("doc_id"), text)
    name = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n"))
    lines = docs.select(a.alias("doc"), b.alias("dh"), name.alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    gap = f"(?:[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]+){{{max(0, least_words - 1)}}}[^\\x20\\x09-\\x0D]"
    lines = lines.where(F.col("line").rlike(gap))
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(0x5EED), "line").alias("h2"), "site", "doc", "dh", F.col("pos").cast("int").alias("pos"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2, doc, dh, pos): the lines on at least `sites` distinct sites, with the first place of each.

    Sketches of sites merge by aggregation, so a line on a third of all rows costs a sketch a task. Only lines whose
    estimate is near the threshold get an exact distinct count, from their (line, site) pairs.
    """
    sketch = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "dh", "pos")).alias("first"))
    margin = BAND * ERROR * sites
    estimate = F.hll_sketch_estimate("sketch")
    spread = sketch.where(F.col("n") >= sites).select("h1", "h2", "first", estimate.cast("double").alias("estimate")).where(F.col("estimate") >= sites - margin)
    spread = scratch(spread, "spread-lines")
    near = spread.where(F.col("estimate") <= sites + margin)
    far = spread.where(F.col("estimate") > sites + margin)
    few = near.count()
    keys = near.select("h1", "h2")
    keys = F.broadcast(keys) if few <= BROADCAST_ROWS else keys
    exact = lines.select("h1", "h2", "site").join(keys, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= sites)
    near = near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return far.unionByName(near).select("h1", "h2", "first.*")


def clean(docs: DataFrame, site: str = "source", sites: int = SITES, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows of `docs` with `text` freed of boilerplate, and n_lines and n_removed; if `docs` has columns of these names
    itself, those stay as they are and the new ones get underscores after their names.

    Of a line on at least `sites` distinct sites, the first occurrence (by doc_id, then line) stays and all others go,
    those in the same document included. A null site is a site of its own; a null text has no lines and stays null.
    Repeated rows are alike: either all of them or none hold the first occurrence. Lines with fewer than `least_words`
    words stay.
    """
    columns = docs.columns
    lines = exploded(docs, site, least_words)
    spread = scratch(boilerplate(lines, sites), "boilerplate")
    found = spread.select("h1", "h2", F.col("doc").alias("_doc"), F.col("dh").alias("_dh"), F.col("pos").alias("_pos"))
    narrow = lines.drop("site")
    if spread.count() <= BROADCAST_ROWS:
        hits = narrow.join(F.broadcast(found), ["h1", "h2"])
    else:
        dealt = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = narrow.withColumn("_salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)).cast("int")).join(dealt, ["h1", "h2", "_salt"])
    first = (F.col("doc") == F.col("_doc")) & (F.col("dh") == F.col("_dh")) & (F.col("pos") == F.col("_pos"))
    key, other, gone_at, split_at, n_lines, n_removed = free_names(columns, "_doc", "_hash", "_gone", "_split", "n_lines", "n_removed")
    gone = hits.where(~first).groupBy("doc", "dh").agg(F.collect_set("pos").alias(gone_at))
    gone = scratch(gone.select(F.col("doc").alias(key), F.col("dh").alias(other), gone_at), "gone-lines")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a, b = row_key(F.col("doc_id"), text)
    # One row for each document that loses lines, so never broadcast.
    joined = docs.join(gone.hint("merge"), (a == F.col(key)) & (b == F.col(other)), "left")
    joined = joined.select(*columns, gone_at, F.split(F.col("text").cast("string"), "\n").alias(split_at))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(split_at))
    # Places left are those of all lines without the removed ones, by hashing; a line is then read by its place.
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col(gone_at))
    lines_left = F.array_join(F.transform(left, lambda i: F.get(F.col(split_at), i)), "\n")
    kept = F.when(F.col(gone_at).isNull(), F.col("text")).when(F.size(gone_at) == n, F.lit("")).otherwise(lines_left)
    removed = F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at))
    return joined.select(*[kept.alias(c) if c == "text" else F.col(c) for c in columns], n.cast("long").alias(n_lines), removed.cast("long").alias(n_removed))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS site, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, site, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
k AS (SELECT * FROM l WHERE regexp_matches(line, '(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{LEAST_WORDS - 1}}}[^\x20\x09-\x0D]')),
spread AS (SELECT line, min((doc_id, pos)) AS first FROM k GROUP BY line HAVING count(DISTINCT site) >= {SITES}),
m AS (SELECT l.*, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone FROM l LEFT JOIN spread s USING (line))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM m GROUP BY doc_id
"""
