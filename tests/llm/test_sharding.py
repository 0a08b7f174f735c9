import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skein.llm import sharding as s


def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        place = s.hilbert_indices(dims, bits)
        assert sorted(place) == list(range(1 << dims * bits))
        at = {i: [cell >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)] for cell, i in enumerate(place)}
        assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(place) - 1))


def check(rows, texts, n=8):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    counts = [len(by[k]) for k in range(n)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(n))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    found = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert found == Counter((d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for d, t in texts)
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = s.shard_documents(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    # Runs follow the curve: later shards never hold an earlier cell.
    last = -1
    for k in range(8):
        cells = [r.cell for r in rows if r.shard == k]
        assert min(cells) >= last
        last = max(cells)
    assert len({r.source for r in rows if r.shard == 0}) < len({r.source for r in rows})


def test_edges(spark):
    rows = [(1, "é", "a", "x"), (2, None, None, None), (None, "", "a", "y"), (1, "é", "a", "x"), (5, "w " * 9999, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "doc_id AS cell", "text AS shard", "doc_id AS size")
    check(s.shard_documents(docs).collect(), [r[:2] for r in rows])
    hot = docs.limit(1).crossJoin(spark.range(1000).select(F.col("id").alias("n"))).drop("n")
    check(s.shard_documents(hot).collect(), [rows[0][:2]] * 1000)
    assert s.shard_documents(docs.limit(0)).count() == 0


def test_written_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s.write_shards(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8
    assert {r.doc_id for r in back.collect()} == {r.doc_id for r in docs.collect()}


def test_sources_that_begin_alike_have_levels_of_their_own(spark):
    sources = ["archive.org", *[f"https://www.site{k}.org" for k in range(7)], None]
    df = spark.createDataFrame([(x,) for x in sources for _ in range(20)], "source string")
    level = s.quantise(df, [s.Dimension("source", F.col("source"), True)], 4)[0]
    found = {r.source: r.level for r in df.select("source", level.alias("level")).distinct().collect()}
    assert len(set(found.values())) == 8 and found[None] == 0
    assert [found[x] for x in sorted(sources[:-1])] == sorted(found[x] for x in sources[:-1])
