import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import quality, retrieval, reviews, vectorblocks
from skein.plans import more, queries


def brute(rows, k, digits=6):
    """(source, neighbor, score) by comparing everything; rows: id, vec, grp, tag."""
    x = np.array([v for _, v, _, _ in rows])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s, out = np.round(u @ u.T, digits) + 0.0, set()
    for i, (a, _, g, t) in enumerate(rows):
        near = sorted((-s[i, j], b) for j, (b, _, h, w) in enumerate(rows) if a != b and g == h and (t is None or t != w))
        out |= {(a, b, -score) for score, b in near[:k]}
    return out


@pytest.mark.parametrize("shape", [(1024, 512, 16), (16, 8, 1), (32, 24, 1)])
def test_search_of_groups_tags_and_copies_is_exact(spark, monkeypatch, shape):
    for name, value in zip(("ROWS", "COLUMNS", "MANY"), shape, strict=True):
        monkeypatch.setattr(vectorblocks, name, value)
    r = np.random.default_rng(shape[0])
    x = r.standard_normal((160, 6)).astype("f4").astype("f8")
    x[r.integers(0, 160, 60)], x[3] = x[0], 0
    rows = [(int(i), v.tolist(), "gh"[int(g)], None if t == 0 else str(t)) for i, v, g, t in zip(r.permutation(900), x, r.integers(0, 2, 160), r.integers(0, 3, 160), strict=False)]
    for kind in ("float", "double"):
        df = spark.createDataFrame([*rows, (None, rows[0][1], "g", None), (901, None, "g", None)], f"id long, vec array<{kind}>, grp string, tag string")
        found = retrieval.dense_topk(df, k=5, group=F.col("grp"), exclude=F.col("tag"), block=24).collect()
        assert {(x.source, x.neighbor, x.score) for x in found} == brute(rows, 5)
        assert len(found) == len({(x.source, x.rank) for x in found})
        whole = retrieval.dense_topk(df, k=5, block=50).collect()
        assert {(x.source, x.neighbor, x.score) for x in whole} == brute([(i, v, "", None) for i, v, _, _ in rows], 5)


def test_vectors_of_one_group_are_searched_by_many_tasks(spark):
    df = spark.range(400).selectExpr("id", "array(sin(id), cos(id), sin(3 * id)) AS vec")
    found = retrieval.dense_topk(df, k=2, block=50)
    assert found.count() == 800 and "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def counted(spark, df, total):
    """`df`, which adds the rows that are read of it to `total`."""

    def pass_on(batches):
        for b in batches:
            total.add(b.num_rows)
            yield b

    return df.mapInArrow(pass_on, df.schema)


@pytest.mark.parametrize("name", ["threshold_recall", "cluster_support", "score_by_relation_upper_median", "pool_statistics", "unordered_pair_regression", "review_queue", "infer_relations", "confidence_exact"])
def test_neighbours_are_searched_once(spark, sf, monkeypatch, name):
    total, search = spark.sparkContext.accumulator(0), retrieval.dense_topk
    monkeypatch.setattr(retrieval, "dense_topk", lambda *a, **b: counted(spark, search(*a, **b), total))
    (queries.QUERIES | more.QUERIES)[name](spark, sf).collect()
    assert total.value == spark.read.parquet(f"{sf}/embeddings.parquet").count() * (30 if name == "pool_statistics" else 10)


def test_summaries_read_their_rows_once(spark):
    total = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(k % 10 / 10, "ab"[k % 2]) for k in range(40)] + [(None, "a")] * 3, "score double, kind string")
    median = {r.kind: tuple(r)[1:] for r in quality.upper_median(counted(spark, rows, total), "score", "kind").collect()}
    assert median == {"a": (20, 3, 0.0, 0.8, 0.4), "b": (20, 0, 0.1, 0.9, 0.5)} and total.value == 43
    found = {r.target: r.threshold for r in quality.threshold_for_recall(counted(spark, rows, total), "score", F.lit(True), [0.9, 0.5, 1.0]).collect()}
    assert found == {0.9: 0.0, 0.5: 0.4} and total.value == 86
    pool = spark.createDataFrame([("p", "bm25"), ("p", "dense"), ("q", "dense"), ("q", "dense")], "pair_id string, method string")
    assert {tuple(r) for r in reviews.pool_statistics(counted(spark, pool, total)).collect()} == {("bm25", 1), ("dense", 2), ("several", 1)} and total.value == 90
    assert {tuple(r) for r in reviews.pool_statistics(pool.where("pair_id = 'q'")).collect()} == {("dense", 1), ("several", 0)}
