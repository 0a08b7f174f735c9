import json
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.functions import ids, text
from skein.operators import classify, graph, qos, quality, retrieval, sampling, tasks, trajectory
from skein.plans import oracle
from skein.plans.queries import QUERIES
from skein.sources import files
from skein.streaming import calls

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    found, want = QUERIES[name](spark, sf).toPandas(), duck.sql(oracle.SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert plain(found) == plain(want)


def test_names(spark):
    for raw, want in (("Get  the-Weather!", "get_the_weather"), ("3day", "get_3day"), ("__a__", "a"), ("天气 Now", "天气_now"), (None, ""), ("a^b", "a_b")):
        assert one(spark, ids.standardize(F.lit(raw).cast("string"))) == want
    assert one(spark, ids.standardize(F.lit("a^b"), keep_caret=True)) == "a^b"
    assert one(spark, ids.standardize(F.lit("3day"), digit_prefix=False)) == "3day"
    assert one(spark, ids.api_id(F.lit("Data, x / y"), F.lit("My Tool"), F.lit("id"))) == "Data_x_y/my_tool/is_id"
    tool, api = ids.runtime_names(F.lit("Sports"), F.lit("scores"), F.lit("latest_for_scores"))
    assert (one(spark, tool), one(spark, api)) == ("scores_for_Sports", "latest")
    assert one(spark, ids.pair_id(F.lit("a"), F.lit("b"))) == one(spark, ids.pair_id(F.lit("b"), F.lit("a")))


def test_text_functions(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))
    assert one(spark, text.jaccard(a, b)) == 0.5 and one(spark, text.containment(a, b)) == 1.0
    empty = F.array().cast("array<string>")
    assert one(spark, text.jaccard(empty, empty)) == 0.0 and one(spark, text.containment(empty, empty)) == 0.0
    assert one(spark, text.strip_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.strip_fence(F.lit(' {"a": 1} '))) == '{"a": 1}'
    assert one(spark, tasks.canonical_input(F.lit('{"b": 1, "a": [1, 2]}'))) == '{"a":[1,2],"b":1}'
    assert one(spark, tasks.canonical_input(F.lit("not json"))) == "not json"
    parts = one(spark, text.react_parts(F.lit("Thought: go on\nAction: find\nAction Input: {}")))
    assert tuple(parts) == ("go on", "find", "{}")


def test_responses(spark):
    for response, label, status, keep in (("Too many requests", "Too many requests error...", 9, True), ("unauthorized", "Unauthorized error...", 7, False), ("all good", "", 0, True), ("some error", "Message error...", 11, True), ("got an unexpected keyword argument, error 404", "Message error...", 11, True), ("", "", 0, False)):
        e = one(spark, classify.classify_error(F.lit(response)))
        assert e["error"] == label and one(spark, classify.status_code(F.lit(label))) == status
        assert one(spark, classify.acceptable(F.lit(response))) == keep
    timed = "The request to the API has timed out. Please try again later, or if the issue persists, error"
    assert one(spark, classify.classify_error(F.lit(timed)))["error"] == "API temporarily not working error..."


def test_graph(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "id string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d"), ("f", "f")], "left_id string, right_id string")
    labels = graph.components(nodes, edges)
    assert {r.id: r.root for r in labels.collect()} == dict(zip("abcdefg", "aaaddfg", strict=True))
    assert {(r.member_count, r.n_clusters) for r in graph.cluster_statistics(labels).collect()} == {(3, 1), (2, 1), (1, 2)}
    said = [("1", "a", "d", "contains", "left_contains_right"), ("2", "f", "e", "contains", "right_contains_left"), ("3", "g", "c", "different_capability", "none"), ("4", "a", "c", "contains", "left_contains_right"), ("5", "f", "b", "contains", "left_contains_right")]
    projected = graph.project(spark.createDataFrame(said, "decision_id string, left_id string, right_id string, relation string, direction string"), labels)
    found = graph.cluster_edges(projected)
    assert {(r.relation, r.source_root, r.target_root) for r in found.collect()} == {("contains", "a", "d"), ("contains", "d", "f"), ("different_capability", "a", "g"), ("contains", "f", "a")}
    assert {(r.issue_type, r.key) for r in graph.diagnostics(projected, found).collect()} == {("relation_inside_interchangeable_cluster", "4"), *{("contains_cycle", k) for k in "adf"}}
    pairs = spark.createDataFrame([("a", "c"), ("g", "a"), ("a", "f"), ("g", "d")], "left_id string, right_id string")
    inferred = {(r.left_id, r.right_id): (r.inferred_relation, r.rule) for r in graph.infer(pairs, labels, found).collect()}
    assert inferred == {("a", "c"): ("interchangeable", "interchangeable_component"), ("g", "a"): ("different_capability", "cluster_different_propagation"), ("a", "f"): ("contains", "transitive_cluster_contains"), ("g", "d"): (None, None)}


def test_closure_reaches_the_end_of_long_chains_and_cycles(spark):
    n = 150
    chain = spark.range(n - 1).selectExpr("id AS source", "id + 1 AS target")
    found = {(r.source, r.target): r.depth for r in graph.closure(chain).collect()}
    assert found == {(a, b): b - a for a in range(n) for b in range(a + 1, n)}
    ring = spark.range(n).selectExpr("id AS source", f"(id + 1) % {n} AS target")
    found = {(r.source, r.target): r.depth for r in graph.closure(ring).collect()}
    assert found == {(a, b): (b - a) % n or n for a in range(n) for b in range(n)}
    short = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (0, 3), (4, 4), (4, 1)], "source int, target int")
    assert {(r.source, r.target): r.depth for r in graph.closure(short).collect()} == {(0, 1): 1, (0, 2): 2, (0, 3): 1, (0, 4): 2, (1, 1): 4, (1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 1): 3, (2, 2): 4, (2, 3): 1, (2, 4): 2, (3, 1): 2, (3, 2): 3, (3, 3): 4, (3, 4): 1, (4, 1): 1, (4, 2): 2, (4, 3): 3, (4, 4): 1}
    assert graph.closure(chain.limit(0)).count() == 0


def test_inference_and_diagnostics_of_150_clusters(spark):
    n = 150
    labels = spark.range(n).selectExpr("id", "id AS root")
    ring = spark.range(n).selectExpr("'contains' AS relation", "id AS source_root", f"(id + 1) % {n} AS target_root")
    pairs = spark.createDataFrame([(0, n - 1), (n - 1, 0)], "left_id long, right_id long")
    inferred = {(r.left_id, r.right_id): (r.inferred_relation, r.inferred_direction, r.rule) for r in graph.infer(pairs, labels, ring.where(f"source_root < {n - 1}")).collect()}
    assert inferred == {(0, n - 1): ("contains", "left_contains_right", "transitive_cluster_contains"), (n - 1, 0): ("contains", "right_contains_left", "transitive_cluster_contains")}
    none = spark.createDataFrame([], "decision_id string, left_id long, right_id long, relation string, direction string")
    issues = {(r.issue_type, r.key) for r in graph.diagnostics(graph.project(none, labels), ring).collect()}
    assert issues == {("contains_cycle", str(k)) for k in range(n)}


def test_depths_of_long_chains_and_cycles(spark):
    n = 17_000
    nodes = spark.range(n).selectExpr("'t' AS task_id", "id AS node_id", "nullif(id - 1, -1) AS parent_id")
    row = trajectory.depths(nodes).agg(F.max("depth"), F.sum("depth"), F.max("root_id")).first()
    assert tuple(row) == (n - 1, n * (n - 1) // 2, 0)
    ring = spark.createDataFrame([("t", 0, 2), ("t", 1, 0), ("t", 2, 1)], "task_id string, node_id int, parent_id int")
    with pytest.raises(ValueError, match="cycle"):
        trajectory.depths(ring)


def test_quality_edges(spark):
    rows = spark.createDataFrame([(0.85, "a"), (1.00000005, "a"), (-0.1, "a"), (None, "b")], "score double, relation string")
    assert {(r.low, r.n) for r in quality.histogram(rows, "score", "relation", ["a"]).collect()} == {(0.85, 1), (0.95, 1)}
    assert quality.quartile_edges(rows.where("score = 0.85"), "score") == [0.85, 0.85 + 1e-9]
    got = {r.relation: (r.n, r.missing, r.upper_median) for r in quality.upper_median(rows, "score", "relation").collect()}
    assert got == {"a": (3, 0, 0.85), "b": (0, 1, None)}
    assert quality.threshold_for_recall(rows, "score", F.lit(True), [0.5]).first()["threshold"] == 0.85
    assert quality.numeric_summary(rows.limit(0), "score").first()["mean"] is None


def test_qos_invariants(spark):
    donors = qos.donor_pool(spark.createDataFrame([(1, "t", 90.0, 80.0, 250.0), (2, "t", 1.0, 1.0, 1.0), (3, "u", 50.0, 50.0, 10.0), (4, "v", None, 1.0, 1.0)], "api_id long, tool_id string, service_level double, success_rate double, latency_ms double"))
    assert [r.api_id for r in donors.orderBy("idx").collect()] == [1, 3]
    targets = spark.range(500).selectExpr("id AS api_id", "CASE WHEN id % 2 = 0 THEN 't' ELSE 'new' END AS tool_id")
    given = qos.assign_donors(targets, donors, 7).collect()
    assert len(given) == 500 and all(r.donor_tool_id == "u" for r in given if r.tool_id == "t") and len({r.donor_tool_id for r in given if r.tool_id == "new"}) == 2
    alone = qos.assign_donors(targets.limit(10), donors.where("idx = 0"), 7).collect()
    assert {r.donor_api_id for r in alone} == {1}
    profile = lambda sigma: spark.createDataFrame([(0, 0.72, 250.0, 0.001, sigma)], "api_id long, success_rate double, expected_latency_ms double, cost_units double, latency_log_sigma double")
    made = spark.range(40_000).selectExpr("0L AS api_id", "id AS call_index")
    wide, none = (qos.simulate(made, profile(s), 42) for s in (0.3, 0.0))
    row = wide.agg(F.avg("latency_ms"), F.avg(F.col("succeeded").cast("int"))).first()
    assert abs(row[0] - 250) < 3 and abs(row[1] - 0.72) < 0.01
    assert none.select("latency_ms").distinct().collect()[0][0] == 250.0
    assert wide.select("call_index", "succeeded").exceptAll(none.select("call_index", "succeeded")).count() == 0
    missing = qos.simulate(spark.createDataFrame([(9, 0)], "api_id long, call_index long"), profile(0.1), 42).first()
    assert (missing.profile_found, missing.succeeded, missing.latency_ms, missing.cost_units) == (False, False, None, 0.0)


def test_dense_blocks_agree(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(90)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    small, large = (sorted(retrieval.dense_topk(vectors, k=4, block=b).collect()) for b in (2, 1000))
    assert small == large and len(small) == 360


def test_samples(spark):
    df = spark.createDataFrame([(f"p{k}", "ab"[k > 3]) for k in range(40)], "key string, s string")
    got = sampling.stratified_sample(df, "s", "key", 20, 1)
    assert {(r.s, r["count"]) for r in got.groupBy("s").count().collect()} == {("a", 4), ("b", 16)}
    assert sampling.stratified_sample(df, "s", "key", 20, 1).exceptAll(got).count() == 0
    assert sampling.stratified_sample(df.limit(0), "s", "key", 20, 1).count() == 0
    events = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, None)], "key string, seq int, value string")
    assert {(r.key, r.value) for r in sampling.latest_by(events, ["key"], ["seq"]).collect()} == {("k", "new"), ("j", None)}


def test_trees(spark):
    chain = spark.createDataFrame([("t", k, k - 1 if k else None) for k in range(40)], "task_id string, node_id long, parent_id long")
    assert tuple(trajectory.tree_metrics(chain).first()) == ("t", 40, 39, 1, 1)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nbroken\n{"x": 2}\n')
    assert files.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int", bad_lines="drop").select("x").collect() == [(1,), (2,)]
    kept = files.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int", bad_lines="keep").cache()
    assert kept.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int").collect()
    assert files.read_jsonl(spark, f"{tmp_path}/none.jsonl", "x int", missing_ok=True).count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{tmp_path}/none.jsonl", "x int").collect()
    os.makedirs(tmp_path / "tools/Sports")
    tool = {"tool_name": "My Scores", "pricing": " ", "score": {"avgLatency": 5}, "api_list": [{"name": "id", "description": "d", "method": "get"}, {"name": "2nd", "description": " "}]}
    for name, body in (("ok", json.dumps(tool)), ("bad", "{"), ("list", "[1]"), ("odd", '{"api_list": 3}')):
        (tmp_path / f"tools/Sports/{name}.json").write_text(body)
    docs, errors = files.read_tool_docs(spark, f"{tmp_path}/tools/*/*.json")
    assert {r.reason for r in errors.collect()} == {"invalid_json", "not_an_object", "api_list_not_a_list"}
    rows = {r.api_id: r for r in files.catalog(docs).collect()}
    assert set(rows) == {"Sports/my_scores/is_id", "Sports/my_scores/get_2nd"} and rows["Sports/my_scores/is_id"].method == "GET" and rows["Sports/my_scores/is_id"].pricing == "UNKNOWN"
    reasons = {r[0] for r in files.catalog(docs).select(files.candidate_reason(F.lit(True))).collect()}
    assert reasons == {"incomplete_qos", "missing_api_description"}
    files.write_jsonl(docs.select("category", "file"), f"{tmp_path}/out")
    files.write_jsonl(docs.select("category", "file"), f"{tmp_path}/out", append=True)
    assert files.read_jsonl(spark, f"{tmp_path}/out", "category string, file string").count() == 2 * docs.count()
    assert files.markdown_table(docs.select("category")).startswith("| category |\n| --- |\n| Sports |")


def test_stream_counts_across_batches(spark, tmp_path):
    schema, made = "api_id string, seq long", []
    for k in range(3):
        spark.createDataFrame([("a", 2 * k), ("a", 2 * k + 1), ("b", k)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        made = calls.run_available(spark, calls.number_calls(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.api_id, r.seq, r.call_index) for r in made.collect()) == [*[("a", k, k) for k in range(6)], *[("b", k, k) for k in range(3)]]
