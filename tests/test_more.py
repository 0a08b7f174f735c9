import json

import pytest
from pyspark.sql import functions as F

from skein.operators import catalog, graph, requests, reviews, sampling, tasks, trajectory
from skein.plans.more import QUERIES, SQL
from skein.sources import files
from tests.test_reference import duck, one, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):  # noqa: F811
    found, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert plain(found) == plain(want)


def test_unique_and_known_keys_or_an_error(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, name string")
    with pytest.raises(ValueError, match="'id': 2"):
        catalog.require_unique(rows, "id")
    assert catalog.require_unique(rows, "name").count() == 3
    with pytest.raises(ValueError, match="id 2"):
        catalog.require_known(rows, "id", rows.where("id = 1"), "id")
    assert catalog.require_known(rows, "id", rows, "id").count() == 3


def test_booleans(spark):
    for word, want in (("TRUE", True), (" on ", True), ("0", False), ("No", False), ("perhaps", None), (None, None)):
        assert one(spark, requests.parse_bool(F.lit(word).cast("string"))) is want
    with pytest.raises(Exception, match="flag is no boolean: perhaps"):
        one(spark, requests.require_bool(F.lit("perhaps"), "flag"))
    assert one(spark, requests.require_bool(F.lit("yes"), "flag")) is True


def test_only_what_passes_the_gate_is_generated(spark):
    calls = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, False)], "id long, profile_found boolean, succeeded boolean")
    answer = F.when(F.col("id") == 1, "fine").otherwise(F.raise_error(F.lit("generated")).cast("string"))
    by_column = {r.id: (r.error, r.response) for r in requests.resolve(requests.gate(calls), answer).collect()}
    by_rows = {r.id: (r.error, r.response) for r in requests.resolve(requests.gate(calls), lambda x: x.withColumn("response", answer)).collect()}
    assert by_column == by_rows == {1: ("", "fine"), 2: ("Simulated service failure", None), 3: ("No service profile for this API", None)}
    assert requests.gate(calls, enabled=False).where("generate").count() == 3


def test_cache_probe(spark):
    for text, want in ((None, (False, 0, None)), ("{}", (True, 0, None)), ('{"a": 1, "b": 2}', (True, 2, None)), ("[1]", (True, 0, "root is no object")), ("{", (True, 0, "invalid JSON"))):
        assert tuple(one(spark, catalog.cache_probe(F.lit(text).cast("string")))) == want


def test_query_files(spark, tmp_path):
    api = lambda name, text: {"category_name": "Data", "tool_name": "Tool", "api_name": name, "api_description": text}
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text(json.dumps([{"query_id": 1, "api_list": [api("One", "short"), api("Two", "x")]}, "no object", 7]))
    (tmp_path / "deep" / "b.json").write_text(json.dumps([{"query_id": "q", "api_list": [api("One", "a longer text")]}, {"query_id": 3}]))
    (tmp_path / "c.json").write_text(json.dumps({"query_id": 1}))
    (tmp_path / "d.json").write_text("not JSON")
    found = files.read_queries(spark, str(tmp_path))
    assert found.count() == 3
    apis = {r.api_id: json.loads(r.descriptor) for r in files.query_endpoints(found).collect()}
    assert set(apis) == {"Data/tool/one", "Data/tool/two"} and apis["Data/tool/one"]["api_description"] == "a longer text"


def test_settings():
    assert files.setting("port", {"PORT": "1"}, {"port": "2"}) == "1"
    assert files.setting("port", {"PORT": ""}, {"port": "2"}) == "2"
    assert files.setting("port", {}, {}, "3") == "3" and files.setting("port", {}, {}) is None


def test_shortest_paths_with_ties_and_cycles(spark):
    edges = [("a", "b", "d2"), ("a", "c", "d1"), ("b", "z", "d0"), ("c", "z", "d9"), ("z", "a", "d5"), ("a", "q", "d3"), ("q", "r", "d4"), ("r", "z", "d6")]
    pairs = [("p1", "a", "z"), ("p2", "z", "r"), ("p3", "b", "b"), ("p4", "z", "nowhere")]
    found = graph.supporting_paths(spark.createDataFrame(pairs, "pair_id string, source string, target string"), spark.createDataFrame(edges, "source string, target string, decision_id string"))
    assert {r.pair_id: r.path for r in found.collect()} == {"p1": ["d1", "d9"], "p2": ["d5", "d3", "d4"], "p3": []}


def test_paths_of_many_pairs_from_one_source_hold_each_node_once(spark, monkeypatch):
    rows, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (made := cut(df), rows.append(made.count()))[0])
    edges = spark.range(200).selectExpr("'hub' AS source", "'leaf' || id AS target", "'d' || id AS decision_id").union(spark.sql("SELECT 'top', 'hub', 'up'"))
    pairs = spark.range(200).selectExpr("id AS pair_id", "'top' AS source", "'leaf' || id AS target")
    found = {r.pair_id: r.path for r in graph.supporting_paths(pairs, edges).collect()}
    assert found == {k: ["up", f"d{k}"] for k in range(200)}
    assert sum(rows) < 1000


def test_paths_longer_than_the_tables_of_a_search(spark):
    n = 2 * graph.SEEN_TABLES + 3
    edges = spark.range(n).selectExpr("id AS source", "id + 1 AS target", "id AS decision_id").union(spark.range(1, n).selectExpr("id", "id - 1", "-id"))
    pairs = spark.createDataFrame([(1, 0, n), (1, 0, n), (2, 0, 1), (3, n, 0), (4, None, 1), (5, 1, None)], "pair_id long, source long, target long")
    found = sorted((r.pair_id, r.path) for r in graph.supporting_paths(pairs, edges).collect())
    assert found == [(1, [str(k) for k in range(n)])] * 2 + [(2, ["0"])]


def test_expansion_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(tasks, "MEMBERS", 3)
    members = [("a", k) for k in range(10)] + [("a", 3), ("a", None), ("b", 3), ("b", 50), ("c", 60), (None, 1), (None, 2)]
    used = [(1, 3), (1, 3), (1, 4), (2, 50), (2, 60), (3, None), (4, 99), (None, 50)]
    found = tasks.expand_by_cluster(spark.createDataFrame(used, "task_id long, api_id long"), spark.createDataFrame(members, "cluster_id string, api_id long"))
    want = [(1, "a", k) for k in (0, 1, 2, 5, 6, 7, 8, 9, None)] + [(1, "b", 50), (2, "b", 3), (None, "b", 3), (None, "b", 50)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    # The expansion is the last step: no exchange stands above it.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_long_chains_and_cycles_of_parents(spark):
    chain = spark.range(300).selectExpr("1L AS task_id", "id AS node_id", "nullif(id - 1, -1) AS parent_id")
    assert trajectory.ancestors(chain).where("node_id = 299").count() == 300
    cycle = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 2, 1)], "task_id long, node_id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        trajectory.ancestors(cycle)


def test_reviews_keep_the_last(spark):
    log = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, "c")], "pair_id string, seq int, verdict string")
    found = {r.pair_id: (r.verdict, r.matched) for r in reviews.match_queue(log, spark.createDataFrame([("p",), ("p",)], "pair_id string"), "pair_id", "seq").collect()}
    assert found == {"p": ("b", True), "q": ("c", False)}
    assert sampling.latest_by(log, ["pair_id"], ["seq"]).count() == 2
