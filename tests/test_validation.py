import json

import pytest
from pyspark.sql import functions as F

from skein.operators import validation as v

GOOD = {"relation": "contains", "direction": "left_contains_right", "confidence": 0.5, "reasoning": "r", "evidence": [], "needs_human_review": False, "more": 1}


@pytest.mark.parametrize(
    ("change", "reason"),
    [({}, None), ({"relation": "same"}, "unknown_relation"), ({"direction": None}, "unknown_direction"), ({"direction": "none"}, "contains_requires_direction"), ({"relation": "interchangeable"}, "direction_must_be_none"), ({"confidence": True}, "confidence_not_a_number"), ({"confidence": "0.5"}, "confidence_not_a_number"), ({"confidence": 1.5}, "confidence_out_of_range"), ({"confidence": 1}, None), ({"reasoning": " "}, "empty_reasoning"), ({"reasoning": 5}, "empty_reasoning"), ({"evidence": "x"}, "evidence_not_a_list"), ({"needs_human_review": 1}, "review_flag_not_boolean")],
)
def test_annotation_rules(spark, change, reason):
    text = f"```json\n{json.dumps(GOOD | change)}\n```"
    assert spark.range(1).select(v.annotation_error(F.lit(text)).alias("x")).first()[0] == reason


def test_annotations_split(spark):
    rows = spark.createDataFrame([("a", json.dumps(GOOD)), ("b", "[1]"), ("c", "nothing"), ("d", None)], "pair_id string, output string")
    good, bad = v.annotations(rows)
    assert [(r.pair_id, r.annotation.relation, r.annotation.confidence) for r in good.collect()] == [("a", "contains", 0.5)]
    assert {(r.pair_id, r.error) for r in bad.collect()} == {(k, "not_an_object") for k in "bcd"}


def test_profiles(spark):
    rows = [(0.7, None, 1.0, 0.0, 0.1, "lognormal", None), (None, 0.7, 1.0, 0.0, 0.1, "lognormal", None), (None, None, 1.0, 0.0, 0.1, "lognormal", "missing_success_rate"), (1.1, None, 1.0, 0.0, 0.1, "lognormal", "invalid_success_rate"), (0.5, None, 1.0, -1.0, 0.1, "lognormal", "invalid_cost"), (0.5, None, 1.0, float("inf"), 0.1, "lognormal", "invalid_cost"), (0.5, None, 1.0, 0.0, 0.1, "gamma", "unsupported_distribution")]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", v.profile_error(*[F.col(x) for x in "abcdef"])).collect())


def test_config():
    good = {
        "empirical_bootstrap": {"success_rate": {"formula": "service_level_times_success_rate", "min": 0, "max": 1}, "expected_latency_ms": {"field": "avgLatency", "min": 1, "max": 300}},
        "synthetic": {"cost_per_call_units": {"distribution": "lognormal", "median": 0.1, "log_sigma": 1, "min": 0, "max": 1}, "latency_log_sigma": {"distribution": "uniform", "min": 0.1, "max": 0.1}},
        "scenarios": {n: {"success_rate_factor": 0, "latency_factor": 1, "cost_factor": 0} for n in ("normal", "degraded", "outage")},
    }
    assert v.config_errors(good) == []
    for path, value in (("empirical_bootstrap.success_rate.max", 2), ("empirical_bootstrap.expected_latency_ms.min", 0), ("synthetic.cost_per_call_units.median", True), ("scenarios.normal.latency_factor", 0), ("scenarios.extra", {})):
        bad = json.loads(json.dumps(good))
        *heads, last = path.split(".")
        inner = bad
        for h in heads:
            inner = inner[h]
        inner[last] = value
        assert v.config_errors(bad), path
    assert len(v.config_errors({})) > 5


def test_cases(spark):
    expected = spark.createDataFrame([(p, p, "contains", "left_contains_right") for p in "abcd"], "pair_id string, case string, relation string, direction string")
    got = spark.createDataFrame([("a", "contains", "left_contains_right"), ("b", "contains", "right_contains_left")], "pair_id string, relation string, direction string")
    errors = spark.createDataFrame([("c", 1, "first"), ("c", 2, "last"), ("a", 1, "old")], "pair_id string, seq int, error string")
    assert {(r.pair_id, r.status, r.detail) for r in v.evaluate_cases(expected, got, errors).collect()} == {("a", "PASS", None), ("b", "FAIL", None), ("c", "ERROR", "last"), ("d", "MISSING", None)}


def test_function_schema(spark):
    kind = "array<struct<name:string,type:string,description:string,default:string>>"
    df = spark.createDataFrame([("id", "tool", "about id ", [("Page No", "NUMBER", "d", "3")], [("x", "DATE", "e", "")]), ("n" * 80, "tool", " ", None, None)], f"api string, tool string, d string, r {kind}, o {kind}")
    one, two = (r.s for r in df.select(v.function_schema(F.col("api"), F.col("tool"), F.col("d"), F.col("r"), F.col("o")).alias("s")).collect())
    assert one.name == "is_id_for_tool" and one.description.endswith('The description of this function is: "about is_id_for_tool"')
    assert [tuple(p) for p in one.properties] == [("page_no", "integer", "d", "3"), ("x", "string", "e", None)] and (one.required, one.optional) == (["page_no"], ["x"])
    assert len(two.name) == 64 and two.name.endswith("_for_tool") and two.properties == [] and "The description" not in two.description


def test_examples(spark):
    items = [{"input": {"City Name": "a", "api_key": "x", "deep": [{"Token": 1}]}, "response": 1}, {"input": {"city_name": "a", "API Key": "other", "deep": [{"Token": 2}]}, "response": 2}, {"input": 5, "response": 1}, {"input": {"q": 1}, "response": 1}, {"input": {"city_name": "b"}}, {"input": {"city_name": "old"}, "response": 1}, {"input": {"city_name": "c"}, "response": None}, {"input": {"city_name": "d"}, "response": [1]}, {"input": {"city_name": "e"}, "response": "x"}]
    outputs = spark.createDataFrame([("api", "```json\n" + json.dumps({"examples": items}) + "\n```", ["City Name"]), ("none", "{}", [])], "api_id string, output string, required array<string>")
    known = spark.createDataFrame([("api", '{"city_name":"old"}')], "api_id string, key string")
    good, bad = v.examples(outputs, known, limit=3)
    accepted = {r["index"]: (json.loads(r.key), r.response) for r in good.collect()}
    assert accepted[0] == ({"api_key": "demo_api_key_1", "city_name": "a", "deep": [{"Token": "demo_token_1"}]}, "1")
    reasons = {r["index"]: r.reason for r in bad.collect()}
    assert reasons == {-1: "no_examples_list", 2: "input_is_not_an_object", 3: "missing_required_parameters", 4: "response_is_missing", 5: "duplicate_input"}
    assert len(accepted) == 3 and set(accepted) == {0, 1, 6}
