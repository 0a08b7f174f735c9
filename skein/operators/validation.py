"""Checks of annotations, profiles, configurations and generated examples; what fails is kept with its reason."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import change_name, standardize
from ..functions.text import non_blank, strip_fence
from .qos import SCENARIOS

#: Relations and directions of pairs.
RELATIONS = ["interchangeable", "contains", "different_capability"]
DIRECTIONS = ["none", "left_contains_right", "right_contains_left"]
#: Parameter types of APIs and those of function schemas; all others are strings.
TYPES = [("NUMBER", "integer"), ("STRING", "string"), ("BOOLEAN", "boolean")]
#: Parameters whose values are credentials.
SECRET = r"(?i)(?:api_?key|apikey|token|secret|password|authorization|credential)"


def _kind(v: Column, path: str) -> Column:
    """The type of a field of a variant: VOID for null, null if there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_number(kind: Column) -> Column:
    return F.coalesce(kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"), F.lit(False))


def annotation_error(output: Column) -> Column:
    """Why a model's answer is no annotation, by the first rule that it breaks; null for a sound one. Code fences are allowed."""
    v = F.try_parse_json(strip_fence(output))
    relation, direction = (F.try_variant_get(v, f"$.{x}", "string") for x in ("relation", "direction"))
    confidence = F.try_variant_get(v, "$.confidence", "double")
    is_list = F.coalesce(_kind(v, "$.evidence").startswith("ARRAY"), F.lit(False))
    return (
        F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not_an_object")
        .when(~F.coalesce(relation.isin(RELATIONS), F.lit(False)), "unknown_relation")
        .when(~F.coalesce(direction.isin(DIRECTIONS), F.lit(False)), "unknown_direction")
        .when((relation == "contains") & (direction == "none"), "contains_requires_direction")
        .when((relation != "contains") & (direction != "none"), "direction_must_be_none")
        .when(~_is_number(_kind(v, "$.confidence")), "confidence_not_a_number")
        .when((confidence < 0) | (confidence > 1), "confidence_out_of_range")
        .when((F.coalesce(_kind(v, "$.reasoning"), F.lit("")) != "STRING") | non_blank(F.try_variant_get(v, "$.reasoning", "string")).isNull(), "empty_reasoning")
        .when(~is_list, "evidence_not_a_list")
        .when(F.coalesce(_kind(v, "$.needs_human_review"), F.lit("")) != "BOOLEAN", "review_flag_not_boolean")
    )


def annotations(rows: DataFrame, output: str = "output") -> tuple[DataFrame, DataFrame]:
    """(rows with `annotation`, rows with `error`)."""
    kind = "relation string, direction string, confidence double, reasoning string, evidence array<string>, needs_human_review boolean"
    marked = rows.withColumn("error", annotation_error(F.col(output)))
    good = marked.where("error is null").drop("error").withColumn("annotation", F.from_json(strip_fence(F.col(output)), kind))
    return good, marked.where("error is not null")


def profile_error(success: Column, older_success: Column, latency: Column, cost: Column, sigma: Column, distribution: Column) -> Column:
    """Why a service profile can't be used. An older name of its success rate is read where the present one is missing."""
    rate = F.coalesce(success, older_success)
    return (
        F.when(~F.coalesce(distribution == "lognormal", F.lit(False)), "unsupported_distribution")
        .when(rate.isNull(), "missing_success_rate")
        .when(F.isnan(rate) | (rate < 0) | (rate > 1), "invalid_success_rate")
        .when(cost.isNull() | F.isnan(cost) | (cost < 0) | (cost == float("inf")), "invalid_cost")
        .when(latency.isNull() | F.isnan(latency) | (latency <= 0), "invalid_latency")
        .when(sigma.isNull() | F.isnan(sigma) | (sigma < 0), "invalid_sigma")
    )


def config_errors(config: dict) -> list[str]:
    """All that is wrong with a configuration for generating profiles; a small dict on the driver."""

    def at(path: str) -> object:
        out: object = config
        for name in path.split("."):
            out = out.get(name) if isinstance(out, dict) else None
        return out

    found: list[str] = []
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf")
    for path, want in (("empirical_bootstrap.success_rate.formula", "service_level_times_success_rate"), ("empirical_bootstrap.expected_latency_ms.field", "avgLatency"), ("synthetic.cost_per_call_units.distribution", "lognormal"), ("synthetic.latency_log_sigma.distribution", "uniform")):
        if at(path) != want:
            found.append(f"{path} must be {want!r}")
    for path, zero, most, equal in (("empirical_bootstrap.success_rate", True, 1, False), ("empirical_bootstrap.expected_latency_ms", False, None, False), ("synthetic.cost_per_call_units", True, None, False), ("synthetic.latency_log_sigma", True, None, True)):
        low, high = at(f"{path}.min"), at(f"{path}.max")
        if not number(low) or not number(high) or low < 0 or (low == 0 and not zero) or high <= 0 or low > high or (low == high and not equal) or (most is not None and high > most):
            found.append(f"{path} has bad bounds")
    for name in ("median", "log_sigma"):
        v = at(f"synthetic.cost_per_call_units.{name}")
        if not number(v) or v <= 0:
            found.append(f"synthetic.cost_per_call_units.{name} must be positive")
    scenarios, names = at("scenarios") or {}, {n for n, *_ in SCENARIOS}
    if set(scenarios) != names:
        found.append(f"scenarios must be exactly {sorted(names)}")
    for name, values in scenarios.items():
        for factor in ("success_rate_factor", "latency_factor", "cost_factor"):
            v = values.get(factor) if isinstance(values, dict) else None
            if not number(v) or v < 0 or (v == 0 and factor == "latency_factor"):
                found.append(f"scenarios.{name}.{factor} is out of range")
    return found


def evaluate_cases(expected: DataFrame, annotated: DataFrame, errors: DataFrame) -> DataFrame:
    """status of each case: PASS or FAIL by its annotation, else ERROR with the last error, else MISSING.

    expected: pair_id, case, relation, direction; annotated: pair_id, relation, direction; errors: pair_id, seq, error.
    """
    got = annotated.select("pair_id", F.col("relation").alias("got_relation"), F.col("direction").alias("got_direction"))
    last = errors.groupBy("pair_id").agg(F.max_by("error", "seq").alias("last_error"))
    rows = expected.join(got, "pair_id", "left").join(last, "pair_id", "left")
    same = (F.col("relation") == F.col("got_relation")) & (F.col("direction") == F.col("got_direction"))
    status = F.when(same, "PASS").when(F.col("got_relation").isNotNull(), "FAIL").when(F.col("last_error").isNotNull(), "ERROR").otherwise("MISSING")
    return rows.select("pair_id", "case", status.alias("status"), F.when(F.col("got_relation").isNull(), F.col("last_error")).alias("detail"))


def function_schema(api_name: Column, tool: Column, description: Column, required: Column, optional: Column, most: int = 256) -> Column:
    """A function-call schema as a struct: name of 64 characters at most, description, properties and the names of both kinds.

    required and optional: arrays of struct<name, type, description, default>. Optional ones count without required ones, too.
    """
    name = F.concat(change_name(standardize(api_name)), F.lit("_for_"), tool)
    name = F.substring(name, F.greatest(F.lit(1), F.length(name) - 63), F.lit(64))
    said = F.concat(F.lit('This is the subfunction for tool "'), tool, F.lit('", you can use this tool.'))
    more = F.concat(F.lit('The description of this function is: "'), F.substring(F.replace(F.trim(description), api_name, name), 1, most), F.lit('"'))

    def one(p: Column) -> Column:
        kind = F.lit("string")
        for given, made in TYPES:
            kind = F.when(p["type"] == given, made).otherwise(kind)
        return F.struct(change_name(standardize(p["name"])).alias("name"), kind.alias("type"), F.substring(p["description"], 1, most).alias("description"), non_blank(p["default"]).alias("example_value"))

    a, b = (F.transform(F.coalesce(x, F.array().cast(f"array<struct<name:string,type:string,description:string,default:string>>")), one) for x in (required, optional))  # noqa: F541
    names = lambda x: F.transform(x, lambda p: p["name"])
    return F.struct(name.alias("name"), F.concat(said, F.coalesce(F.when(non_blank(description).isNotNull(), more), F.lit(""))).alias("description"), F.concat(a, b).alias("properties"), names(a).alias("required"), names(b).alias("optional"))


def placeholder(key: object, number: int) -> str | None:
    """What stands for the value of a key that names a credential; None for other keys."""
    plain = "_".join(re.findall("[一-龥a-zA-Z0-9]+", str(key))).lower()
    return f"demo_{plain}_{number}" if re.search(SECRET, plain) else None


def sanitized(value: object, number: int) -> object:
    """Parsed JSON in which placeholders stand for credentials, whatever the depth; `value` is changed in place.

    Containers wait on a stack, so nesting is bounded by memory and not by calls.
    """
    waiting = [value]
    while waiting:
        here = waiting.pop()
        if isinstance(here, dict):
            here.update({k: mark for k in here if (mark := placeholder(k, number))})
        waiting += [x for x in (here.values() if isinstance(here, dict) else here) if isinstance(x, (dict, list))] if isinstance(here, (dict, list)) else []
    return value


def sanitize(value: Column, number: Column) -> Column:
    """JSON text with credentials replaced; what isn't JSON stays. Depth is unbounded, hence the Arrow function."""

    @F.pandas_udf("string")
    def work(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        def one(text: str | None, n: int) -> str | None:
            try:
                return json.dumps(sanitized(json.loads(text), int(n)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except (TypeError, ValueError):
                return text

        return pd.Series([one(t, n) for t, n in zip(texts, numbers, strict=True)], dtype="object")

    return work(value, number)


def examples(outputs: DataFrame, known: DataFrame, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) examples of model outputs.

    outputs: api_id, output (`{"examples": [{"input": {}, "response": ...}]}`, fences allowed), required (names); known: api_id,
    key. Parameter names are normalised and credentials replaced before keys are made. An example goes if its input is no object,
    a required parameter or the response is missing, or its key is known or came before; `limit` of an API are accepted.
    """
    v = F.try_parse_json(strip_fence(F.col("output")))
    rows = outputs.select("api_id", "required", F.try_variant_get(v, "$.examples", "array<variant>").alias("_list"))
    bad = rows.where("_list is null").select("api_id", F.lit(-1).alias("index"), F.lit("no_examples_list").alias("reason"))
    each = rows.select("api_id", "required", F.posexplode("_list").alias("index", "e"))
    given = F.try_variant_get("e", "$.input", "map<string,variant>")
    shown = each.select("api_id", "required", "index", given.alias("_in"), F.try_variant_get("e", "$.input", "string").alias("_raw"), _kind(F.col("e"), "$.response").isNotNull().alias("_answered"), F.to_json(F.try_variant_get("e", "$.response", "variant")).alias("response"))
    names = F.transform_keys("_in", lambda k, _: change_name(standardize(k)))
    shown = shown.select("*", F.array_except(F.transform("required", lambda x: change_name(standardize(x))), F.map_keys(names)).alias("_missing"), sanitize(F.to_json(names), F.col("index") + 1).alias("key"))
    old = known.select("api_id", "key", F.lit(True).alias("_old")).distinct()
    w = Window.partitionBy("api_id", "key").orderBy("index")
    ok = F.col("_in").isNotNull() & (F.size("_missing") == 0)
    shown = shown.join(old, ["api_id", "key"], "left").withColumn("_again", F.sum(F.when(ok & F.col("_answered"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    reason = F.when(F.col("_in").isNull(), "input_is_not_an_object").when(F.size("_missing") > 0, "missing_required_parameters").when(F.col("_old") | (F.col("_again") > 0), "duplicate_input").when(~F.col("_answered"), "response_is_missing")
    marked = shown.withColumn("reason", reason)
    passed = marked.where("reason is null").withColumn("_n", F.row_number().over(Window.partitionBy("api_id").orderBy("index"))).where(F.col("_n") <= limit)
    return passed.select("api_id", "index", "key", "response"), bad.unionByName(marked.where("reason is not null").select("api_id", "index", "reason"))
