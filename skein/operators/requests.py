"""Requests to simulated services: the gate before the costly generator, results, waits, logs, and tolerant parsers of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as true and as false in a setting.
TRUE, FALSE = ["1", "true", "yes", "on", "y", "t"], ["0", "false", "no", "off", "n", "f"]


def parse_bool(value: Column) -> Column:
    """true or false by the usual spellings, whatever their case; null for anything else, which callers may refuse."""
    word = F.lower(F.trim(value))
    return F.when(word.isin(TRUE), True).when(word.isin(FALSE), False)


def require_bool(value: Column, name: str) -> Column:
    """parse_bool(), which raises on what is neither; null stays null."""
    found = parse_bool(value)
    return F.when(value.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit(f"{name} is no boolean: "), value)).cast("boolean")).otherwise(found)


def gate(calls: DataFrame, enabled: Column | bool = True) -> DataFrame:
    """Adds `generate`: whether a call (profile_found, succeeded) gets a generated answer, which all do where simulation is off."""
    on = F.lit(enabled) if isinstance(enabled, bool) else enabled
    return calls.withColumn("generate", ~on | (F.col("profile_found") & F.col("succeeded")))


def resolve(gated: DataFrame, answer: Callable[[DataFrame], DataFrame] | Column) -> DataFrame:
    """Adds `error` and `response` to gated calls.

    `answer` is a column, or a function from the rows that pass the gate to those rows with `response`; it never sees others.
    """
    error = F.when(F.col("generate"), "").when(~F.col("profile_found"), "No service profile for this API").otherwise("Simulated service failure")
    rows = gated.withColumn("error", error)
    if isinstance(answer, Column):
        return rows.withColumn("response", F.when(F.col("generate"), answer))
    passed = answer(rows.where("generate"))
    stopped = rows.where(~F.col("generate")).withColumn("response", F.lit(None).cast(passed.schema["response"].dataType))
    return passed.unionByName(stopped.select(*passed.columns))


def remaining_wait(latency_ms: Column, elapsed_ms: Column) -> Column:
    """Seconds that are left of a simulated latency, 0 at least. It is only computed: tasks never sleep."""
    return F.greatest(F.lit(0.0), (F.coalesce(latency_ms, F.lit(0.0)) - elapsed_ms) / 1000)


def log_lines(resolved: DataFrame, key: str) -> DataFrame:
    """(key, line): one JSON line a request, as a sink appends it."""
    return resolved.select(key, F.to_json(F.struct(*[c for c in resolved.columns if c != key])).alias("line"))


def load(spark, n: int, apis: int, seed: int) -> DataFrame:
    """(request_index, api_id): `n` requests, each to an API drawn by seed and index."""
    from ..functions.ids import uniform

    return spark.range(n).select(F.col("id").alias("request_index"), F.floor(uniform(seed, F.col("id"), "load") * apis).cast("long").alias("api_id"))


def attributes(text: Column, names: list[str]) -> Column:
    """A struct of named strings from an answer that should be a JSON object: by JSON, else by the quoted name, a colon and what is quoted after it."""
    parsed = F.try_parse_json(text)
    loose = {n: F.nullif(F.regexp_extract(text, f'"{n}"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1), F.lit("")) for n in names}
    return F.struct(*[F.when(parsed.isNotNull(), F.try_variant_get(parsed, f"$.{n}", "string")).otherwise(loose[n]).alias(n) for n in names])


def finish_arguments(text: Column) -> Column:
    """(return_type, final_answer) of a call that ends a task: by JSON, else by pattern; without a type, what has an answer gives one."""
    found = attributes(text, ["return_type", "final_answer"])
    kind = F.coalesce(found["return_type"], F.when(found["final_answer"].isNotNull(), "give_answer").otherwise("give_up"))
    return F.struct(kind.alias("return_type"), F.coalesce(found["final_answer"], F.lit("")).alias("final_answer"))
