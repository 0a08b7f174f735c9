"""Service-quality profiles and simulated calls as pure functions of seeds and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import normal, uniform

#: Scenarios with their factors of success and latency.
SCENARIOS = [("normal", 1.0, 1.0), ("degraded", 0.6375, 2.0), ("outage", 0.01, 4.0)]
#: Bounds of latency (ms), of cost (units) with its median and spread, and of a call's spread.
LATENCY, COST, COST_MEDIAN, COST_SIGMA, SIGMA = (1.0, 300_000.0), (5e-5, 0.05), 0.001, 1.0, (0.05, 0.25)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def donor_pool(apis: DataFrame) -> DataFrame:
    """One donor a tool: its first api_id with a positive latency and complete figures; `idx` from 0 by api_id.

    apis: api_id, tool_id, service_level, success_rate (percent), latency_ms.
    """
    complete = apis.where(F.col("service_level").isNotNull() & F.col("success_rate").isNotNull() & (F.col("latency_ms") > 0))
    first = complete.groupBy("tool_id").agg(F.min_by(F.struct("api_id", "service_level", "success_rate", "latency_ms"), F.col("api_id")).alias("d")).select("d.*", "tool_id")
    return first.withColumn("idx", (F.row_number().over(Window.orderBy("api_id")) - 1).cast("long"))


def assign_donors(targets: DataFrame, donors: DataFrame, seed: int) -> DataFrame:
    """(api_id, tool_id) with a donor of another tool, drawn evenly; of any tool if there is no other.

    There is one donor a tool, so skipping the own index turns the draw into an equi-join on an index.
    """
    n = donors.agg(F.count(F.lit(1)).alias("_d"))
    own = donors.select(F.col("tool_id").alias("_tool"), F.col("idx").alias("_own"))
    rows = targets.join(own, F.col("tool_id") == F.col("_tool"), "left").join(F.broadcast(n))
    free = F.col("_d") - F.col("_own").isNotNull().cast("long")
    free = F.when(free > 0, free).otherwise(F.col("_d"))
    k = F.floor(uniform(seed, F.col("api_id"), "donor") * free)
    skip = F.col("_own").isNotNull() & (k >= F.col("_own")) & (F.col("_d") > 1)
    rows = rows.withColumn("_idx", (k + skip.cast("long")).cast("long"))
    picked = donors.select(F.col("idx").alias("_idx"), F.col("api_id").alias("donor_api_id"), F.col("tool_id").alias("donor_tool_id"), "service_level", "success_rate", "latency_ms")
    return rows.join(picked, "_idx").select("api_id", targets["tool_id"], "donor_api_id", "donor_tool_id", "service_level", "success_rate", "latency_ms")


def baseline(assigned: DataFrame, seed: int) -> DataFrame:
    """api_id, donor, base_success, base_latency_ms, cost_units, latency_log_sigma."""
    key = F.col("api_id")
    success = clip(F.col("service_level") / 100, 0, 1) * clip(F.col("success_rate") / 100, 0, 1)
    cost = clip(F.lit(COST_MEDIAN) * F.exp(F.lit(COST_SIGMA) * normal(seed, key, "cost")), *COST)
    sigma = F.lit(SIGMA[0]) + (SIGMA[1] - SIGMA[0]) * uniform(seed, key, "sigma")
    return assigned.select("api_id", "donor_api_id", F.round(success, 8).alias("base_success"), F.round(clip(F.col("latency_ms"), *LATENCY), 4).alias("base_latency_ms"), F.round(cost, 10).alias("cost_units"), F.round(sigma, 8).alias("latency_log_sigma"))


def scenarios(profiles: DataFrame) -> DataFrame:
    """A row for each profile and scenario: success_rate, expected_latency_ms."""
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("s"), F.lit(x).alias("x")) for n, s, x in SCENARIOS])).alias("f")
    rows = profiles.select("*", table)
    return rows.select("api_id", "donor_api_id", "f.scenario", F.round(clip(F.col("base_success") * F.col("f.s"), 0, 1), 8).alias("success_rate"), F.round(F.greatest(F.col("base_latency_ms") * F.col("f.x"), F.lit(1.0)), 4).alias("expected_latency_ms"), "cost_units", "latency_log_sigma")


def call_index(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds the ordinal of each call from 0 among those of its key."""
    return calls.withColumn("call_index", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def simulate(calls: DataFrame, profiles: DataFrame, seed: int) -> DataFrame:
    """Outcome and latency of each call (api_id, call_index) under the profile of its API.

    Outcomes and latencies come from draws of their own, so the spread of one never moves the other. The mean of latencies is
    the expected one. Without a profile, the call is marked as not found and costs nothing.
    """
    rows = calls.join(profiles.select("api_id", "success_rate", "expected_latency_ms", "cost_units", "latency_log_sigma"), "api_id", "left")
    key = F.concat_ws("#", F.col("api_id").cast("string"), F.col("call_index").cast("string"))
    found = F.col("success_rate").isNotNull()
    sigma = F.col("latency_log_sigma")
    latency = F.exp(F.log("expected_latency_ms") - sigma * sigma / 2 + sigma * normal(seed, key, "latency"))
    return rows.select(
        *calls.columns,
        found.alias("profile_found"),
        F.coalesce(uniform(seed, key, "outcome") < F.col("success_rate"), F.lit(False)).alias("succeeded"),
        F.when(found, F.round(latency, 4)).alias("latency_ms"),
        F.when(found, F.col("cost_units")).otherwise(0.0).alias("cost_units"),
        F.col("success_rate"),
    )


def call_summary(calls: DataFrame, *keys: str) -> DataFrame:
    """calls, success_rate, configured_rate (of the first call), mean, median and p95 latency, total cost."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.avg(F.col("succeeded").cast("int")), 6).alias("observed_rate"),
        F.min_by("success_rate", "call_index").alias("configured_rate"),
        F.round(F.avg("latency_ms"), 3).alias("mean_latency"),
        F.round(F.percentile("latency_ms", F.lit(0.5)), 3).alias("median_latency"),
        F.round(F.percentile("latency_ms", F.lit(0.95)), 3).alias("p95_latency"),
        F.round(F.sum("cost_units"), 6).alias("total_cost"),
    )
