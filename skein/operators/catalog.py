"""Catalogues and caches: unique keys, references, probes, descriptors, whitelists and texts of tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import first_by


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has, and how many. Counts aggregate before their shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """`df`; raises if two rows have the same keys, and names one of them."""
    found = duplicates(df, *keys).limit(1).collect()
    if found:
        raise ValueError(f"more than one row for {dict(zip(keys, found[0], strict=False))}")
    return df


def missing(rows: DataFrame, key: str, known: DataFrame, name: str) -> DataFrame:
    """(key, n): keys of `rows` that `known` lacks under `name`, with the number of rows that have them."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(known.select(F.col(name).alias("_known")), F.col(key) == F.col("_known"), "left_anti")


def require_known(rows: DataFrame, key: str, known: DataFrame, name: str) -> DataFrame:
    """`rows`; raises if one refers to a key that `known` lacks."""
    found = missing(rows, key, known, name).limit(1).collect()
    if found:
        raise ValueError(f"{key} {found[0][0]!r} is unknown")
    return rows


def cache_key(path: Column) -> Column:
    """category, tool and api of a path .../category/tool_for_category/api.json."""
    part = lambda k: F.regexp_extract(path, "([^/]+)/([^/]+)/([^/]+)\\.json$", k)
    category = part(1)
    suffix = F.concat(F.lit("_for_"), category)
    tool = F.when(F.endswith(part(2), suffix), F.substring(part(2), F.lit(1), F.length(part(2)) - F.length(suffix))).otherwise(part(2))
    return F.struct(category.alias("category"), tool.alias("tool"), part(3).alias("api"))


def cache_path(root: str, category: Column, tool: Column, api: Column) -> Column:
    return F.concat_ws("/", F.lit(root), category, F.concat(tool, F.lit("_for_"), category), F.concat(api, F.lit(".json")))


def cache_probe(text: Column) -> Column:
    """exists, entries and error of a cache file's text, null if there is no file: only a JSON object has entries."""
    parsed = F.try_parse_json(text)
    shape = F.schema_of_variant(parsed)
    entries = F.size(F.json_object_keys(F.when(F.startswith(shape, F.lit("OBJECT")), F.to_json(parsed))))
    error = F.when(text.isNull(), None).when(parsed.isNull(), "invalid JSON").when(~F.startswith(shape, F.lit("OBJECT")), "root is no object")
    return F.struct(text.isNotNull().alias("exists"), F.when(entries > 0, entries).otherwise(0).alias("entries"), error.alias("error"))


def with_cache(catalog: DataFrame, files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """`catalog` (with `path`) and exists, entries and error of its cache file, by equal paths; a later file of one path isn't expected."""
    probed = files.select(F.col(path).alias("_path"), cache_probe(F.col(text)).alias("_c"))
    rows = catalog.join(probed, F.col(path) == F.col("_path"), "left")
    return rows.select(*catalog.columns, F.coalesce("_c.exists", F.lit(False)).alias("exists"), F.coalesce("_c.entries", F.lit(0)).alias("entries"), F.col("_c.error").alias("error"))


def largest(df: DataFrame, key: str, text: str, seq: str) -> DataFrame:
    """The row with the longest `text` of each key; of equally long ones the first by `seq`. By max_by, so hot keys aggregate first."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.length(text), -F.col(seq))).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def best_duplicate(df: DataFrame, key: str, text: str, counts: list[str], seq: str) -> DataFrame:
    """Of rows with one key, that with the longest text, then the largest of each of `counts`, then the greatest text, then the first by `seq`."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.length(text), *[F.col(c) for c in counts], F.col(text), -F.col(seq))
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def stable_distinct(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Each key once, with `first_seq`, where it was first seen, which is its place in the order."""
    return df.groupBy(*keys).agg(F.min(seq).alias("first_seq"))


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The tasks without a finished one of their key."""
    return tasks.join(done.select(F.col(key).alias("_done")).distinct(), F.col(key) == F.col("_done"), "left_anti")


def first_match(wanted: DataFrame, apis: DataFrame, name: str, position: str) -> DataFrame:
    """`wanted` and the first row of `apis` by `position` among those with the same `name`; names without one go."""
    first = first_by(apis, [name], [F.asc(position)])
    return wanted.join(first, name)


def task_description(tools: Column, limit: int = 512) -> Column:
    """Numbered lines `k.name: description` of distinct (name, description) structs in their order, descriptions cut and on one line."""
    short = lambda x: F.substring(F.regexp_replace(F.trim(x), "\\s+", " "), 1, limit)
    return F.array_join(F.transform(F.array_distinct(tools), lambda x, k: F.concat((k + 1).cast("string"), F.lit("."), x["name"], F.lit(": "), short(x["description"]))), "\n")


def corpus_text(category: Column, tool: Column, api: Column, description: Column, parameters: Column) -> Column:
    """What a retriever indexes of an API: its names, its description and its required parameters as JSON."""
    return F.concat(F.coalesce(category, F.lit("")), F.lit(", "), F.coalesce(tool, F.lit("")), F.lit(", "), F.coalesce(api, F.lit("")), F.lit(", "), F.coalesce(description, F.lit("")), F.lit(", required_params: "), F.to_json(parameters))


def artifact_name(value: Column, most: int = 60) -> Column:
    """A safe file name: runs of other characters become one hyphen; a hash keeps unlike values apart."""
    safe = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9._]+", "-"), F.lit("-"))
    return F.concat(F.substring(safe, 1, most), F.lit("-"), F.substring(F.sha2(value, 256), 1, 8))


def scenario_gaps(profiles: DataFrame, scenarios: list[str]) -> DataFrame:
    """(api_id, scenario) of the scenarios that a profile lacks. profiles: api_id, scenario."""
    wanted = profiles.select("api_id").distinct().select("api_id", F.explode(F.lit(scenarios)).alias("scenario"))
    return wanted.join(profiles.select("api_id", "scenario"), ["api_id", "scenario"], "left_anti")
