"""Identifiers, content hashes and seeded draws as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that get the prefix is_.
RESERVED = ["from", "class", "return", "false", "true", "id", "and"]
UNIT = "\x1f"


def standardize(value: Column, keep_caret: bool = False, digit_prefix: bool = True) -> Column:
    """Letters, digits, underscores and CJK ideographs, lower-cased; runs of anything else become one underscore inside.

    `keep_caret` leaves ^ in place, as servers do; `digit_prefix` puts get_ before a leading digit. Null counts as empty.
    """
    allowed = "a-zA-Z0-9_^" if keep_caret else "a-zA-Z0-9_"
    name = F.regexp_replace(F.coalesce(value, F.lit("")), f"[^一-龥{allowed}]", "_")
    name = F.lower(F.trim(F.regexp_replace(name, "_+", "_"), F.lit("_")))
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("get_"), name)).otherwise(name) if digit_prefix else name


def change_name(name: Column) -> Column:
    return F.when(name.isin(RESERVED), F.concat(F.lit("is_"), name)).otherwise(name)


def standardize_category(value: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(value, F.lit("")), " ,/", "___"), "_+", "_")


def api_id(category: Column, tool: Column, api: Column) -> Column:
    """category/tool/api, in which a reserved API name is prefixed on every path."""
    return F.concat_ws("/", standardize_category(category), standardize(tool), change_name(standardize(api)))


def tool_key(api: Column) -> Column:
    return F.substring_index(api, "/", 2)


def runtime_names(category: Column, tool: Column, api: Column) -> tuple[Column, Column]:
    """(tool, api) of a request: an API name loses _for_<tool>, a tool name gets _for_<category>."""
    suffix = F.concat(F.lit("_for_"), tool)
    name = F.when(F.endswith(api, suffix), F.substring(api, F.lit(1), F.length(api) - F.length(suffix))).otherwise(api)
    return F.concat(tool, F.lit("_for_"), category), name


def stable_id(prefix: str, *parts: Column) -> Column:
    digest = F.sha2(F.concat_ws(UNIT, *[p.cast("string") for p in parts]), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, 20))


def pair_id(left: Column, right: Column) -> Column:
    """The same for either order."""
    a, b = left.cast("string"), right.cast("string")
    return F.concat(F.lit("pair_"), F.substring(F.sha2(F.concat_ws("\x00", F.least(a, b), F.greatest(a, b)), 256), 1, 20))


def stable_seed(*parts: Column) -> Column:
    """The first 31 bits of a digest."""
    digest = F.sha2(F.concat_ws(UNIT, *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def uniform(seed: int, key: Column, dimension: Column | str) -> Column:
    """A draw from [0, 1) that depends on (seed, key, dimension) alone, not on partitions or order."""
    d = F.lit(dimension) if isinstance(dimension, str) else dimension
    digest = F.sha2(F.concat_ws(UNIT, F.lit(str(seed)), key.cast("string"), d), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal(seed: int, key: Column, dimension: Column | str) -> Column:
    """A standard normal draw by Box and Muller from two uniform ones."""
    d = F.lit(dimension) if isinstance(dimension, str) else dimension
    u, v = uniform(seed, key, F.concat(d, F.lit("#1"))), uniform(seed, key, F.concat(d, F.lit("#2")))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
