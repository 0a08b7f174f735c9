"""Tokens, similarities, signatures and tolerant parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that searching ignores.
LEXICAL_STOPWORDS = "a an and api are as at be by category description for from in is it of on optional or parameter parameters required string the this to tool type use with".split()
#: Words that audits ignore, and words that tell one scope from another.
AUDIT_STOPWORDS = "a an and api by for from get in of on or the to with".split()
SCOPE_WORDS = "all list latest recent multiple single one history details summary".split()


def tokens(text: Column, stopwords: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(stopwords))


def lexical_tokens(text: Column) -> Column:
    return tokens(text, LEXICAL_STOPWORDS)


def audit_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text, AUDIT_STOPWORDS))


def jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def containment(left: Column, right: Column) -> Column:
    shared, one = F.size(F.array_intersect(left, right)), F.lit(1)
    return F.greatest(shared / F.greatest(one, F.size(left)), shared / F.greatest(one, F.size(right)))


def scope_contrast(left: Column, right: Column) -> Column:
    differ = F.array_union(F.array_except(left, right), F.array_except(right, left))
    return F.arrays_overlap(differ, F.array(*map(F.lit, SCOPE_WORDS)))


def non_blank(value: Column, default: Column | None = None) -> Column:
    """`value` unless it is null or white space, `default` (null) otherwise."""
    out = F.when(F.trim(value) != "", value)
    return out if default is None else F.coalesce(out, default)


def semantic_text(**parts: Column) -> Column:
    """`Label: value` lines of the parts that aren't blank."""
    lines = [F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in parts.items()]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def parameter_signature(names: Column, types: Column) -> Column:
    """Sorted (name, TYPE) pairs of two arrays; a blank type is UNKNOWN."""
    pairs = F.arrays_zip(names.alias("name"), types.alias("type"))
    made = F.transform(pairs, lambda p: F.concat_ws(":", F.lower(F.trim(p["name"])), F.upper(non_blank(p["type"], F.lit("UNKNOWN")))))
    return F.array_sort(made)


def truncate(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def strip_fence(text: Column) -> Column:
    """Text without a Markdown code fence around it."""
    inner = F.regexp_extract(text, "(?s)^\\s*```[a-zA-Z]*\\s*\\n?(.*?)\\s*```\\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def react_parts(text: Column) -> Column:
    """thought, action and action_input of `Thought: ... Action: ... Action Input: ...`."""
    thought = strip(F.substring_index(F.substring_index(text, "Action:", 1), "Thought:", -1))
    rest = F.substring_index(text, "Action:", -1)
    return F.struct(thought.alias("thought"), strip(F.substring_index(rest, "Action Input:", 1)).alias("action"), strip(F.substring_index(text, "Action Input:", -1)).alias("action_input"))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))
