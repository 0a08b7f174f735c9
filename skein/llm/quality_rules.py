"""Quality rules as a short-circuit cascade, in built-in functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: Documents on which cost and selectivity are estimated: about so many, chosen by a hash of their ids.
SAMPLE_ROWS = 2_000
#: What separates words, and the characters that count as symbols.
SPACES, SYMBOLS = "[\\x20\\x09-\\x0D]+", "#*$%&|<>"
WINDOW = 5
#: How often the sample's rows are evaluated in a run, runs of which the fastest counts, and what costs are told apart from nothing (seconds a million rows).
COPIES, RUNS, LEAST_SECONDS = 32, 2, 0.05


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def occurrences(text: Column, characters: str) -> Column:
    """How many characters of a text are among `characters`."""
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def measures(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """`keep` (doc_id) and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text.

    n_lines counts lines with a word, n_dup_lines those of them equal to an earlier one, n_repeat_words the words in
    5-word windows that the text has twice or more. A null text has none of anything. Everything is computed within its
    row, without a shuffle; windows are only sorted in texts where one repeats, so the work is n log n at most.
    """
    keep = ["doc_id"] if keep is None else keep
    t = F.coalesce(F.col("_text"), F.lit(""))
    step = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_text"))
    step = step.select(*keep, t.alias("_text"), words(t).alias("_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"))
    step = step.select(
        *keep,
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate(F.col("_text"), " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        occurrences(F.col("_text"), SYMBOLS).alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_hashes"),
    )
    named = [*keep, "_text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    last = F.size("_hashes") - WINDOW
    window = lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)])
    empty = F.array().cast("array<bigint>")
    step = step.select(*named, F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).otherwise(empty).alias("_windows"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.select(*named, F.when(repeats, placed).alias("_sorted"))
    near = lambda k: F.get(F.col("_sorted"), k)["h"]
    again = F.filter("_sorted", lambda x, k: F.coalesce(near(k - 1) == x["h"], F.lit(False)) | F.coalesce(near(k + 1) == x["h"], F.lit(False)))
    step = step.select(*named, F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(again, lambda x: x["i"]))).alias("_places"))
    covered = F.transform("_places", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), k + 1) - x, F.lit(WINDOW))).cast("long"))
    made = F.struct(*named, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    # Through a generator no filter on the measures is pushed down, which would compute hashes anew for each window.
    return step.select(F.inline(F.array(made)))


@dataclass(frozen=True)
class Rule:
    """Rejects the rows where `fails` is true; a null rejects none."""

    name: str
    fails: Column


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> list[Rule]:
    """What is judged besides the base, on the columns of measures(). A clean text passes them all.

    The first four compare numbers that there are already; the others go through the text when they are evaluated.
    """
    text = F.col("_text")
    upper, lower = occurrences(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), occurrences(text, "abcdefghijklmnopqrstuvwxyz")
    other = occurrences(text, "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 10 * F.col("word_chars")),
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        Rule("long_words", F.col("word_chars") > 20 * F.col("n_words")),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
        Rule("shouting", 100 * upper > 60 * (upper + lower)),
        Rule("few_letters", 100 * other > 50 * F.col("word_chars")),
    ]


@dataclass(frozen=True)
class Estimate:
    """What a rule costs, in seconds a million rows, and the share of rows that it rejects."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejections for each second."""
        return self.rejected / max(self.seconds, LEAST_SECONDS)


def order(sample: DataFrame, judged: list[Rule], copies: int = COPIES, runs: int = RUNS) -> list[Estimate]:
    """The rules by rejections per cost, the best first; both are measured on `sample`, a small table.

    Each row of the sample is evaluated `copies` times in a run, so that a rule's work stands out from what starting a job takes; a
    rule's cost is the fastest of its runs less the fastest without rules. The order decides how much is evaluated, never
    what is rejected, so a noisy clock can't change a result.
    """
    # Copies differ in their texts' ends, so that nothing is computed once for all of them.
    many = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("_text", F.concat("_text", F.col("_copy").cast("string")))

    def timed(*columns: Column) -> float:
        found = []
        for _ in range(runs):
            began = time.perf_counter()
            many.select("_text", *columns).write.format("noop").mode("overwrite").save()
            found.append(time.perf_counter() - began)
        return min(found)

    timed()
    idle = timed()
    row = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(x.fails, F.lit(False)).cast("int")).alias(f"r{k}") for k, x in enumerate(judged)]).first()
    n = max(1, row["n"])
    found = [Estimate(x, (timed(x.fails.alias("fails")) - idle) * 1e6 / (n * copies), (row[f"r{k}"] or 0) / n) for k, x in enumerate(judged)]
    return sorted(found, key=lambda x: (-x.worth, x.seconds, x.rule.name))


def cascade(ordered: list[Estimate]) -> Column:
    """The name of the first rule that rejects a row, null if none does; later rules are not evaluated then."""
    out = F.lit(None).cast("string")
    for x in reversed(ordered):
        out = F.when(x.rule.fails, F.lit(x.rule.name)).otherwise(out)
    return out


def saved(judged: DataFrame, ordered: list[Estimate]) -> DataFrame:
    """place, rule, evaluated, rejected of the cascade over `judged`, a result of judge(): how many rows reached each rule and left there."""
    names = [x.rule.name for x in ordered]
    place = F.coalesce(F.array_position(F.lit(names), F.col("rejected_by")), F.lit(0)).cast("int")
    ends = judged.where(~F.col("base_failed")).groupBy(place.alias("_end")).agg(F.count(F.lit(1)).alias("_n"))
    # A row for each rule and end, at most the square of the number of rules.
    rules_of = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("place"), F.lit(x).alias("rule")) for k, x in enumerate(names)]))
    rows = ends.select("_end", "_n", rules_of.alias("_r")).select("_end", "_n", "_r.*")
    reached = (F.col("_end") == 0) | (F.col("_end") >= F.col("place"))
    return rows.groupBy("place", "rule").agg(F.sum(F.when(reached, F.col("_n")).otherwise(0)).alias("evaluated"), F.sum(F.when(F.col("_end") == F.col("place"), F.col("_n")).otherwise(0)).alias("rejected"))


def plan(docs: DataFrame, judged: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules in their order for `docs`, from a sample of about `sample_rows` documents that the base leaves."""
    judged = rules() if judged is None else judged
    sample = measures(bounded_sample(docs, sample_rows, 5, "doc_id", "text")).persist()
    try:
        return order(sample.where(~base_failed()), judged)
    finally:
        sample.unpersist()


def judge(docs: DataFrame, judged: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, ordered: list[Estimate] | None = None) -> DataFrame:
    """The measures of every document, base_failed, rejected_by and kept. A null text fails the base like an empty one; repeated
    rows are judged each; columns besides doc_id and text are ignored, whatever their names; an empty table gives none."""
    ordered = plan(docs, judged, sample_rows) if ordered is None else ordered
    # Rules only see what the base left, and each only what those before it left.
    out = measures(docs).withColumn("base_failed", base_failed()).withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(ordered)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(i)),
again AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, g) >= 2),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM again) GROUP BY r),
m AS (SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS lower,
             length(t) - length(regexp_replace(t, '[\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS other
      FROM w LEFT JOIN covered c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * upper > 60 * (upper + lower) OR 100 * other > 50 * word_chars) AS kept
FROM b
"""
