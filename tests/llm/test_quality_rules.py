import random
import re

from pyspark.sql import functions as F

from skein.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_and_order(spark):
    draw = random.Random(2)
    texts = [None, "", " \n\t ", "word", "a b c d e a b c d e", "x " * 40, "a b c d\n" * 6, "é|# \x0b\x0c\r zoë", "one\n\none\n \nOne", "😀 " * 7 + "end"]
    texts += [draw.choice([" ", "  ", "\n"]).join(draw.choice("abc") for _ in range(draw.randint(0, 60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(0, None), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS n_words", "text AS _text2")
    found = q.judge(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        want = brute("null id" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.rejected_by is None) and (r.rejected_by is None or not r.base_failed)
    assert q.judge(docs.limit(0)).count() == 0


def test_rules_reject_what_they_name(spark):
    clean = "The committee met on Tuesday and agreed that the new bridge should open before winter comes again."
    bad = {
        "symbols": " | ".join(f"cell{k}" for k in range(30)),
        "short_words": " ".join(chr(97 + k % 26) for k in range(30)),
        "shouting": clean.upper(),
        "few_letters": " ".join(str(10**9 + 7 * k) for k in range(30)),
        "long_words": " ".join("x" * 30 + str(k) for k in range(12)),
    }
    docs = spark.createDataFrame([("clean", clean), *bad.items()], "doc_id string, text string")
    found = {r.doc_id: (r.kept, r.rejected_by) for r in q.judge(docs).collect()}
    assert found.pop("clean") == (True, None)
    assert all(not kept for kept, _ in found.values()) and {k for k, (_, by) in found.items() if by is None} == set()


def test_cascade_short_circuits_by_worth(spark):
    good, late = q.Rule("good", F.col("n") > 5), q.Rule("late", F.raise_error(F.lit("evaluated")).cast("boolean"))
    ordered = [q.Estimate(good, 1.0, 0.9), q.Estimate(late, 1.0, 0.1)]
    assert [r.by for r in spark.range(6, 9).withColumnRenamed("id", "n").select(q.cascade(ordered).alias("by")).collect()] == ["good"] * 3
    assert q.Estimate(good, 2.0, 0.5).worth < q.Estimate(good, 1.0, 0.5).worth


def test_costs_differ_and_the_cascade_saves_work(spark):
    """Rules that go through texts cost more than comparisons; rows that one rule rejects never reach the next."""
    clean = "The committee met on Tuesday and agreed that the new bridge should open before winter comes again."
    rows = [(k, f"{clean} {k} " * 3 if k % 3 else " | ".join(f"cell{k + i}" for i in range(30))) for k in range(300)]
    docs = spark.createDataFrame([(k, t + " ".join(f"w{k}x{i}" for i in range(200))) if k % 3 else (k, t) for k, t in rows], "doc_id long, text string")
    dear = q.Rule("dear", F.size(F.array_distinct(F.transform(F.split("_text", ""), lambda x: F.md5(x)))) < 2)
    cheap = next(x for x in q.rules() if x.name == "symbols")
    ordered = q.plan(docs, [dear, cheap])
    cost = {x.rule.name: x.seconds for x in ordered}
    assert [x.rule.name for x in ordered] == ["symbols", "dear"] and cost["dear"] > 10 * max(cost["symbols"], 0.05)
    found = q.judge(docs, ordered=ordered)
    left = found.where("not base_failed").count()
    table = {r.rule: (r.place, r.evaluated, r.rejected) for r in q.saved(found, ordered).collect()}
    assert table["symbols"][:2] == (1, left) and table["symbols"][2] == found.where("rejected_by = 'symbols'").count() > 50
    assert table["dear"] == (2, left - table["symbols"][2], 0)


def test_long_text_and_clashing_columns(spark):
    draw = random.Random(4)
    long = " ".join("".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(100_000))
    docs = spark.createDataFrame([(1, long), (2, "y" * 1_000_000)], "doc_id long, text string").selectExpr("*", *[f"1 AS {c}" for c in ("_words", "_lines", "_hashes", "n_lines", "base_failed", "kept", "rejected_by", "_copy")])
    found = {r.doc_id: r for r in q.judge(docs).collect()}
    assert found[1].n_words == 100_000 and found[1].kept and not found[2].kept
