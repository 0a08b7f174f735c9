import random
import re
import numpy as np
import pytest

from skein.llm import ngram_join as j
from skein.llm.shingles import Partition, shingle_sets


def shingles(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for k, a in enumerate(docs):
        for b in docs[:k]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * both >= percent * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def corpus(seed, families=25):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(800)] + ["Zoë", "ÀB"]
    passage = " ".join(draw.choice(vocabulary) for _ in range(40))
    texts = [None, "", " \n ", "one", "One", "two words", "a b c", "A b\tC"]
    for _ in range(families):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([4, 6, 9, 15, 30, 60, 120, 300]))]
        for _ in range(draw.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            text = draw.choice([" ", "\n", "  "]).join(copy)
            texts.append(text.upper() if draw.random() < 0.1 else text + (" " + passage if draw.random() < 0.3 else ""))
    draw.shuffle(texts)
    return [(3 * k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "percent", "seed", "most"), [(4, 85, 1, None), (5, 80, 2, 1)])
def test_components_against_brute_force(spark, monkeypatch, n, percent, seed, most):
    """`most`: bounds so small that nothing but large classes is broadcast."""
    if most:
        for bound in ("BROADCAST_ROWS", "HOT_ROWS"):
            monkeypatch.setattr(j, bound, most)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS doc", "text AS sig", "doc_id AS rep")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in j.near_duplicates(docs, n, percent).collect()}
    assert found == brute(rows, n, percent)


def test_one_of_each_component_stays(spark):
    rows = [(k, f"{'shared words of a copy ' * 3}{'' if k % 2 else 'or not'}") for k in range(6)] + [(9, "something else entirely"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS doc", "text AS sig")
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute(rows[:-1], 5, 80).values()} | {None}


def test_groups_are_opened_across(spark):
    """A chain whose ends share no link with the first of their signatures still becomes one component."""
    base = [f"t{k}" for k in range(200)]
    rows = []
    for k in range(12):
        words = list(base)
        for i in range(0, 6 * k):
            words[(7 * i) % 200] = f"n{(7 * i) % 200}"
        rows.append((50 - k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in j.near_duplicates(docs, 4, 85).collect()}
    assert found == brute(rows, 4, 85)


def test_signatures_miss_no_link():
    draw = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"v{draw.randrange(4000)}" for _ in range(draw.choice([5, 7, 10, 14, 25, 60, 150, 400]))]
        for _ in range(5):
            copy = list(words)
            for _ in range(draw.choice([0, 1, 1, 2, 4, 8])):
                copy[draw.randrange(len(copy))] = f"v{draw.randrange(4000)}"
            texts.append(" ".join(copy[: len(copy) - draw.choice([0, 0, 1, 2])]))
    for n, percent in ((4, 85), (5, 80), (3, 60)):
        sets = shingle_sets(texts, n)
        made = Partition(percent)
        sigs = made.signatures(sets)
        links = 0
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and both < max(len(sets[a]), len(sets[b])):
                    links += 1
                    assert any(c == d and len(np.intersect1d(x, y)) >= max(1, max(m, k) - made.differ(len(sets[a]) + len(sets[b]))) for c, m, x in sigs[a] for d, k, y in sigs[b])
        assert links > 20


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(2, "same text of some words"), (2, "same text of some words"), (None, "same text of some words"), (1, "SAME text of some words"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in j.near_duplicates(docs, 4, 85).collect())
    assert found == [(-1, None), (1, 1), (2, 1), (2, 1), (4, 4), (5, 5)]
    assert j.near_duplicates(docs.limit(0)).count() == 0


def test_rows_of_one_id_have_the_links_of_all_their_texts(spark):
    draw = random.Random(5)
    word = lambda: f"u{draw.randrange(3000)}"
    a, b, c, d, e = ([word() for _ in range(60)] for _ in range(5))
    near = lambda words: [*words[:-1], "other"]
    # 7 has a text equal to that of 3 and one near to that of 9; 5 has two texts of its own, one near to that of 2; 8 a text and none.
    texts = [(3, a), (7, a), (7, b), (9, near(b)), (5, c), (5, d), (2, near(d)), (8, e), (8, []), (1, near(e)), (8, e)]
    rows = [(k, " ".join(x)) for k, x in texts]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    want = {1: 1, 8: 1, 2: 2, 5: 2, 3: 3, 7: 3, 9: 3}
    assert found == sorted((k, max(0, len(x) - 3), want[k]) for k, x in texts)
    assert j.near_duplicates(spark.createDataFrame([(4, None), (4, "")], "doc_id long, text string")).select("component_id").distinct().collect()[0][0] == 4


def test_repeated_rows_stay_once(spark):
    rows = [(1, "some words that are here"), (1, "some words that are here"), (1, "quite another text"), (2, "a text of its own"), (None, "x"), (None, "x")]
    kept = j.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [*rows[1:]]))
