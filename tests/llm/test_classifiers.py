import math
import random
import zlib
from collections import Counter

import numpy as np

from skein.llm import common, linear, toxicity, weak_labels

WORDS = "the of and river stone market winter garden people small under between carry window morning letter bread story".split()


def test_grams_stay_inside_their_text():
    texts = ["abcd", "", "ab", "Zoë’s"]
    for size, (owner, bucket) in zip((3, 4), linear.grams(texts, (3, 4), 12), strict=True):
        assert [int((owner == k).sum()) for k in range(4)] == [max(0, len(t) - size + 1) for t in texts]
        assert bucket.max() < 1 << 12
    one = [b for _, b in linear.grams(["xabcx"], (3,), 20)][0]
    assert list(one) == list([b for _, b in linear.grams(["q", "XABCX"], (3,), 20)][0])
    assert list(linear.grams([""], (3,), 8)) == []


def test_toxic_words_are_learnt_and_clean_ones_left_alone(spark):
    draw = random.Random(1)
    rows, marks = [], []
    for k in range(900):
        words = [draw.choice(WORDS) for _ in range(draw.randint(5, 60))]
        bad = k % 4 == 0
        if bad:
            words.insert(draw.randrange(len(words)), draw.choice(["vileword", "nastyterm"]))
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad)))
    extra = [(10_000, None), (10_001, ""), (None, "the river"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "doc_id AS score", "text AS y")
    labels = spark.createDataFrame(marks + [(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == len(rows) + len(extra)
    truth = dict(marks)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in found)
    assert toxicity.classify(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_estimated_accuracies():
    draw = np.random.default_rng(3)
    truth = draw.random(20000) < 0.85
    # As labellers are meant to be, these rarely vote against what is good.
    skill = [(0.003, 0.6), (0.004, 0.5), (0.002, 0.8), (0.005, 0.55), (0.003, 0.7)]
    votes = np.array([np.where(draw.random(20000) < 0.1, 0, np.where(draw.random(20000) < np.where(truth, g, b), -1, 1)) for g, b in skill]).T
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.estimate(patterns, counts)
    # Nearly as good as with the shares from which the votes were drawn.
    known = weak_labels.LabelModel(0.85, np.array([[[b, 1 - b], [g, 1 - g]] for g, b in skill]))
    right = lambda m: np.mean((m.posterior(votes) >= 0.5) == truth)
    assert right(model) > right(known) - 0.02
    assert abs(model.prior - 0.85) < 0.1
    assert np.allclose(weak_labels.estimate(votes, np.ones(len(votes))).posterior(patterns), model.posterior(patterns), atol=1e-3)


def test_a_useless_labeller_counts_for_nothing():
    draw = np.random.default_rng(3)
    truth = draw.random(20000) < 0.85
    skill = [(0.003, 0.6), (0.004, 0.5), (0.002, 0.8), (0.005, 0.55), (0.003, 0.7), (0.5, 0.5)]
    votes = np.array([np.where(draw.random(20000) < 0.1, 0, np.where(draw.random(20000) < np.where(truth, g, b), -1, 1)) for g, b in skill]).T
    model = weak_labels.estimate(*np.unique(votes, axis=0, return_counts=True))
    known = weak_labels.LabelModel(0.85, np.array([[[b, 1 - b], [g, 1 - g]] for g, b in skill]))
    assert np.allclose(model.accuracies(), known.accuracies(), atol=0.02)
    gains = np.log(model.tables[-1, 1]) - np.log(model.tables[-1, 0])
    assert np.abs(gains).max() < 0.1


def plain_estimate(rows, rounds):
    """The same by loops over single rows."""
    good = []
    for r in rows:
        g = 1 / (1 + math.exp(-2.0 * sum(r)))
        good.append(min(g, 0.3) if -1 in r else g)
    for _ in range(rounds):
        tables = []
        for k in range(len(rows[0])):
            sides = []
            for side in (0, 1):
                against, for_ = weak_labels.BELIEF_VOTES * weak_labels.AGAINST[side], weak_labels.BELIEF_VOTES * (1 - weak_labels.AGAINST[side])
                for r, g in zip(rows, good, strict=True):
                    weight = g if side else 1 - g
                    against, for_ = against + weight * (r[k] < 0), for_ + weight * (r[k] > 0)
                sides.append((against / (against + for_), for_ / (against + for_)))
            tables.append(sides)
        prior = min(0.99, max(0.01, (sum(good) + 1) / (len(rows) + 2)))
        good = []
        for r in rows:
            odds = prior / (1 - prior)
            for vote, (bad, fine) in zip(r, tables, strict=True):
                if vote:
                    odds *= fine[vote > 0] / bad[vote > 0]
            good.append(odds / (1 + odds))
    return tables, prior, good


def drawn(skill, share, n, abstain=0.0):
    draw = np.random.default_rng(1)
    truth = draw.random(n) < share
    return truth, np.array([np.where(draw.random(n) < abstain, 0, np.where(draw.random(n) < np.where(truth, g, b), -1, 1)) for g, b in skill]).T


def test_estimates_are_those_of_plain_loops():
    _, votes = drawn([(0.1, 0.8), (0.3, 0.6), (0.05, 0.5), (0.4, 0.4)], 0.6, 300, 0.2)
    tables, prior, good = plain_estimate(votes.tolist(), 25)
    model = weak_labels.estimate(votes, np.ones(len(votes)), rounds=25)
    assert np.allclose(model.tables, tables, atol=1e-9) and abs(model.prior - prior) < 1e-9
    assert np.allclose(model.posterior(votes), good, atol=1e-9)


def test_unlike_accuracies_are_recovered():
    skill = [(0.20, 0.90), (0.05, 0.95), (0.40, 0.45), (0.10, 0.80), (0.02, 0.70)]
    for abstain, least in ((0.0, 0.97), (0.3, 0.94)):
        truth, votes = drawn(skill, 0.7, 50_000, abstain)
        model = weak_labels.estimate(*np.unique(votes, axis=0, return_counts=True))
        assert np.mean((model.posterior(votes) >= 0.5) == truth) > least and abs(model.prior - 0.7) < 0.02
        found = model.tables[:, :, 0]
        assert np.allclose(found, [(b, g) for g, b in skill], atol=0.03), found
        right = [np.mean((votes[:, k] > 0)[votes[:, k] != 0] == truth[votes[:, k] != 0]) for k in range(len(skill))]
        assert np.allclose(model.accuracies(), right, atol=0.05)


def test_samples_are_bounded_and_never_empty(spark):
    many = spark.range(20_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    assert 100 < common.bounded_sample(many, 200, 7, "doc_id", "text").count() < 400
    assert common.bounded_sample(many, 30_000, 7, "doc_id", "text").count() == 20_000
    # One id for all rows, then one row for all.
    for one in (many.selectExpr("7L AS doc_id", "text"), many.selectExpr("cast(null AS long) AS doc_id", "text"), many.selectExpr("7L AS doc_id", "'x' AS text")):
        assert 100 <= common.bounded_sample(one, 200, 7, "doc_id", "text").count() < 400
    tiny = common.bounded_sample(many, 1, 3, "doc_id", "text").count()
    assert 1 <= tiny <= 2
    sized = many.selectExpr("xxhash64(doc_id) AS _hash", "10L AS size")
    assert common.up_to(sized, "size", 1000).count() == 100 and common.up_to(sized, "size", 10**9).count() == 20_000


def test_long_texts_and_accuracies(spark):
    draw = random.Random(6)
    rows = [(k, " ".join(draw.choice(WORDS) for _ in range(40))) for k in range(60)] + [(100, " ".join(draw.choice(WORDS) for _ in range(400_000))), (101, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in weak_labels.classify(docs).collect()}
    assert len(found) == 62 and found[100].kept
    marks = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert toxicity.classify(docs, marks).count() == 62
    table = weak_labels.accuracy_table(docs).collect()
    assert [r.labeller for r in table] == [x.name for x in weak_labels.LABELLERS] and all(0 < r.accuracy <= 1 for r in table)


def test_toxicity_against_a_second_implementation(spark):
    """Log-count ratios, the choice of n-grams and scores by dictionaries."""
    draw = random.Random(2)
    rows = [(k, " ".join([*(draw.choice(WORDS) for _ in range(12)), *(["vileword"] if k % 3 == 0 else [])]), float(k % 3 == 0)) for k in range(90)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, y double"))
    seen = [{int(b) for _, bucket in linear.grams([t]) for b in bucket} for _, t, _ in rows]
    pos, neg = Counter(), Counter()
    for own, (_, _, y) in zip(seen, rows, strict=True):
        (pos if y else neg).update(own)
    both = sorted({*pos, *neg})
    sum_pos, sum_neg = (sum(c[b] + 1.0 for b in both) for c in (pos, neg))
    ratio = {b: math.log((pos[b] + 1.0) / sum_pos) - math.log((neg[b] + 1.0) / sum_neg) for b in both}
    n, n_pos = len(rows), sum(y for _, _, y in rows)

    def chi2(b):
        total = pos[b] + neg[b]
        expected = total * n_pos / n
        return (pos[b] - expected) ** 2 / (expected * (1 - n_pos / n) * (1 - total / (n + 1)))

    chosen = {b for b in both if pos[b] + neg[b] >= toxicity.LEAST_DOCUMENTS and abs(ratio[b]) >= toxicity.LEAST_RATIO and chi2(b) >= toxicity.LEAST_CHI2}
    assert {int(b) for b in np.flatnonzero(model.weights)} <= chosen and len(chosen) > 5
    assert {b for b in chosen if abs(model.weights[b]) > 0} == {int(b) for b in np.flatnonzero(model.weights)}
    want = [1 / (1 + math.exp(-model.bias - sum(float(model.weights[b]) for b in own))) for own in seen]
    assert np.allclose(model.scores([t for _, t, _ in rows]), want, atol=1e-6)
    assert all((w > 0.5) == (y > 0.5) for w, (_, _, y) in zip(want, rows, strict=True))


def test_junk_goes_and_prose_stays(spark):
    draw = random.Random(4)
    prose = lambda: " ".join(draw.choice(WORDS) for _ in range(draw.randint(30, 90))).capitalize() + "."
    rows = [(k, prose()) for k in range(400)]
    junk = [" | ".join(draw.choice(WORDS) + "x" for _ in range(40)) for _ in range(20)] + [(draw.choice(WORDS) + " ") * 80 for _ in range(20)] + [prose().upper().replace(" ", "!!! ") for _ in range(20)]
    rows += [(1000 + k, t) for k, t in enumerate(junk)] + [(2000, None), (2001, ""), (None, prose()), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS kept", "text AS n_words")
    found = weak_labels.classify(docs).collect()
    assert len(found) == len(rows)
    assert all(r.kept for r in found if r.doc_id is not None and r.doc_id < 1000)
    assert np.mean([r.kept for r in found if r.doc_id is not None and 1000 <= r.doc_id < 2000]) < 0.2
    good = weak_labels.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in found)
    assert weak_labels.classify(docs.limit(0)).count() == 0
