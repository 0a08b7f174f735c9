"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

No true label is read. Labellers vote for, against or not at all; the counts of all documents by their votes, a table of
bounded size, are all that estimating needs. The posterior of a document's votes is the label from which the scorer learns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, release, scratch, session, slices, up_to
from .linear import SLICE, grams, logistic, sigmoid
from .quality_rules import SYMBOLS
from .shingles import mix, word_hashes

#: Documents that the scorer learns from, chosen by a hash of their ids: about so many where there are more.
TRAIN_ROWS = 6_000
#: n-grams in all of these documents together, 12 bytes each in the driver: fewer documents are taken if they have more.
TRAIN_ENTRIES = 8_000_000
#: Base-2 logarithm of the buckets that levels and character n-grams are hashed to; the n-grams' sizes.
BITS, SIZES = 16, (3,)
#: Shares of n-grams are of so many at least, so that a few letters decide little.
LEAST_GRAMS = 200
#: What labellers are made for: shares of votes against among bad and good documents. In estimating, this belief counts as so
#: many votes of each labeller in each class, at any number of documents, so many documents outweigh it.
AGAINST, BELIEF_VOTES = (0.3, 0.002), 30.0
#: Frequent words of four languages.
FUNCTION_WORDS = "a al and are as at au be by con das de del den der des die du ein el en es et for from he in is ist it la las le les los of on or par pour que qui sur that the this to un una und une von was with you zu".split()


#: Classes of characters, one digit for each ASCII code: 1 upper case, 2 lower case, 3 space, 4 symbol, 5 other mark or digit.
_CLASS = np.array([3 if chr(c) in " \t\n\x0b\x0c\r" else 1 if "A" <= chr(c) <= "Z" else 2 if "a" <= chr(c) <= "z" else 4 if chr(c) in SYMBOLS else 5 if 32 < c < 127 else 0 for c in range(128)] + [0], np.int64)


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts of every whole text: words, characters of words, and what labellers look for."""
    n = len(texts)
    hashes, n_words = word_hashes([x.encode() for x in texts])
    owner = np.repeat(np.arange(n), n_words)
    count = lambda which: np.bincount(owner[which], minlength=n)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) + 1
    first = np.unique(hashes ^ mix(owner.astype(np.uint64)), return_index=True)[1]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    place = np.repeat(np.arange(n) * 8, [len(x) for x in texts])
    chars = np.bincount(place + _CLASS[np.minimum(codes, 128)], minlength=8 * n).reshape(n, 8)
    return {
        "n_words": n_words,
        "n_chars": chars.sum(axis=1) - chars[:, 3],
        "n_distinct": count(first),
        "n_function": count(np.isin(hashes, _FUNCTION)),
        "n_loose": count(np.isin(hashes, _LOOSE)),
        "n_adjacent": count(again),
        "n_symbols": chars[:, 4],
        "n_upper": chars[:, 1],
        "n_lower": chars[:, 2],
        "n_other": chars[:, 4] + chars[:, 5],
    }


_FUNCTION = word_hashes([x.encode() for x in FUNCTION_WORDS])[0]
_LOOSE = word_hashes([x.encode() for x in SYMBOLS])[0]


@dataclass(frozen=True)
class Labeller:
    """Votes +1 where its value is up to `good`, -1 where it is over `bad`, and abstains elsewhere and on NaN.

    `value` is a share of which less is better; `cuts` make the levels that are hashed.
    """

    name: str
    value: Callable[[dict[str, np.ndarray]], np.ndarray]
    good: float
    bad: float
    cuts: tuple[float, ...]

    def judge(self, counts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(votes, levels); a level of 0 means that there is no value."""
        x = self.value(counts)
        known = ~np.isnan(x)
        votes = np.where(known & (x <= self.good), 1, np.where(known & (x > self.bad), -1, 0))
        return votes, np.where(known, 1 + np.searchsorted(self.cuts, np.where(known, x, 0), side="left"), 0)


def _share(part: np.ndarray, whole: np.ndarray, least: int = 1) -> np.ndarray:
    return np.where(whole >= least, part / np.maximum(whole, 1), np.nan)


_STEPS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
LABELLERS = [
    Labeller("repeats", lambda c: _share(c["n_adjacent"], c["n_words"], 5), 0.05, 0.2, _STEPS),
    Labeller("symbols", lambda c: _share(c["n_symbols"], c["n_chars"]), 0.02, 0.06, _STEPS),
    Labeller("loose_marks", lambda c: _share(c["n_loose"], c["n_words"], 5), 0.02, 0.15, _STEPS),
    Labeller("shouting", lambda c: _share(c["n_upper"], c["n_upper"] + c["n_lower"], 5), 0.25, 0.6, _STEPS),
    Labeller("no_function_words", lambda c: _share(c["n_words"] - c["n_function"], c["n_words"], 25), 0.92, 0.999, (0.5, 0.7, 0.8, 0.9, 0.95, 0.999)),
    Labeller("punctuation", lambda c: _share(c["n_other"], c["n_chars"], 150), 0.15, 0.3, _STEPS),
    Labeller("word_length", lambda c: _share(np.abs(c["n_chars"] - 6.5 * c["n_words"]), c["n_words"], 3), 4.0, 8.0, (1.0, 2.0, 3.0, 4.0, 6.0, 8.0)),
    Labeller("variety", lambda c: _share(c["n_words"] - c["n_distinct"], c["n_words"], 20), 0.75, 0.9, (0.2, 0.4, 0.6, 0.75, 0.9, 0.97)),
]


def judge(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(votes, buckets of levels), a row a text and a column a labeller."""
    counts = statistics(texts)
    found = [x.judge(counts) for x in LABELLERS]
    place = (np.arange(len(LABELLERS)) * 16 + np.array([v[1] for v in found]).T) * 40503 % (1 << BITS)
    return np.array([v[0] for v in found]).T.reshape(-1, len(LABELLERS)), place.reshape(-1, len(LABELLERS))


@dataclass
class LabelModel:
    """P(good) and, by labeller, P(vote | class) for the votes -1 and +1; class 1 is good. Who abstains says nothing."""

    prior: float
    tables: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        votes = np.asarray(votes, np.int64).reshape(-1, len(self.tables))
        gains = np.log(self.tables[:, 1]) - np.log(self.tables[:, 0])
        sums = sum(np.where(votes[:, k] == 0, 0.0, gains[k][(votes[:, k] > 0).astype(int)]) for k in range(len(self.tables)))
        return sigmoid(sums + np.log(self.prior) - np.log1p(-self.prior))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        right = self.prior * self.tables[:, 1, 1] + (1 - self.prior) * self.tables[:, 0, 0]
        wrong = self.prior * self.tables[:, 1, 0] + (1 - self.prior) * self.tables[:, 0, 1]
        return right / (right + wrong)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, begun from the votes' majority."""
    votes, counts = np.asarray(votes, np.int64), np.asarray(counts, float)
    n = votes.shape[1]
    model = LabelModel(0.8, np.full((n, 2, 2), 0.5))
    good = sigmoid(2.0 * votes.sum(axis=1))
    # A vote against is the stronger one: most labellers pass what is bad in another way.
    good = np.where((votes < 0).any(axis=1), np.minimum(good, 0.3), good)
    for _ in range(rounds):
        tables = np.empty((n, 2, 2))
        for k in range(n):
            for side, weight in ((0, counts * (1 - good)), (1, counts * good)):
                tables[k, side] = np.bincount(votes[:, k] + 1, weights=weight, minlength=3)[[0, 2]]
                against = AGAINST[side]
                tables[k, side] += BELIEF_VOTES * np.array([against, 1 - against])
        tables /= tables.sum(axis=2, keepdims=True)
        prior = float(np.clip((counts @ good + 1) / (counts.sum() + 2), 0.01, 0.99))
        new = LabelModel(prior, tables)
        moved = np.abs(new.posterior(votes) - good).max() if len(votes) else 0.0
        model, good = new, new.posterior(votes) if len(votes) else good
        if moved < 1e-6:
            break
    return model


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def label_model(docs: DataFrame) -> LabelModel:
    """Estimated from the votes on all documents. To the driver go their distinct patterns, at most 3 ** labellers."""
    n = len(LABELLERS)
    radix = 3 ** np.arange(n)

    def patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            votes, _ = judge(batch.column(1).to_pylist())
            keys, counts = np.unique((votes + 1) @ radix, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["pattern", "n"])

    seen = _texts(docs).mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect()
    if not seen:
        return LabelModel(0.5, np.full((n, 2, 2), 0.5))
    keys = np.array([x[0] for x in seen])
    return estimate(keys[:, None] // radix % 3 - 1, np.array([x[1] for x in seen]))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str], levels: np.ndarray) -> np.ndarray:
        sums = self.weights[levels].sum(axis=1)
        for owner, bucket in grams(texts, SIZES, BITS):
            n = np.maximum(np.bincount(owner, minlength=len(texts)), LEAST_GRAMS)
            sums += np.bincount(owner, weights=self.weights[bucket], minlength=len(texts)) / n
        return sigmoid(sums + self.bias)


def fit(docs: DataFrame, model: LabelModel, rows: int = TRAIN_ROWS, entries: int = TRAIN_ENTRIES) -> Scorer:
    """The scorer, from the posteriors of about `rows` documents at most, whose features are `entries` or not many more.

    Features are levels and the shares of n-grams; an empty table gives a scorer of nothing, with scores of 0.5.
    """
    chosen = bounded_sample(_texts(docs), rows, 11, "doc_id", "text")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            n, texts = batch.num_rows, batch.column(1).to_pylist()
            votes, levels = judge(texts)
            owners, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for owner, bucket in grams(texts, SIZES, BITS):
                owners.append(owner.astype(np.int64))
                buckets.append(bucket.astype(np.int64))
            keys, counts = np.unique(np.concatenate(owners) << BITS | np.concatenate(buckets), return_counts=True)
            own = keys >> BITS
            total = np.bincount(own, weights=counts, minlength=n)
            cut = np.searchsorted(own, np.arange(1, n))
            columns = [x.astype("<i4").tobytes() for x in np.split(keys & ((1 << BITS) - 1), cut)]
            values = [x.astype("<f4").tobytes() for x in np.split(counts / np.maximum(total, LEAST_GRAMS)[own], cut)]
            sizes = pa.array([len(x) // 4 for x in columns], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2), sizes, pa.array(columns, pa.binary()), pa.array(values, pa.binary()), pa.array([x.astype("<i4").tobytes() for x in levels], pa.binary()), pa.array(model.posterior(votes))], names=["_hash", "size", "columns", "values", "levels", "target"])

    keyed = chosen.withColumn("_hash", F.xxhash64("doc_id", "text"))
    table = scratch(keyed.mapInArrow(features, "_hash long, size long, columns binary, values binary, levels binary, target double"), "weak-label-rows")
    seen = up_to(table, "size", entries).drop("_hash").toArrow()
    n = seen.num_rows
    if not n:
        return Scorer(np.zeros(1 << BITS), 0.0)
    flat = lambda name, kind: np.frombuffer(b"".join(seen.column(name).to_pylist()), kind)
    levels, sizes, target = flat("levels", "<i4"), seen.column("size").to_numpy(), seen.column("target").to_numpy()
    who = np.arange(n, dtype=np.int32)
    which = np.concatenate([np.repeat(who, sizes), np.repeat(who, len(LABELLERS))])
    columns, values = np.concatenate([flat("columns", "<i4"), levels]), np.concatenate([flat("values", "<f4"), np.ones(len(levels), np.float32)])
    del seen
    weights, bias = logistic(which, columns, values, target, 1 << BITS, l2=1e-4, steps=200)
    del which, columns, values
    release(session(docs))
    return Scorer(weights, bias)


def accuracy_table(docs: DataFrame) -> DataFrame:
    """labeller, accuracy (how often it is right when it votes), against_bad and against_good (shares of votes against), as estimated from all of `docs`."""
    model = label_model(docs)
    rows = [(x.name, float(a), float(t[0, 0]), float(t[1, 0])) for x, a, t in zip(LABELLERS, model.accuracies(), model.tables, strict=True)]
    return session(docs).createDataFrame(rows, "labeller string, accuracy double, against_bad double, against_good double")


def classify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, weak_label (posterior of its votes), score and kept (score of 0.5 or more) of every row of documents.

    A null text counts as empty: labellers that need words abstain on it, and it is scored like any other. Null ids stay null, repeated rows
    are scored each and count each in estimating; other columns are ignored, whatever their names. An empty table gives none.
    """
    model = label_model(docs)
    shared = session(docs).sparkContext.broadcast((model, fit(docs, model, rows)))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value
        for batch in slices(batches, most=SLICE):
            texts = batch.column(1).to_pylist()
            votes, levels = judge(texts)
            scores = scorer.scores(texts, levels)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.posterior(votes)), pa.array(scores), pa.array(scores >= 0.5)], names=["doc_id", "weak_label", "score", "kept"])

    return _texts(docs).mapInArrow(work, "doc_id long, weak_label double, score double, kept boolean")


def keep_good(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` that score 0.5 or more, with their own columns; nulls and repeats are as in classify()."""
    shared = session(docs).sparkContext.broadcast(fit(docs, label_model(docs), rows))
    at = docs.columns.index("text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(shared.value.scores(texts, judge(texts)[1]) >= 0.5))

    return docs.mapInArrow(work, docs.schema)
