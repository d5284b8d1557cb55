"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones train linear classifiers. With the class prior ``p``, the risk is
``p * E_P[loss(g)] + max(0, E_U[loss(-g)] - p * E_P[loss(-g)])``: toxic documents among the unlabelled ones are taken out of
the risk of clean ones, and where that would turn negative the step goes the other way.

Features are the words of a text and their first letters, at several counts of distinct words. Each classifier keeps those that toxic documents
have significantly more often, and is fitted in a task of its own on a bounded sample: at most ``POSITIVES`` toxic
documents, and a part of at most ``UNLABELLED`` others, by a hash of ``doc_id``. Its weights are a few numbers per
feature kept; every document is scored with the mean of all classifiers, where it lies.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequery.llm import words
from wavequery.operators.selection import first_n

POSITIVES = 3_000
UNLABELLED = 12_000
CLASSIFIERS = 3
THRESHOLD = 0.3

LEADS = (4, 5, 6)  # letters of a word's beginning that are a feature
LEVELS = (1, 2, 4)  # a text has a feature at each level that its count of distinct words reaches
FEATURE_BITS = 20
MOST_FEATURES = 4_096  # weights of one classifier
DEVIATIONS = 7.0  # by which a feature must be more frequent in toxic documents
LEAST_DOCUMENTS = 3
STEPS, RATE, DECAY = 400, 0.05, 1e-3
REMEMBERED = 200_000

_STRIP = b".,;:!?\"'()[]{}<>*_-#$%&|/\\`~"


def word_features(word: bytes) -> tuple[int, ...]:
    """Feature numbers of a lower-case word."""
    letters = word.strip(_STRIP).decode(errors="ignore")
    names = [f"w{letters}"] if letters else []
    names += [f"{n}{letters[:n]}" for n in LEADS if len(letters) >= n]
    return tuple(xxhash.xxh3_64_intdigest(n) >> (64 - FEATURE_BITS) for n in names)


class _Features(dict):
    """Features by word, only those in ``wanted`` if it is given."""

    def __init__(self, wanted: set[int] | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = word_features(word)
        if self.wanted is not None:
            found = tuple(f for f in found if f in self.wanted)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def of(self, data: bytes) -> list[int]:
        """Numbers ``feature * len(LEVELS) + level`` of a text."""
        counts = Counter(itertools.chain.from_iterable(map(self.__getitem__, set(data.lower().split()))))
        return [f * len(LEVELS) + i for f, n in counts.items() for i, least in enumerate(LEVELS) if n >= least]


@dataclass
class Model:
    """Feature numbers (sorted), and a row of weights and a bias for each classifier."""

    features: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def scores(self, found: list[list[int]]) -> np.ndarray:
        """Mean probability of texts, given the numbers of their features."""
        if not len(self.biases):
            return np.zeros(len(found))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        row = np.repeat(np.arange(len(found)), sizes)
        feature = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum()))
        at = np.searchsorted(self.features, feature)
        known = at < len(self.features)
        known[known] = self.features[at[known]] == feature[known]
        row, at = row[known], at[known]
        total = [np.bincount(row, w[at], len(found)) + b for w, b in zip(self.weights, self.biases, strict=True)]
        return np.mean(1 / (1 + np.exp(-np.array(total))), axis=0)


def fit(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights and bias of one classifier; ``(row, feature)`` are the features that documents have."""
    size = len(LEVELS) << FEATURE_BITS
    n_toxic, n_other = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    seen = np.bincount(feature[toxic[row]], minlength=size)
    other = np.bincount(feature[~toxic[row]], minlength=size)
    # Rates are smoothed by one document, so that a feature unseen among the others is not certain.
    rate, base = seen / n_toxic, (other + 1) / (n_other + 2)
    excess = (rate - base) / np.sqrt(base * (1 - base) * (1 / n_toxic + 1 / n_other))
    excess[seen < LEAST_DOCUMENTS] = 0
    kept = np.argsort(-excess, kind="stable")[:MOST_FEATURES]
    kept = kept[excess[kept] > DEVIATIONS]
    place = np.full(size, -1, np.int64)
    place[kept] = np.arange(len(kept))
    column = place[feature]
    row, column = row[column >= 0], column[column >= 0]

    theta = np.zeros(len(kept) + 1)  # weights and bias
    theta[-1] = np.log(prior / (1 - prior))
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        score = np.bincount(row, theta[column], len(toxic)) + theta[-1]
        likely = 1 / (1 + np.exp(-score))
        log_clean = np.logaddexp(0, score)  # logistic loss of calling a document clean
        clean_risk = log_clean[~toxic].mean() - prior * log_clean[toxic].mean()
        push = np.where(toxic, -prior * likely / n_toxic, likely / n_other)
        if clean_risk >= 0:
            push += np.where(toxic, prior * (likely - 1) / n_toxic, 0)
        else:
            push = -push
        slope = np.append(np.bincount(column, push[row], len(kept)), push.sum())
        slope[:-1] += DECAY * theta[:-1]
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    # The unlabelled documents hold the prior's share of toxic ones, so their mean probability is the prior.
    score = np.bincount(row, theta[column], len(toxic))[~toxic]
    low, high = -30.0, 30.0
    while high - low > 1e-6:
        bias = (low + high) / 2
        low, high = (low, bias) if np.mean(1 / (1 + np.exp(-score - bias))) > prior else (bias, high)
    return kept, theta[:-1], bias


def _train(prior: float):
    schema = pa.schema([("features", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        held = rows.column("features").combine_chunks()
        sizes = np.diff(held.offsets.to_numpy())
        toxic = rows.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        if not toxic.any() or toxic.all():
            return schema.empty_table()
        row = np.repeat(np.arange(len(sizes)), sizes)
        features, weights, bias = fit(row, held.flatten().to_numpy(), toxic, prior)
        return pa.Table.from_pydict({"features": [features], "weights": [weights], "bias": [bias]}, schema=schema)

    return run


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Features()
    for batch in batches:
        found = [sorted(cache.of(data)) for data in words.texts(batch)]
        columns = [batch.column("part"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "toxic", "features"])


def held_out() -> Column:
    """Whether a document's label is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    classifiers: int = CLASSIFIERS,
) -> Model:
    """Classifiers from the toxic documents in ``labels`` and unlabelled ``docs``, both outside the held-out rows.

    ``prior`` is the share of toxic documents; by default that of the labelled ones. Without a toxic document there
    is no classifier, and every score is 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if not share:
        return Model(np.empty(0, np.int64), np.empty((0, 0)), np.empty(0))
    prior = min(max(prior or share, 0.001), 0.5)
    unit = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)).alias("unit")
    toxic = known.where("toxic = 1").select("doc_id", unit)
    others = docs.where("doc_id is not null").where(~held_out()).select("doc_id", unit).distinct()
    chosen_toxic = toxic.where(first_n(toxic, "unit", "doc_id", positives))
    chosen = others.where(first_n(others, "unit", "doc_id", unlabelled))
    every = F.sequence(F.lit(0), F.lit(classifiers - 1))
    sample = chosen_toxic.select("doc_id", F.lit(True).alias("toxic"), F.explode(every).alias("part")).union(
        chosen.select("doc_id", F.lit(False), F.pmod(F.hash("doc_id"), F.lit(classifiers)))
    )
    # At most classifiers * positives + unlabelled ids.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    features = texts.select("part", "toxic", "text").mapInArrow(_featured, "part int, toxic boolean, features array<int>")
    fitted = features.groupBy("part").applyInArrow(
        _train(prior), "features array<int>, weights array<double>, bias double"
    ).collect()  # at most MOST_FEATURES weights for each classifier
    names = sorted({f for r in fitted for f in r["features"]})
    place = {f: i for i, f in enumerate(names)}
    weights = np.zeros((len(fitted), len(names)))
    for i, r in enumerate(fitted):
        weights[i, [place[f] for f in r["features"]]] = r["weights"]
    return Model(np.array(names, np.int64), weights, np.array([r["bias"] for r in fitted]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) to ``docs``, replacing a column of that name.

    Null and empty texts get the score of a text without features. Null ids, repeated rows and other columns stay as
    they are. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = _Features({int(f) // len(LEVELS) for f in model.features})
        for batch in batches:
            score = model.scores([cache.of(data) for data in words.texts(batch)])
            yield batch.append_column("score", pa.array(score, pa.float64()))

    return kept.mapInArrow(run, schema)
