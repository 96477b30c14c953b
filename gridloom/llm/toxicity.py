"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on which words and word beginnings a text holds (hashed to ``DIMS`` features) is trained in numpy from
confirmed toxic documents (P) and documents without such a confirmation (U). With the class prior pi of toxic texts in U,
the risk of the negatives is R_u(-) - pi R_p(-); wherever that falls below zero, the classifier has begun to learn the
unlabelled toxic texts by heart, and the step goes the other way (Kiryo et al. 2017).

A feature has a weight, of either sign, if its shares in P and U differ by over ``MIN_SCORE`` standard errors. (With a
weight for every feature the few hundred confirmed texts are learned by heart: at sf0.1, held out, an AUC of 0.59, not 0.97.)
Spark counts holders in a narrow map over all rows to learn from; those in P, times the confirmed ones per row of P, are
taken off for U. P is at most ``MAX_POSITIVE`` confirmed documents, and gradients of U
are taken on at most ``MAX_UNLABELLED``, those of least hash of doc_id and text: bounded samples of distinct whole texts, hashed to features by Spark
before the driver sees them. Class priors are counted over all rows. Scoring is a narrow map over all documents.

Contract: a null or empty text has no features and gets the score of the bias; documents without a label and labels
without a document are allowed, null labels count as no label, a doc_id that is labelled more than once is toxic if one
row says so; features and documents of equal hash count as one; repeated rows are scored each, alike; texts of any length
are whole; without any confirmed toxic text all scores are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

DIMS = 1 << 22
#: A feature is used if its shares differ by so many standard errors; for toxicity, if so many confirmed texts hold it.
MIN_SCORE, MIN_POSITIVE = 5.0, 3
#: Bounds of the samples that gradients are taken on.
MAX_POSITIVE, MAX_UNLABELLED = 2_000, 6_000
FOLDS, HELD_OUT_FOLD = 3, 1
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
#: Word beginnings of these lengths are features too.
PREFIXES = (4, 5, 6)


class _Words(dict):
    """Lower-case word to the hashed features of the word and its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = {b"w" + word.encode()} | {b"p" + word[:n].encode() for n in PREFIXES if len(word) >= n}
        found = tuple(zlib.crc32(x) % DIMS for x in raw)
        if len(self) >= 500_000:
            self.clear()
        self[word] = found
        return found


_words = _Words()


def features(text: str) -> np.ndarray:
    """The features present in a whole text, sorted."""
    present: set[int] = set()
    present.update(*map(_words.__getitem__, set(_WORD.findall(text.lower()))))
    return np.sort(np.fromiter(present, np.int32, len(present)))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the decimal doc_id, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def candidates(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The features that may differ by MIN_SCORE: MIN_POSITIVE of P hold them, or enough of U to show their lack in P."""
    n, m = len(positive), len(unlabelled)
    in_p = np.bincount(np.concatenate(positive), minlength=DIMS)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=DIMS)
    return np.flatnonzero((in_p >= min(MIN_POSITIVE, n)) | (in_u / m >= MIN_SCORE**2 / 2 / n))


def select(own: np.ndarray, in_p: np.ndarray, n: int, in_u: np.ndarray, m: int) -> np.ndarray:
    """Of the features ``own``, those whose shares in P and U differ by a two-proportion score of over MIN_SCORE."""
    share = (in_p + in_u + 1) / (n + m + 2)
    score = (in_p / n - in_u / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    return own[(score < -MIN_SCORE) | (score > MIN_SCORE) & (in_p >= min(MIN_POSITIVE, n))]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(x: np.ndarray, docs: tuple, n: int, m: int, prior: float, decay: float) -> tuple[float, np.ndarray]:
    """The non-negative PU risk of the logistic loss at ``x`` (the weights, then the bias), and the direction to step down.

    docs: places of the features of P and the rows that hold them, and the same of U. The direction is the risk's gradient;
    where the risk of the negatives is below zero, that of what brings it back up.
    """
    pi, po, ui, uo = docs
    size = len(x) - 1
    pz = x[size] + np.bincount(po, weights=x[pi], minlength=n)
    uz = x[size] + np.bincount(uo, weights=x[ui], minlength=m)
    ps, us = _sigmoid(pz), _sigmoid(uz)
    negative = np.mean(np.logaddexp(0, uz)) - prior * np.mean(np.logaddexp(0, pz))
    if negative >= 0:
        gp, gu = prior * (ps - 1) / n - prior * ps / n, us / m
    else:
        gp, gu = prior * ps / n, -us / m
    grad = np.bincount(np.concatenate([pi, ui]), weights=np.concatenate([gp[po], gu[uo]]), minlength=size + 1)
    grad[:size] += decay * x[:size]
    grad[size] = gp.sum() + gu.sum()
    return prior * np.mean(np.logaddexp(0, -pz)) + max(negative, 0.0) + decay / 2 * float(x[:size] @ x[:size]), grad


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[dict[int, float], float]:
    """Weights (of the ``chosen`` features) and bias that minimise the risk, by Adam on all rows."""
    place = np.full(DIMS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def compact(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = [x[x >= 0] for x in (place[r] for r in rows)]
        return np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])

    docs, size = (*compact(positive), *compact(unlabelled)), len(chosen)
    x = np.zeros(size + 1)
    x[size] = np.log(prior / (1 - prior))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        grad = risk(x, docs, len(positive), len(unlabelled), prior, decay)[1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        x -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return dict(zip(chosen.tolist(), x[:size].tolist(), strict=True)), float(x[size])


class _Present(dict):
    """Lower-case word to those of its features that are in ``weights``."""

    def __init__(self, weights: dict[int, float] | dict[int, int]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(k for k in _words[word] if k in self.weights)
        if len(self) >= 500_000:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str) -> set[int]:
        found: set[int] = set()
        found.update(*filter(None, map(self.__getitem__, set(_WORD.findall(text.lower())))))
        return found


def holders(rows: DataFrame, own: np.ndarray) -> np.ndarray:
    """How many of ``rows`` (text) hold each of the features ``own``; tasks send at most one row a feature."""
    shipped = rows.sparkSession.sparkContext.broadcast(dict.fromkeys(own.tolist(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, seen = _Present(shipped.value), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(present.of(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["feature", "c"])

    found = {r["feature"]: r["c"] for r in rows.select("text").mapInArrow(count, "feature long, c long").groupBy("feature").agg(F.sum("c").alias("c")).collect()}
    return np.array([found.get(k, 0) for k in own.tolist()], np.float64)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float]:
    """Weights and bias, learned from the rows of ``docs`` outside the held-out fold."""
    own = texts(docs).filter(fold(F.col("doc_id")) != HELD_OUT_FOLD)
    marks = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("spread", F.xxhash64("doc_id", "text"))
    known = own.select("doc_id", "spread").join(marks, "doc_id", "left")
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.count("toxic").alias("labelled"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic")).first()
    if not counts["toxic"] or counts["toxic"] == counts["n"]:
        return {}, -np.inf
    # unlabelled rows are taken to be toxic as often as labelled ones
    prior = counts["toxic"] / counts["labelled"] * (counts["n"] - counts["labelled"]) / (counts["n"] - counts["toxic"])
    prior = min(max(prior, 1e-3), 0.5)

    def sample(which: Column, n: int, toxic: int) -> DataFrame:
        return known.filter(which).select("spread").distinct().orderBy("spread").limit(n).withColumn("is_toxic", F.lit(toxic))

    is_toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    chosen = sample(is_toxic, MAX_POSITIVE, 1).union(sample(~is_toxic, MAX_UNLABELLED, 0))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()).tobytes() for t in batch.column(0)], pa.binary()), batch.column(1)], names=["features", "is_toxic"])

    # the chosen hashes are a few thousand longs at most, by the two limits above; rows of one doc_id and text are one
    kept = own.join(F.broadcast(chosen), "spread").groupBy("spread", "is_toxic").agg(F.first("text").alias("text"))
    rows = kept.select("text", "is_toxic").mapInArrow(hashed, "features binary, is_toxic int").collect()
    rows = sorted((r["is_toxic"], bytes(r["features"])) for r in rows)
    positive = [np.frombuffer(x, np.int32) for y, x in rows if y]
    unlabelled = [np.frombuffer(x, np.int32) for y, x in rows if not y]
    if not positive or not unlabelled:
        return {}, -np.inf
    own_features = candidates(positive, unlabelled)
    in_all = holders(own, own_features)
    in_p = np.bincount(np.concatenate(positive), minlength=DIMS)[own_features]
    # less the confirmed ones, of which P is all, or a sample that stands for them
    in_u = np.maximum(in_all - in_p * (counts["toxic"] / len(positive)), 0)
    chosen_features = select(own_features, in_p, len(positive), in_u, counts["n"] - counts["toxic"])
    return train(positive, unlabelled, chosen_features, prior)


def score(docs: DataFrame, weights: dict[int, float], bias: float) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)  # of features of the bounded samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, own = _Present(shipped.value), shipped.value
        for batch in batches:
            scores = []
            for text in batch.column(2):
                scores.append(float(_sigmoid(np.float64(bias + sum(own[k] for k in sorted(present.of(text.as_py())))))) if bias > -np.inf else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= THRESHOLD) for x in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = texts(docs).select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return score(docs, *fit(docs, labels))
