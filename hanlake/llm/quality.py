"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer taught by its posteriors.

Seven labellers vote good, bad or abstain on each text. Expectation-maximisation over the counts of vote patterns (all
texts; at most 3**7 patterns) estimates for each labeller how often it votes what, given good or bad texts, and thereby
the posterior of each pattern. A linear scorer over hashed shapes of words (case, digits and signs, repeats of the
word before) then learns the posteriors on a sample of at most about ``SAMPLE`` different texts, chosen by hash, and scores all.

Defined results: null and empty texts get the abstaining pattern's posterior, no features and so the scorer's
intercept; repeated rows count and come out as often as they go in; an empty table gives no rows. All columns stay, but
``weak_label``, ``score`` and ``kept`` replace columns of these names. No label column is read.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage, trimmed
from .linear import fit_shrunk

BUCKETS, SAMPLE, WORDS = 1 << 14, 8_000, 100_000
#: What a vote is written as in a pattern.
BAD, ABSTAIN, GOOD = 0, 1, 2
LABELLERS = ("upper case", "signs", "repeated neighbours", "repeated triples", "sentence ends", "exclamations", "bars")
_SIGNS = re.compile(r"[#*$%&|<>{}\\^~]")


def _vote(share: float, good: float, bad: float) -> int:
    return GOOD if share <= good else BAD if share >= bad else ABSTAIN


def votes(text: str, words: list[str]) -> int:
    """The pattern of the labellers' votes, in base 3."""
    n = len(words)
    if not n:
        return sum(ABSTAIN * 3**i for i in range(len(LABELLERS)))
    lower = text.lower()
    letters = len(text)
    upper = sum(map(operator.ne, text, lower)) if len(lower) == letters else sum(c != c.lower() for c in text)
    triples = list(zip(words, words[1:], words[2:]))
    ends = sum(map(text.count, (". ", ".\n", "? ", "! "))) + text.endswith((".", "!", "?"))
    found = (
        _vote(upper / letters, 0.15, 0.4),
        _vote(len(_SIGNS.findall(text)) / n, 0.02, 0.3),
        _vote(sum(map(operator.eq, words, words[1:])) / n, 0.05, 0.3),
        _vote(1 - len(set(triples)) / len(triples), 0.2, 0.6) if len(triples) >= 10 else ABSTAIN,
        BAD if n >= 60 and ends * 60 < n else GOOD if ends * 30 >= n else ABSTAIN,
        _vote(text.count("!!") / n, 0.02, 0.3),
        _vote(text.count(" | ") / n, 0.02, 0.3),
    )
    return sum(v * 3**i for i, v in enumerate(found))


# ---------------------------------------------------------------- the weak-label model


def posteriors(patterns: dict[int, int], steps: int = 100) -> dict[int, float]:
    """The chance that a text of each pattern is good, by expectation-maximisation over pattern counts."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    seen = np.array([[k // 3**i % 3 for i in range(len(LABELLERS))] for k in keys])
    # start: a bad vote of any labeller weighs more than good ones, as junk of one kind is fine by the others
    bad = (seen == BAD).sum(1)
    good = np.where(bad > 0, 0.1 / bad.clip(1), 0.5 + 0.45 * (seen == GOOD).mean(1))
    for _ in range(steps):
        prior = ((n * good).sum() + 1) / (n.sum() + 2)
        log_odds = np.full(len(keys), np.log(prior / (1 - prior)))
        for i in range(len(LABELLERS)):
            for vote in (BAD, ABSTAIN, GOOD):
                at = seen[:, i] == vote
                # smoothed by a belief that labellers are better than chance
                belief = {BAD: (0.2, 1.0), ABSTAIN: (0.5, 0.5), GOOD: (1.0, 0.5)}[vote]
                p_good = ((n * good)[at].sum() + belief[0]) / ((n * good).sum() + 1.7)
                p_bad = ((n * (1 - good))[at].sum() + belief[1]) / ((n * (1 - good)).sum() + 2.0)
                log_odds[at] += np.log(p_good / p_bad)
        good = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return dict(zip(keys, good.tolist()))


# ---------------------------------------------------------------- the scorer

_SHAPES = (re.compile("[a-zà-öø-ÿœ]+"), re.compile("[A-ZÀ-ÖØ-ÞŒ]+"), re.compile("[0-9]+"))


class _Buckets(dict):
    """word -> the bucket of its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS:
            self.clear()
        shape = word
        for pattern, mark in zip(_SHAPES, "aA0"):
            shape = pattern.sub(mark, shape)
        found = self[word] = zlib.crc32(shape.encode()) % (BUCKETS - 1)
        return found


def _features(words: list[str], table: _Buckets) -> tuple[list[int], list[float]]:
    """Shares of the words' shapes; the last bucket is the share of words equal to the one before."""
    counts: dict[int, int] = {}
    for word, times in Counter(words).items():
        b = table[word]
        counts[b] = counts.get(b, 0) + times
    again = sum(map(operator.eq, words, words[1:]))
    if again:
        counts[BUCKETS - 1] = again
    keys = sorted(counts)
    return keys, [2.0 * counts[k] / len(words) for k in keys]


@dataclass
class Model:
    posterior: dict[int, float]
    weights: dict[int, float]
    intercept: float


BALLOTS = "doc_id long, k_text long, draw long, pattern int, buckets array<int>, shares array<double>"


def _ballots(share: int):
    """Votes of all texts, and features of those whose draw is under share."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Buckets()
        for batch in batches:
            pattern, keys, values = [], [], []
            for text, draw in zip(batch.column("text"), batch.column("draw").to_pylist()):
                text = text.as_py() or ""
                words = text.split()
                pattern.append(votes(text, words))
                k, v = _features(words, table) if draw < share else (None, None)
                keys.append(k)
                values.append(v)
            arrays = [*(batch.column(c) for c in ("doc_id", "k_text", "draw")), pa.array(pattern, pa.int32()), pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "k_text", "draw", "pattern", "buckets", "shares"])

    return of


ALL = 1 << 30


def _cast(docs: DataFrame, share: int) -> DataFrame:
    """Ballots of docs (doc_id, text), written to the shared folder."""
    small_batches(docs.sparkSession)
    drawn = docs.select("doc_id", "text", F.xxhash64("text").alias("k_text"), F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(ALL)).alias("draw"))
    return stage(drawn.mapInArrow(trimmed(_ballots(share)), BALLOTS), "ballots")


def _share(count: int, sample: int) -> int:
    return ALL if count <= sample else int(sample / count * ALL)


def _fit(ballots: DataFrame, share: int) -> Model:
    posterior = posteriors({r["pattern"]: r["count"] for r in ballots.groupBy("pattern").count().collect()})
    taught = ballots.where(F.col("draw") < share).dropDuplicates(["k_text"]).select("pattern", "buckets", "shares")
    taught = sorted(tuple(r) for r in taught.collect())
    weights, intercept = fit_shrunk([r[1] for r in taught], [r[2] for r in taught], np.array([posterior[r[0]] for r in taught]), BUCKETS, l2=1e-5, steps=600)
    return Model(posterior, {int(i): float(weights[i]) for i in np.flatnonzero(weights)}, intercept)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Votes of all rows, as counts of patterns, and features of a bounded sample reach the driver."""
    share = _share(docs.count(), sample)
    return _fit(_cast(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), share), share)


def _logit(model: Model, keys, values) -> float:
    return model.intercept + sum(model.weights.get(k, 0.0) * v for k, v in zip(keys, values))


def _verdicts(z: list[float]) -> tuple[pa.Array, pa.Array]:
    scores = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
    return pa.array(scores), pa.array(scores >= 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``weak_label`` (posterior of the votes), ``score`` (the scorer's) and ``kept`` (score from 0.5 up)."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in ("weak_label", "score", "kept")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Buckets()
        for batch in batches:
            weak, z = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                words = text.split()
                weak.append(model.posterior.get(votes(text, words)))
                z.append(_logit(model, *_features(words, table)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(weak, pa.float64()), *_verdicts(z)],
                names=[*(f.name for f in kept), "weak_label", "score", "kept"],
            )

    schema = T.StructType([*kept, *T.StructType.fromDDL("weak_label double, score double, kept boolean")])
    return docs.select([f.name for f in kept]).mapInArrow(trimmed(of), schema)


def quality_scores(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, weak_label, score, kept. Each text is read once: the scorer works on the written features."""
    ballots = _cast(docs.select("doc_id", "text"), ALL)
    model = _fit(ballots, _share(ballots.count(), sample))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak = [model.posterior.get(p) for p in batch.column("pattern").to_pylist()]
            z = [_logit(model, k, v) for k, v in zip(batch.column("buckets").to_pylist(), batch.column("shares").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weak, pa.float64()), *_verdicts(z)], names=["doc_id", "weak_label", "score", "kept"])

    return ballots.select("doc_id", "pattern", "buckets", "shares").mapInArrow(trimmed(of), "doc_id long, weak_label double, score double, kept boolean")
