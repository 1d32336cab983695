"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 5 characters inside the lower-cased words, with marks at the words' ends; a text
has a feature or not. The classifier learns from all labelled rows up to ``LABELLED`` of them, beyond that from about as
many, chosen by a hash of doc_id; their keys alone are broadcast, so no text moves to meet its label. All different texts
among them are counted: the log-count ratio of a feature compares how often distinct words of toxic and of other texts
have it. The ratios of all counted features, shrunk where they are uncertain, scale them, and they are weighted by
logistic regression on about ``SAMPLE`` of these texts, chosen by hash. Each step of the fit is a job over the sample's
features, which stay on the executors; the driver holds vectors as wide as the features.

Defined results: null and empty texts have the score of a text without features; rows with null labels or texts teach nothing;
without labelled texts of both kinds all scores are the (smoothed) share of toxic ones. Labelled rows of the same text and
label count once. All columns stay; ``score`` and ``predicted`` replace columns of these names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, RollingHash, binaries, mix, sized, small_batches, stage, text_slices, trimmed
from .linear import bounded_sample, least_loss

BUCKETS, SAMPLE, LABELLED, WORDS = 1 << 18, 20_000, 200_000, 120_000
AT_ONCE = 16_000
#: Ratios are shrunk the more the less certain they are, by half at so many standard errors; none is left out.
CERTAIN = 3.0
SIZES = (3, 4, 5)
#: Of the squared weights, in the loss.
DECAY = 1e-3


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, bucket) of all n-grams of some words, with a mark at either end."""
    raws = [b"\x02" + w.encode() + b"\x03" for w in words]
    ends = np.cumsum([len(r) for r in raws]) if raws else np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8)
    own = np.repeat(np.arange(len(raws)), np.diff(np.append(0, ends)))
    hashes = RollingHash(data)
    places, buckets = [], []
    for n in SIZES:
        at = np.flatnonzero(np.arange(len(data)) + n <= ends[own]) if len(data) else np.zeros(0, np.int64)
        places.append(own[at])
        buckets.append((mix(hashes.spans(at, at + n) + U64(n)) % U64(BUCKETS)).astype(np.int64))
    return np.concatenate(places), np.concatenate(buckets)


@dataclass
class Model:
    """weights: of each bucket, its weight times its ratio."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    intercept: float = 0.0


class _Table:
    """Words -> their buckets, in a table that starts anew when it knows WORDS words."""

    def __init__(self):
        self.known: dict[str, np.ndarray] = {}
        self.last = np.zeros(BUCKETS, np.int32)

    def learn(self, words: set[str]) -> None:
        if len(self.known) > WORDS:
            self.known = {}
        new = list(words - self.known.keys())
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            place, bucket = gram_buckets(some)
            flat = bucket[np.argsort(place, kind="stable")].astype(np.int32)
            ends = np.cumsum(np.bincount(place, minlength=len(some))).tolist()
            self.known.update((w, flat[a:b]) for w, a, b in zip(some, [0, *ends], ends))

    def active(self, words: dict[str, None]) -> np.ndarray:
        """The different buckets of some known words."""
        if not words:
            return np.zeros(0, np.int32)
        found = np.concatenate([self.known[w] for w in words])
        at = np.arange(len(found), dtype=np.int32)
        self.last[found] = at
        return found[self.last[found] == at]


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    """Batches, and the buckets of each text."""
    table = _Table()
    for batch in text_slices(batches, "text", 1 << 20):
        # dicts keep the order of words, so sums over them are the same on every run
        texts = [dict.fromkeys((x or "").lower().split()) for x in batch.column("text").to_pylist()]
        table.learn(set().union(*texts))
        yield batch, map(table.active, texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many n-grams of distinct words of toxic and of other texts are in each bucket, summed over the task."""
    total = np.zeros((2, BUCKETS))
    words: tuple[Counter, Counter] = (Counter(), Counter())

    def spread():
        for kind in (0, 1):
            known = list(words[kind].items())
            for i in range(0, len(known), AT_ONCE):
                some = known[i : i + AT_ONCE]
                place, bucket = gram_buckets([w for w, _ in some])
                total[kind] += np.bincount(bucket, np.array([n for _, n in some], float)[place], BUCKETS)
            words[kind].clear()

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            words[label].update(set(text.as_py().lower().split()))
            if len(words[0]) + len(words[1]) > WORDS:
                spread()
    spread()
    at = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[k][at].astype(np.int64)) for k in (0, 1))], names=["bucket", "others", "toxic"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels and buckets of texts."""
    for batch, found in _active(batches):
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x.tobytes() for x in found], pa.binary())], names=["label", "buckets"])


def _slopes(weights: np.ndarray, intercept: float):
    """Of a task's texts: the summed logistic loss, its derivative by the intercept, and by the weight of each bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, constant, slopes = 0.0, 0.0, np.zeros(len(weights))
        for batch in batches:
            raw, offsets = binaries(batch.column("buckets"))
            column, sizes = raw.view("<i4"), np.diff(offsets) // 4
            some = np.flatnonzero(sizes)
            z = np.full(len(sizes), intercept)
            if len(some):
                z[some] += np.add.reduceat(weights[column], offsets[some] // 4)
            label = batch.column("label").to_numpy()
            loss += float((np.logaddexp(0, z) - label * z).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
            constant += float(g.sum())
            slopes += np.bincount(column, np.repeat(g, sizes), len(weights))
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([constant]), pa.array([slopes.tobytes()], pa.binary())], names=["loss", "constant", "slopes"])

    return of


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: text, label (0 or 1). Only counts of at most BUCKETS rows and vectors as long reach the driver."""
    rows = labelled.select("text", F.col("label").cast("int").alias("label")).where("text is not null and label in (0, 1)")
    small_batches(rows.sparkSession)
    rows = stage(rows.withColumns({"key": F.md5(F.col("text").cast("binary")), "row": F.monotonically_increasing_id()}), "labelled")
    once = stage(rows.groupBy("key", "label").agg(F.min("row").alias("row")), "different").select("row")
    rows = rows.join(sized(once, 2 * LABELLED), "row", "left_semi").select("text", "label", "key")
    per_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(per_label.values())
    share = (per_label.get(1, 0) + 0.5) / (total + 1)
    if len(per_label) < 2:
        return Model(intercept=float(np.log(share / (1 - share))))
    counts = rows.mapInArrow(trimmed(_count), "bucket long, others long, toxic long").groupBy("bucket").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic")).toArrow()
    bucket = counts.column("bucket").to_numpy()
    q, p = counts.column("others").to_numpy() + 1.0, counts.column("toxic").to_numpy() + 1.0
    ratio = np.zeros(BUCKETS)
    ratio[bucket] = np.log(p / p.sum()) - np.log(q / q.sum())
    certain = (ratio[bucket] ** 2 / (1 / p + 1 / q)) ** 2
    ratio[bucket] *= certain / (certain + CERTAIN**4)
    taught = stage(bounded_sample(rows, sample, "key", count=total).mapInArrow(trimmed(_sampled), "label int, buckets binary"), "sample")
    taught = taught.coalesce(min(6, rows.sparkSession.sparkContext.defaultParallelism))
    count = taught.count()

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean loss and its slopes; w: a weight for each scaled bucket, and the intercept."""
        parts = taught.mapInArrow(_slopes(w[:-1] * ratio, float(w[-1])), "loss double, constant double, slopes binary").toArrow()
        slopes = np.append(sum(np.frombuffer(x.as_buffer()) for x in parts.column("slopes")) * ratio, sum(parts.column("constant").to_pylist())) / max(1, count)
        slopes[:-1] += DECAY * w[:-1]
        return sum(parts.column("loss").to_pylist()) / max(1, count) + DECAY / 2 * float(w[:-1] @ w[:-1]), slopes

    w = least_loss(loss, np.append(np.zeros(BUCKETS), np.log(share / (1 - share))))
    return Model(w[:-1] * ratio, float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 up)."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in ("score", "predicted")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        for batch, found in _active(batches):
            z = np.array([model.intercept + weights[x].sum() for x in found])
            scores = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*(f.name for f in kept), "score", "predicted"],
            )

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select([f.name for f in kept]).mapInArrow(trimmed(of), schema)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(text, label) of labelled documents that are not held out, of at most about ``most`` ids, chosen by hash.

    The ids with labels are broadcast, which is why they are bounded; no text is shuffled. A null id has no label.
    """
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    marks = stage(marks.groupBy("doc_id").agg(F.sort_array(F.collect_set("label")).alias("label")), "marks")
    marks = bounded_sample(marks, most, "doc_id")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    return rows.select("text", F.explode("label").alias("label"))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labelled documents that are not held out."""
    return fit(labelled_texts(docs, labels))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit_on_labels(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
