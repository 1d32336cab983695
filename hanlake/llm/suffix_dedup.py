"""Suffix-array dedup: every byte covered by a 400-byte string that also starts anywhere else is found, exactly.

Bucket-pointer refinement over sampled suffixes. The smallest hash among the 64-byte grams of a 400-byte string (the
leftmost, if equal) is its anchor; equal strings have equal anchors at equal places, so only anchors are sorted, one
for some 170 bytes. Neighbouring starts with the same anchor form a run.

1. The initial buckets are the anchors' grams; a bucket of one run has no repeats and is left.
2. A bucket is refined by the identifier of all that its runs cover, up to 736 bytes at later and earlier offsets:
   runs equal in it repeat as a whole, and a bucket of only such runs is done.
3. The others (at the edges of repeats) are refined once more, by the identifiers at each offset of the anchor, where
   one run stands for all that are equal as a whole.

Buckets are counted by aggregations with partial sums; none is collected, but for step 3, which handles a bucket of up
to ``bucket_runs`` different runs in memory and counts larger ones by offset in the same distributed way.

Identifiers are 64-bit hashes, compared only within a bucket, so two texts are confused with a chance of about 2**-64
for each pair of different runs with the same 64-byte gram.

Passages of words (``words=...``) go through the same steps: there a text is the 64-bit codes of its words, 8 bytes
each, so white space between words doesn't matter. Bytes and passages are both judged on the input.

Defined results: null text is empty; matches never cross texts; equal texts remove each other wholly if they have 400
bytes; repeated rows are texts of their own. Texts shorter than 400 bytes stay. Other columns are kept as they are, whatever their names.
A cut inside a UTF-8 character leaves broken bytes in ``kept``; ``drop_repeats`` leaves those out of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, RollingHash, keyed, longs, mix, partitions, plainly_named, small_batches, stage, staged, text_bytes, text_slices, trimmed, word_spans

LENGTH, GRAM = 400, 64
PASSAGE_WORDS = 51  # passages of over 50 words
BUCKET_RUNS = 8_000
SEGMENT = 1 << 23
#: Bytes of text and rows of spans that a task handles at once: some 90 (words: 140) bytes of arrays stand for a byte of text. Longer texts and larger buckets come alone.
SLICE, PIECE = 1 << 19, 2_000
CODE = 8

RUNS = "c long, f long, k_id long, k_text long, start int, stop int, anchor int"


# ---------------------------------------------------------------- runs of starts with one anchor


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[p : p + width] for each p."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    padded[: len(x)] = x
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(bucket, identifier, text, first start, last start, anchor) of each run; places count from the text's begin."""
    width = length - gram + 1
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.astype(U64), empty.astype(U64), empty, empty, empty, empty
    hashes = RollingHash(data)
    last_start = np.repeat(offsets[1:] - length, np.diff(offsets))
    found = []
    for at in range(0, len(data) - length + 1, SEGMENT):
        stop = min(at + SEGMENT, len(data) - length + 1)
        grams = np.arange(at, stop + width - 1)
        h = mix(hashes.spans(grams, grams + gram))
        anchor = (_sliding_min((h & ~U64(0xFFFFFF)) | (grams - at).astype(U64), width) & U64(0xFFFFFF)).astype(np.int64)
        valid = np.arange(at, stop) <= last_start[at:stop]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
        p1, p2 = np.flatnonzero(fresh), np.flatnonzero(ends)
        a = anchor[p1]
        found.append((h[a], p1 + at, p2 + at, a + at))
    gram_hash, p1, p2, a = (np.concatenate(x) for x in zip(*found))
    whole = mix(hashes.spans(p1, p2 + length) + (a - p1).astype(U64) * U64(0x9E3779B97F4A7C15) + (p2 - p1).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    text = np.searchsorted(offsets, p1, "right") - 1
    return mix(gram_hash + U64(gram)), whole, text, p1 - offsets[text], p2 - offsets[text], a - offsets[text]


def word_codes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """8 bytes for each word of all texts, one after another, and where each text's begin (one more than rows)."""
    data, offsets = text_bytes(array)
    starts, stops, first = word_spans(data, offsets)
    codes = mix(RollingHash(data).spans(starts, stops) + mix((stops - starts).astype(U64)))
    return codes.view(np.uint8), first.astype(np.int64) * CODE


def _runs_of(length: int, gram: int, view):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            c, f, text, p1, p2, a = runs(*view(batch.column("text")), length, gram)
            k_id, k_text = longs(batch.column("k_id")), longs(batch.column("k_text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (c.astype(np.int64), f.astype(np.int64), k_id[text], k_text[text], p1.astype(np.int32), p2.astype(np.int32), a.astype(np.int32))],
                names=["c", "f", "k_id", "k_text", "start", "stop", "anchor"],
            )

    return of


# ---------------------------------------------------------------- the last refinement

SPANS = "c long, f long, n long, runs long, k_id long, k_text long, start int, before int, bytes binary"


def _spans_of(length: int, view):
    """The bytes that each chosen run covers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            data, offsets = view(batch.column("text"))
            raw = data.tobytes()
            rows = []
            for i, (k_id, k_text, chosen) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k_id", "k_text", "chosen")))):
                for x in chosen:
                    begin = int(offsets[i]) + x["start"]
                    rows.append((x["c"], x["f"], x["n"], x["runs"], k_id, k_text, x["start"], x["anchor"] - x["start"], raw[begin : begin + x["stop"] - x["start"] + length]))
            if rows:
                kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()]
                names = ["c", "f", "n", "runs", "k_id", "k_text", "start", "before", "bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return of


def _offset_hashes(rows: pa.RecordBatch, length: int):
    """(row, offset of the anchor, identifier) for each start of each row's run."""
    lengths = np.array([len(x) for x in rows.column("bytes").to_pylist()])
    data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths)])
    starts = lengths - length + 1
    row = np.repeat(np.arange(len(lengths)), starts)
    step = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(starts)[:-1]]), starts)
    begin = first[row] + step
    offset = longs(rows.column("before"))[row] - step
    h = RollingHash(data).spans(begin, begin + length)
    return row, step, offset, mix(h + mix(longs(rows.column("c"))[row].astype(U64) + offset.astype(U64) * U64(0x9E3779B97F4A7C15)))


def _intervals(rows: pa.RecordBatch, row: np.ndarray, step: np.ndarray, length: int) -> pa.RecordBatch:
    """Repeated starts (row, step), in order, as intervals of bytes of their texts."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
    at = np.flatnonzero(fresh)
    end = np.append(at[1:], len(row)) - 1
    start = longs(rows.column("start"))[row[at]]
    return pa.RecordBatch.from_arrays(
        [pa.array(longs(rows.column(k))[row[at]]) for k in ("k_id", "k_text")]
        + [pa.array((start + step[at]).astype(np.int32)), pa.array((start + step[end] + length).astype(np.int32))],
        names=["k_id", "k_text", "start", "stop"],
    )


def _whole_classes(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in pieces of about so many rows, cut only where the column changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = longs(joined.column(column))
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                yield joined.slice(0, cut)
            held = [joined.slice(cut)]
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _refine(length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_classes(batches, "c", PIECE):
            row, step, _, h = _offset_hashes(rows, length)
            _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
            again = (counts[back] > 1) & (longs(rows.column("n"))[row] == 1)
            if again.any():
                yield _intervals(rows, row[again], step[again], length)

    return of


def _by_offset(length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                rows = batch.slice(at, PIECE)
                row, step, _, h = _offset_hashes(rows, length)
                begin = (longs(rows.column("start"))[row] + step).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.astype(np.int64))] + [pa.array(longs(rows.column(k))[row]) for k in ("n", "k_id", "k_text")] + [pa.array(begin)],
                    names=["h", "n", "k_id", "k_text", "start"],
                )

    return of


# ---------------------------------------------------------------- the operator


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_runs: int = BUCKET_RUNS, view=text_bytes) -> DataFrame:
    """(k_id, k_text, intervals): for each text with repeats, intervals of its view's bytes that cover them; they may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    rows = keyed(docs).select("text", "k_id", "k_text")
    with staged(rows.mapInArrow(trimmed(_runs_of(length, gram, view)), RUNS), "runs") as all_runs:
        counts = all_runs.groupBy("c").agg(F.count("*").alias("in_bucket"), F.min("f").alias("f1"), F.max("f").alias("f2"))
        # staged so the join below has a plain shuffle on both sides, whose hot buckets can be split
        with staged(counts.where("in_bucket > 1"), "buckets") as buckets:
            shared = stage(all_runs.join(buckets, "c").withColumn("mixed", F.col("f1") != F.col("f2")).drop("f1", "f2", "in_bucket"), "shared")
    as_interval = ["k_id", "k_text", "start", (F.col("stop") + length).cast("int").alias("stop")]

    mixed = shared.where("mixed")
    at = F.struct("k_id", "k_text", "start", "stop", "anchor")
    wholes = stage(mixed.groupBy("c", "f").agg(F.count("*").alias("n"), F.min(at).alias("at")), "wholes")
    repeated = mixed.join(wholes.where("n > 1").select("c", "f"), ["c", "f"])

    open_buckets = wholes.groupBy("c").agg(F.min("n").alias("fewest"), F.count("*").alias("runs")).where("fewest = 1")
    chosen = wholes.join(open_buckets.select("c", "runs"), "c")
    chosen = chosen.groupBy("at.k_id", "at.k_text").agg(F.collect_list(F.struct("c", "f", "n", "runs", "at.start", "at.stop", "at.anchor")).alias("chosen"))
    spans = stage(rows.dropDuplicates(["k_id", "k_text"]).join(chosen, ["k_id", "k_text"]).mapInArrow(trimmed(_spans_of(length, view)), SPANS), "spans")

    interval = "k_id long, k_text long, start int, stop int"
    small = spans.where(F.col("runs") <= bucket_runs).repartition(n, "c").sortWithinPartitions("c").mapInArrow(trimmed(_refine(length)), interval)
    parts = [shared.where("not mixed").select(as_interval), repeated.select(as_interval), small]
    large = spans.where(F.col("runs") > bucket_runs)
    if not large.isEmpty():
        offsets = large.mapInArrow(trimmed(_by_offset(length)), "h long, n long, k_id long, k_text long, start int")
        again = offsets.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h")
        parts.append(offsets.where("n = 1").join(again, "h").select("k_id", "k_text", "start", (F.col("start") + length).cast("int").alias("stop")))
    covered = parts[0]
    for part in parts[1:]:
        covered = covered.unionByName(part)
    return covered.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("start", "stop")).alias("intervals"))


def _merge(intervals: list[dict] | None) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, stop in sorted((x["start"], x["stop"]) for x in intervals or ()):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(stop, merged[-1][1])
        else:
            merged.append((start, stop))
    return merged


def _bytes_of(raw: bytes, passages: list[dict] | None) -> list[dict]:
    """Intervals of word codes as intervals of bytes, from the first whole word's start to the last one's stop."""
    if not passages:
        return []
    starts, stops, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    words = [(-(-x["start"] // CODE), x["stop"] // CODE) for x in passages]
    return [{"start": int(starts[a]), "stop": int(stops[b - 1])} for a, b in words if a < b]


def _cut(raw: bytes, merged: list[tuple[int, int]]) -> bytes:
    if not merged:
        return raw
    edges = [0, *(x for pair in merged for x in pair), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text", SLICE):
        data, offsets = text_bytes(batch.column("text"))
        raw = data.tobytes()
        out = []
        for i, (intervals, passages) in enumerate(zip(batch.column("intervals").to_pylist(), batch.column("passages").to_pylist())):
            merged = _merge(intervals)
            own = raw[offsets[i] : offsets[i + 1]]
            said = _merge(_bytes_of(own, passages))
            digest = hashlib.sha256(_cut(own, merged)).hexdigest()
            out.append((len(own), sum(b - a for a, b in merged), len(merged), digest, sum(b - a for a, b in said), len(said)))
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id")] + [pa.array(x, pa.string() if i == 3 else pa.int64()) for i, x in enumerate(cols)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages"],
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, (intervals, passages) in enumerate(zip(batch.column("intervals").to_pylist(), batch.column("passages").to_pylist())):
            if intervals or passages:
                raw = texts[i].encode()
                texts[i] = _cut(raw, _merge([*(intervals or ()), *_bytes_of(raw, passages)])).decode("utf-8", "ignore")
        names = [x for x in batch.schema.names if x not in ("intervals", "passages", "k_id", "k_text")]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == "text" else batch.column(x) for x in names], names=names)


def _with_repeats(rows: DataFrame, docs: DataFrame, words: int, options: dict) -> DataFrame:
    """The keyed rows with the intervals and, as intervals of word codes, the passages that repeat in docs (without words: null)."""
    found = repeated_intervals(docs, **options)
    rows = rows.join(found, ["k_id", "k_text"], "left")
    if not words:
        return rows.withColumn("passages", F.lit(None).cast(found.schema["intervals"].dataType))
    said = {"length": CODE * words, "gram": min(GRAM, CODE * words), "view": word_codes}
    passages = repeated_intervals(docs, **{**options, **said}).withColumnRenamed("intervals", "passages")
    return rows.join(passages, ["k_id", "k_text"], "left")


def repeat_digests(docs: DataFrame, words: int = 0, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    With words also n_passage_bytes and n_passages: bytes and maximal runs that passages of so many words cover which also start
    anywhere else. They are counted on the input, beside the strings of bytes; the other columns are the same with and without.
    """
    rows = _with_repeats(keyed(docs), docs, words, options).select("doc_id", "text", "intervals", "passages")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long"
    out = rows.mapInArrow(trimmed(_digests), columns)
    return out if words else out.drop("n_passage_bytes", "n_passages")


def drop_repeats(docs: DataFrame, words: int = 0, **options) -> DataFrame:
    """The rows and columns of docs; texts without their repeated bytes, and n_chars, if there, of the new text.

    With words, passages of so many words that also start anywhere else go too, however few bytes they have.
    """
    plain = plainly_named(docs, "doc_id", "text", "n_chars")
    others = [c for c in plain.columns if c not in ("doc_id", "text")]
    rows = _with_repeats(keyed(plain, *others), docs.select("doc_id", "text"), words, options)
    rows = rows.select(*plain.columns, "intervals", "passages")
    out = rows.mapInArrow(trimmed(_kept), T.StructType([f for f in rows.schema if f.name not in ("intervals", "passages")]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)
