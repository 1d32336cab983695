"""Best-fit packing: documents into as few token sequences of a fixed length as can be found, with certificates.

A document is its ids and an end id. Only documents longer than a sequence are cut: into full pieces, of which the
first may be shorter. Full pieces are sequences of their own; all other pieces are packed whole.

Pieces are dealt to partitions of some ``PART`` pieces, whatever their documents. Each partition packs best-fit
decreasing and bounds its number of bins from below by dual feasible functions; if both are equal it is certified and
done, but for its emptiest bin. From partitions with a gap, full bins are done, and the pieces of all others are
exchanged, with those of the emptiest bins: dealt anew to fewer partitions, and packed again, until one partition is
left or a round brings no more pieces to an end. Only lengths move; ids stay where they were made.

Defined results: ids are those of the tokenizer's library with its default settings, so an added token in a text is
one id. Null text is empty, so only the end id. Repeated rows are documents of their own. Other columns are
ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import U64, mix, partitions, small_batches, stage

CAPACITY, PART, WORDS = 2048, 20_000, 250_000


class _Words(dict):
    """Word -> ids of the word behind ``before``, in two tables: a full one is kept for a while for words that come again.

    None for words with white space at an end: together with the space beside it, it may be one token.
    """

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before, self.older = encode, before, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > WORDS:
            self.older = dict(self)
            self.clear()
        if word[:1].isspace() or word[-1:].isspace():
            found = None
        else:
            found = self.older.get(word) or array("I", self.encode(self.before + word)).tobytes()
        self[word] = found
        return found


class _FastEncoder:
    """The ids of the tokenizer's library, by a compiled library of the same ranks for words that aren't known yet.

    Texts with one of the tokenizer's added tokens go to its own library, unless ``encode_special_tokens`` (as the
    library calls it) has these spelled out as ordinary text.
    """

    def __init__(self, path: str, encode_special_tokens: bool):
        import tiktoken

        v = bpe.vocabulary(path)
        self.encode_text = tiktoken.Encoding("own", pat_str=v.pieces.pattern, mergeable_ranks=v.ranks, special_tokens={}).encode_ordinary
        self.first, self.later = _Words(self.encode_text, ""), _Words(self.encode_text, " ")
        with open(path, encoding="utf-8") as file:
            self.added = [] if encode_special_tokens else [x["content"] for x in json.load(file).get("added_tokens", ())]
        self.path = path

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def learn(self, texts) -> None:
        pass

    def forget(self) -> None:
        """Gives the tables' memory back; workers outlive their tasks."""
        for words in (self.first, self.later):
            words.clear()
            words.older = {}

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if "  " not in text:
            head, space, tail = text.partition(" ")
            parts = [self.first[head]]
            if space:
                later = self.later
                parts += [later[w] for w in tail.split(" ")]
            if None not in parts:
                return b"".join(parts)
        return array("I", self.encode_text(text)).tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str, encode_special_tokens: bool = True) -> _FastEncoder:
    return _FastEncoder(path, encode_special_tokens)


# ---------------------------------------------------------------- bounds and packing of one partition


def bins_at_least(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of bins, the best of a family of dual feasible functions, in whole numbers.

    U(e): 1 above 1 - e, 0 below e, else x. u(k): x if (k+1)x is whole, else floor((k+1)x)/k. Bounds: sums of u(k)(U(e)).
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    sizes = sizes.astype(np.int64)
    epsilons = np.unique(np.append(sizes[2 * sizes <= capacity], 0))
    # for each e: pieces that count as 1 stand at the end of the sorted sizes, those that count as 0 at its beginning
    first, last = np.searchsorted(sizes, epsilons), np.searchsorted(sizes, capacity - epsilons, "right")
    many = counts.sum() - np.append(0, np.cumsum(counts))[last]
    best = 0
    for k in range(13):
        one = k * capacity if k else capacity
        value = sizes if not k else np.where((k + 1) * sizes % capacity == 0, k * sizes, capacity * ((k + 1) * sizes // capacity))
        sums = np.append(0, np.cumsum(value * counts))
        best = max(best, int((-(-(many * one + sums[last] - sums[first]) // one)).max()))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each piece, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = made = 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fit = open_rooms >> size
        if fit:
            left = size + ((fit & -fit).bit_length() - 1)
            b = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            left, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, made


# ---------------------------------------------------------------- the operator

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def _cut(path: str, end_id: int, capacity: int, keep_ids: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        enc, serial = _encoder(path, encode_special_tokens=False), bpe.task_number() << 40
        for batch, all_ids in bpe.encoded(batches, path, encoder_=enc, group_bytes=4 << 20):
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for i, ids in enumerate(all_ids):
                ids += end
                n = len(ids) // 4
                at = 0
                for p in range(-(-n // capacity)):
                    stop = at + ((n - 1) % capacity + 1 if not p else capacity)
                    part = ids[4 * at : 4 * stop]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        own.append(np.frombuffer(part, "<u4").astype(np.int32))
                    at = stop
            deal = mix(np.arange(serial, serial + len(row)).astype(U64))
            serial += len(row)
            arrays = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(deal.astype(np.int64))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        enc.forget()

    return of


def _pack_part(capacity: int, last: bool):
    def of(part: pa.Table) -> pa.Table:
        part = part.sort_by("deal")
        lengths = part.column("length").to_numpy()
        number = int(part.column("part")[0].as_py())
        bins, offsets, made = best_fit(lengths, capacity)
        certified = made == bins_at_least(lengths, capacity)
        fill = np.bincount(bins, lengths, made)
        closed = np.arange(made) != fill.argmin() if certified else fill == capacity
        done = closed[bins] | last
        names = [*part.column_names[:-1], "sequence_id", "offset", "certified"]
        arrays = [part.column(c) for c in part.column_names[:-1]]
        arrays += [pa.array(np.where(done, number << 32 | bins, 0), mask=~done), pa.array(offsets), pa.array(np.full(len(lengths), certified))]
        return pa.Table.from_arrays(arrays, names=names)

    return of


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, part: int = PART, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified (its bins were proven
    to be as few as its partition allows), and with keep_ids also its ids."""
    small_batches(docs.sparkSession)
    fields = PIECES + (", ids array<int>" if keep_ids else "")
    rows = docs.select("doc_id", "text").mapInArrow(_cut(path, end_id, capacity, keep_ids), fields)
    pieces = stage(rows, "pieces")
    columns = [c for c in pieces.columns if c != "deal"] + ["sequence_id", "offset", "certified"]
    # negative numbers for sequences of one full piece, so they never meet those of the rounds
    numbered = F.monotonically_increasing_id()
    whole = pieces.where(F.col("length") == capacity).select("*", (-1 - numbered).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    done, left = [whole.select(columns)], pieces.where(F.col("length") < capacity)
    schema = fields + ", sequence_id long, offset long, certified boolean"
    before, round_, stuck = None, 0, False
    while count := left.count():
        parts = max(1, -(-count // part))
        last = parts == 1 or stuck
        dealt = left.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(round_)), F.lit(parts)) + (F.lit(round_).cast("long") * (1 << 24)))
        packed = stage(dealt.repartition(max(1, min(parts, 64 * partitions(docs.sparkSession))), "part").groupBy("part").applyInArrow(_pack_part(capacity, last), schema), "packed")
        done.append(packed.where(F.col("sequence_id").isNotNull()).select(columns))
        left = packed.where(F.col("sequence_id").isNull()).select(pieces.columns)
        before, stuck, round_ = count, before is not None and count > 0.9 * before, round_ + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
