"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

A task gathers the distinct words of some 24 MB of text that it does not know yet and replays the merges over all of them at
once: an inverted index leads from each rank to the positions of the token pairs that make it; ranks are taken in
order, each merge is applied at all its positions (one in a word at a time, the leftmost first), and only the touched
neighbours get new pairs, which go back to the index. A word's encoding does not depend on other words, so this is what
encoding each word alone gives. Words are then looked up; the table is dropped when it holds ``WORDS`` of them.

Texts are cut at each space first, as the pattern never joins a word to a space behind it; texts with two spaces in a
row are cut by the pattern itself. Null text is empty, and empty text has no ids. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_slices, trimmed

WORDS = 400_000
GROUP_BYTES = 24 << 20
LONG_WORD = 200
NONE = 1 << 40


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """ranks: bytes of a token -> its id, which is the rank of its merge too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.pairs = np.array([p for p, _ in pairs], np.int64)
        self.made = np.array([i for _, i in pairs], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two neighbours make, NONE if they make none."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.made[at], NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str | None = None) -> Vocabulary:
    """From a file of ranks (base64 token, id) or a tokenizer's JSON with a byte-level vocabulary."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        special = {x["content"] for x in read.get("added_tokens", ())}
        # the usual printable stand-ins for bytes: printable Latin-1 stands for itself, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in special}
    else:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, file) if token}
    return Vocabulary(ranks, pattern)


# ---------------------------------------------------------------- merge replay


def _replay_long(word: bytes, v: Vocabulary) -> np.ndarray:
    """One long word: the same replay with an index of single positions."""
    tok = v.bytes[np.frombuffer(word, np.uint8)].tolist()
    n = len(tok)
    nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
    tokens, ranks = v.tokens, v.ranks
    rank = [ranks.get(tokens[a] + tokens[b], NONE) for a, b in zip(tok, tok[1:])] + [NONE]
    heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:
            continue
        gone = nxt[i]
        tok[i], nxt[i], rank[gone], tok[gone] = r, nxt[gone], NONE, -1
        if nxt[i] >= 0:
            prv[nxt[i]] = i
        for p in (i, prv[i]):
            if p >= 0:
                rank[p] = ranks.get(tokens[tok[p]] + tokens[tok[nxt[p]]], NONE) if nxt[p] >= 0 else NONE
                if rank[p] != NONE:
                    heapq.heappush(heap, (rank[p], p))
    return np.array([t for t in tok if t >= 0], np.int64)


def merge_replay(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """The ids of each non-empty word, as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(words)
    short = []
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[i] = _replay_long(w, v).astype("<u4").tobytes()
        else:
            short.append(i)
    if not short:
        return out
    lengths = np.array([len(words[i]) for i in short])
    tok = v.bytes[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
    n = len(tok)
    first = np.concatenate([[0], np.cumsum(lengths)])
    word = np.repeat(np.arange(len(short)), lengths)
    nxt = np.arange(1, n + 1)
    nxt[first[1:] - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[first[:-1]] = -1
    rank = np.full(n, NONE)
    inner = np.flatnonzero(nxt >= 0)
    rank[inner] = v.pair_ranks(tok[inner], tok[inner + 1])
    alive = np.ones(n, bool)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(positions: np.ndarray) -> None:
        ranks = rank[positions]
        some = ranks != NONE
        positions, ranks = positions[some], ranks[some]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b, r in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                heapq.heappush(heap, r)

    add(inner)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(at) > 1:
            again = np.zeros(len(at), bool)
            again[1:] = word[at[1:]] == word[at[:-1]]
            if again.any():
                index[r] = [at[again]]
                heapq.heappush(heap, r)
                at = at[~again]
        gone = nxt[at]
        after = nxt[gone]
        tok[at], nxt[at] = r, after
        rank[gone], alive[gone] = NONE, False
        rank[at] = NONE
        has = after >= 0
        left = at[has]
        prv[after[has]] = left
        rank[left] = v.pair_ranks(tok[left], tok[after[has]])
        before = prv[at]
        has = before >= 0
        before = before[has]
        rank[before] = v.pair_ranks(tok[before], tok[at[has]])
        add(np.concatenate([before, left]))
    ids = tok[alive].astype("<u4").tobytes()
    ends = (np.cumsum(np.add.reduceat(alive.astype(np.int64), first[:-1])) * 4).tolist()
    begin = 0
    for i, end in zip(short, ends):
        out[i] = ids[begin:end]
        begin = end
    return out


class Encoder:
    """Encodes texts through tables of words; what the tables lack is replayed together."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {}

    def pieces_of(self, new: list[str]) -> list[bytes]:
        return merge_replay([p.encode() for p in new], self.v)

    def learn(self, texts: Iterable[str]) -> None:
        if len(self.later) + len(self.first) + len(self.piece) > WORDS:
            self.first, self.later, self.piece = {}, {}, {}
        first, later, odd = set(), set(), set()
        for text in texts:
            if "  " in text:
                odd.update(self.v.pieces.findall(text))
                continue
            head, _, tail = text.partition(" ")
            first.add(head)
            if _:
                later.update(tail.split(" "))
        first -= self.first.keys()
        later -= self.later.keys()
        split = self.v.pieces.findall
        cut_first = {w: split(w) for w in first}
        cut_later = {w: split(" " + w) for w in later}
        new = {p for cut in (cut_first, cut_later) for ps in cut.values() for p in ps} | odd
        new = sorted(new - self.piece.keys())
        self.piece.update(zip(new, self.pieces_of(new)))
        piece = self.piece
        self.first.update((w, b"".join([piece[p] for p in ps])) for w, ps in cut_first.items())
        self.later.update((w, b"".join([piece[p] for p in ps])) for w, ps in cut_later.items())

    def encode(self, text: str) -> bytes:
        """The ids of a text that learn() has seen since, as little-endian unsigned 32-bit integers."""
        if "  " in text:
            return b"".join([self.piece[p] for p in self.v.pieces.findall(text)])
        head, space, tail = text.partition(" ")
        if not space:
            return self.first[head]
        later = self.later
        return self.first[head] + b"".join([later[w] for w in tail.split(" ")])


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str | None = None) -> Encoder:
    return Encoder(vocabulary(path, pattern))


def encoded(batches: Iterator[pa.RecordBatch], path: str, encoder_=None, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of rows with column text, and the ids of each row."""
    enc = encoder_ or encoder(path)
    for batch in text_slices(_grouped(batches, group_bytes), "text", group_bytes):
        texts = batch.column("text").fill_null("")
        enc.learn(x.as_py() for x in texts)
        yield batch, [enc.encode(x.as_py()) for x in texts]


def _grouped(batches: Iterator[pa.RecordBatch], group_bytes: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together, to about group_bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= group_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# ---------------------------------------------------------------- the operators


def encode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """All columns of docs and ``column``, an array of the ids of text; it replaces a column of that name."""
    if column == "text":
        raise ValueError("the ids can't replace the text they are made of")
    docs = docs.drop(column)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, path):
            lengths = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            arrays = [*batch.columns, pa.ListArray.from_arrays(lengths, flat)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, column])

    from pyspark.sql import types as T

    return docs.mapInArrow(of, T.StructType([*docs.schema, T.StructField(column, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """All columns of rows and ``column``, the bytes of the ids (null ids: no bytes); it replaces a column of that name.

    An id that isn't there fails.
    """
    if column == ids:
        raise ValueError("the bytes can't replace the ids they are made of")
    rows = rows.drop(column)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            decoded = [v.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, column])

    from pyspark.sql import types as T

    return rows.mapInArrow(of, T.StructType([*rows.schema, T.StructField(column, T.BinaryType())]))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text and decodes its ids, without moving either."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch, ids in encoded(batches, path):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(v.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(of), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
