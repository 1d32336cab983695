import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from hanlake.llm import packing
from tests.llm.helpers import documents

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """By trying all ways."""
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                put(i + 1, bins)
                bins[b] -= lengths[i]
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_bounds_and_bins(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted((rng.randrange(1, 21) for _ in range(rng.randrange(0, 9))), reverse=True), np.int64)
    bins, offsets, made = packing.best_fit(lengths, 20)
    assert packing.bins_at_least(lengths, 20) <= (fewest(lengths.tolist(), 20) if len(lengths) else 0) <= made
    placed = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        placed[b].append((o, n))
    for items in placed.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 20


@pytest.mark.parametrize("part, capacity", [(20_000, 2048), (40, 64)])
def test_pieces(spark, part, capacity):
    from tokenizers import Tokenizer

    rng = random.Random(part)
    words = ["alpha", "beta", "gamma!", "tok\nen", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 20, 30, 200, 1500])))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "alpha"), (502, "beta"), (502, "beta")]
    out = packing.pack(documents(spark, rows), PATH, capacity, part=part, keep_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        for p, a in enumerate([0, *range(first, len(ids), capacity)]):
            own = ids[a : first if not p else a + capacity]
            want[i].append((p, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own))
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32, r.ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    placed = defaultdict(list)
    for r in out:
        placed[r.sequence_id].append((r.offset, r.length))
    for items in placed.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    least = packing.bins_at_least(np.array([r.length for r in out]), capacity)
    assert least <= len(placed) <= least * 1.02 + 2


def test_ids_are_those_of_the_librarys_default_settings():
    from tokenizers import Tokenizer

    rng = random.Random(6)
    t, enc = Tokenizer.from_file(PATH), packing._encoder(PATH, encode_special_tokens=False)
    some = ["a \u00a0 \u00a0", "a \u00a0 \u00a0 b", "x\u00a0 \u00a0 y", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b  c", "\n \n b", "a \n \n", "a b\n", "\u3000 \u3000 a"]
    some += ["".join(rng.choice(["a", "bc", " ", "\u00a0", "\n", "\t", "\u3000", "<|endoftext|>", " word"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text in some:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_packed_ids_of_added_tokens_and_white_space(spark):
    from tokenizers import Tokenizer

    t, rows = Tokenizer.from_file(PATH), [(1, "a \u00a0 \u00a0"), (2, "a <|endoftext|> b")]
    out = packing.pack(documents(spark, rows), PATH, keep_ids=True).collect()
    assert {r.doc_id: r.ids for r in out} == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in rows}


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH).collect() == []


def plain_bound(lengths, capacity):
    """All thresholds and all stretchings, a piece at a time."""
    best = 0
    for e in {0, *(x for x in lengths if 2 * x <= capacity)}:
        for k in range(13):
            total = 0
            for x in lengths:
                if x > capacity - e:
                    total += 1
                elif x >= e:
                    y = Fraction(x, capacity)
                    total += y if not k or ((k + 1) * y).denominator == 1 else Fraction(math.floor((k + 1) * y), k)
            best = max(best, math.ceil(total))
    return best


@pytest.mark.parametrize("seed", range(10))
def test_bound_tries_all_thresholds(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 65) for _ in range(60)]
    assert packing.bins_at_least(np.array(lengths, np.int64), 64) == plain_bound(lengths, 64)
    assert packing.bins_at_least(np.zeros(0, np.int64), 64) == 0


def test_emptiest_bins_of_certified_partitions_meet(spark):
    rows = [(i, "alpha " * 20) for i in range(400)]
    out = packing.pack(documents(spark, rows), PATH, 64, part=20).collect()
    least = packing.bins_at_least(np.array([r.length for r in out]), 64)
    assert len({r.sequence_id for r in out}) <= least + 1
