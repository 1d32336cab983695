import random
import re

import pytest

from hanlake.llm import ngram_jaccard as nj
from tests.llm.helpers import documents


def brute(rows):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and 100 * both >= 75 * either:
                root[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        names.setdefault(find(i), []).append(doc)
    def least(i):
        ids = [x for x in names[find(i)] if x is not None]
        return min(ids) if ids else None
    return sorted(((doc, len(sets[i]), least(i)) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            t = list(rng.choice(texts[-20:] if rng.random() < 0.5 else texts))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                if t:
                    at = rng.randrange(len(t))
                    t[at : at + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1, 2])
        else:
            t = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 20, 40, 80, 150, 400]))]
            if rng.random() < 0.3:
                t += passage
        texts.append(t)
        rows.append((i * 7 % 1000, (" " if rng.random() < 0.8 else " \n\t").join(x.upper() if rng.random() < 0.02 else x for x in t)))
    return rows


@pytest.mark.parametrize("seed, bound", [(1, nj.BLOCK_SHINGLES), (2, 500)])
def test_against_brute_force(spark, seed, bound):
    rows = [*corpus(seed), (5001, None), (5002, ""), (5003, " \n "), (None, "a b c d e f g"), (5004, "A b c d e f g"), (5004, "A b c d e f g")]
    out = nj.ngram_jaccard_components(documents(spark, rows), bound)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert nj.ngram_jaccard_components(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_blocks(seed):
    """A block's components are those of all its pairs."""
    import numpy as np
    import pyarrow as pa

    texts = [t for _, t in corpus(100 + seed, 220)]
    values, indptr = nj.shingle_sets(pa.array(texts))
    sets = [values[a:b] for a, b in zip(indptr[:-1], indptr[1:]) if a < b]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j])):
                root[find(i)] = find(j)
    label = nj.block_components(sets, np.array([len(s) for s in sets]))
    assert len({(find(i), x) for i, x in enumerate(label)}) == len({find(i) for i in range(len(sets))}) == len(set(label.tolist()))


def test_common_shingles(spark):
    """Shingles that a task knows to be common don't go to one place, and give the same result."""
    rows = corpus(11)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_jaccard_components(documents(spark, rows), local_common=2).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("bound", [200, 2_000, 20_000])
def test_one_large_group_as_tables(spark, bound):
    """Chains of near copies of a few texts, far over the bound: rounds of pivots, regions and their parts give the same components."""
    rng = random.Random(bound)
    words = [f"w{i}" for i in range(60)]
    chains = [[rng.choice(words) for _ in range(90)] for _ in range(3)]
    rows = []
    for i in range(240):
        t = chains[i % 3]
        if i % 5 == 0:
            at = rng.randrange(80)
            t[at : at + 4] = [rng.choice(words) for _ in range(4)]
        own = list(t)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(500, " ".join(chains[0] + chains[1])), (501, None), (None, rows[0][1])]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_jaccard_components(documents(spark, rows), block_shingles=bound).collect()), key=str)
    assert got == brute(rows)


def test_packed_rows_come_back():
    """Also a set with more shingles than fit one entry."""
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = [3, nj.MOST, 1, 2 * nj.MOST + 5, 0, 7]
    owner = np.repeat(np.arange(6), sizes)
    sets = rng.integers(1, 2**63, 6).astype(np.uint64)
    shingles = rng.integers(0, 2**48, len(owner)).astype(np.uint64)
    ranks = rng.integers(0, 255, len(owner)).astype(np.uint8)
    got = nj._unpack(nj._pack(sets, owner, shingles, ranks), 5, True)
    assert (got[0] == sets[owner]).all() and (got[1] == shingles + (np.uint64(5) << np.uint64(48))).all() and (got[2] == ranks).all()
    assert all((x == y).all() for x, y in zip(nj._unpack_sizes(nj._pack_sizes(sets, np.array(sizes))), (sets, sizes)))
