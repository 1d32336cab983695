from collections import Counter

import pytest

from hanlake.llm import sharding
from tests.llm.helpers import documents


def test_table():
    names = sharding.shard_names(16)
    table = sharding.lookup_table(names, 1021)
    counts = Counter(table)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1021)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 15)
    assert moved < 0.15 * 1021
    for bad in (1020, 1):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 7)


def test_place(spark):
    names = sharding.shard_names(5)
    table = sharding.lookup_table(names, 31)
    rows = [(i, "t") for i in range(50)] + [(None, None), (3, "again")]
    out = sharding.place(documents(spark, rows), shards=names, size=31).collect()
    want = [(i, s := sharding._hash("" if i is None else str(i)) % 31, names[table[s]]) for i, _ in rows]
    assert sorted(map(str, ((r.doc_id, r.slot, r.shard) for r in out))) == sorted(map(str, want))
    assert sharding.place(documents(spark, [])).collect() == []
