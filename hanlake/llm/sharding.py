"""Sharding: a lookup table of prime size, filled by the shards' permutations; placement is one lookup.

Each shard has a permutation of the slots, (offset + j * skip) mod size, from hashes of its name. Shards take turns, each
claiming the first slot of its order that is still free, until the table is full; so shards differ by one slot at most,
and few keys move when a shard comes or goes. A row's slot is a hash of its key. The table has ``size`` rows, whatever
the input, and is broadcast; rows are not shuffled, so no key is hot.

Defined results: a null key is placed like an empty text; repeated rows go to one place; an empty table has no rows. All
columns stay, but ``slot`` and ``shard`` replace columns of these names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE, SHARDS = 4099, 64


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that owns each slot."""
    if size < 2 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("there must be shards of different names, no more than slots")
    offset = [_hash(f"{s}:offset") % size for s in shards]
    skip = [_hash(f"{s}:skip") % (size - 1) + 1 for s in shards]
    owner, tried = [-1] * size, [0] * len(shards)
    for turn in range(size):
        s = turn % len(shards)
        while owner[(offset[s] + tried[s] * skip[s]) % size] >= 0:
            tried[s] += 1
        owner[(offset[s] + tried[s] * skip[s]) % size] = s
    return owner


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def place(rows: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """rows with ``slot`` and ``shard`` (a name)."""
    names = shards or shard_names()
    owners = rows.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(lookup_table(names, size))], "slot long, shard string")
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    slot = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    return rows.select(*kept, slot.alias("slot")).join(F.broadcast(owners), "slot").select(*kept, "slot", "shard")


def oracle(shards: int = SHARDS, size: int = TABLE_SIZE) -> str:
    """The same placement of documents in DuckDB's SQL; the table is filled by recursion."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name FROM range({shards}) t(i)),
orders AS (
  SELECT list({number.format("name || ':offset'")} % {size} ORDER BY i) AS start,
         list({number.format("name || ':skip'")} % {size - 1} + 1 ORDER BY i) AS skip
  FROM names
),
fill AS (
  SELECT 0 AS turn, [NULL::BIGINT for x in range({size})] AS owner
  UNION ALL
  SELECT turn + 1, owner[1:spot] || [(turn % {shards})::BIGINT] || owner[spot + 2:{size}]
  FROM (
    SELECT turn, owner,
           list_filter([(start[turn % {shards} + 1] + j * skip[turn % {shards} + 1]) % {size} for j in range({size})],
                       lambda p: owner[p + 1] IS NULL)[1] AS spot
    FROM fill, orders WHERE turn < {size}
  )
),
owners AS (SELECT unnest(owner) AS shard_no, unnest(range({size})) AS slot FROM fill WHERE turn = {size})
SELECT doc_id, d.slot, name AS shard
FROM (SELECT doc_id, {number.format("coalesce(doc_id::VARCHAR, '')")} % {size} AS slot FROM documents) d
JOIN owners USING (slot) JOIN names ON names.i = shard_no
"""
