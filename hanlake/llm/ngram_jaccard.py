"""N-gram Jaccard join: links between texts whose word-shingle sets have similarity 0.75 or more, exactly.

Jaccard distance is a metric, but texts without a common shingle all lie at distance 1 from each other, where no text
can serve as a pivot. So there are two levels of regions:

1. Corpus level. The pivots are sets of one shingle. A set of size a that links to another has at least 3a/4 of its
   shingles in common with it, so a set whose shingles are shared by any others to a lesser extent is done. Each other
   set belongs to the region of its rarest shingle and is replicated to those of its next ones, up to the (a/4 + 1)-th
   from the rarest: two linked sets have one of these in common, in any order that is the same for all sets. Sets that
   meet in a region form blocks; frequent passages, which many unlinked texts share, hardly make regions.
2. Block level, with all shared shingles. Pivots are texts; each text belongs to its nearest pivot (Voronoi) and is replicated
   to each region whose pivot is within 2r of that (triangle inequality); what a region has not yet connected is joined
   recursively, and |d(x, p) - d(y, p)| > r rules pairs out. Links that would join texts already connected are skipped:
   the result is the components of all links.

3. A block over ``block_shingles`` goes through the same steps as tables. Rounds of pivots, a few from each slot of a hash,
   are compared with all members, in as many tasks as the block has bounds; what they link is connected, and the next pivots
   come from what isn't yet in the block's largest component. When that rest is within the bound, or shrinks no more, all
   members stand in the region of their nearest pivot, and the rest is replicated to each region whose pivot is within 2r of its
   nearest one. A region is dealt in parts of the bound, each of which meets the rest's members there. A group of near copies
   of any size thus costs its size times the pivots and the rest, not its square.

Defined results: null text, or text without words: no shingles, linked with nothing. Fewer than five words: one
shingle, the whole sequence. Repeated rows come out as often as they went in. Null doc_id: a member as any other, never
a component's name unless all ids are null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, RollingHash, binaries, keyed, longs, mix, partitions, small_batches, stage, text_bytes, text_slices, trimmed, word_spans
from .components import connected

SHINGLE_WORDS = 5
BLOCK_SHINGLES = 2_000_000


# ---------------------------------------------------------------- sets of shingles


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, stops, first = word_spans(data, offsets)
    words = mix(RollingHash(data).spans(starts, stops) + (stops - starts).astype(U64))
    n = np.diff(first)
    grams = np.zeros(max(len(words) - k + 1, 0), U64)
    for j in range(k):
        grams *= U64(0x9FB21C651E98DF25)
        grams += words[j : j + len(grams)]
    grams = mix(grams)
    out, sizes = [], np.zeros(len(n), np.int64)
    for i in range(len(n)):
        if n[i] >= k:
            own = np.unique(grams[first[i] : first[i + 1] - k + 1])
        elif n[i]:
            own = np.zeros(1, U64)
            for w in words[first[i] : first[i + 1]]:
                own = mix(own * U64(0x9FB21C651E98DF25) + w + U64(n[i]))
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def set_hashes(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values ^ U64(0x5851F42D4C957F2D)))])
    return mix(total[indptr[1:]] - total[indptr[:-1]] + np.diff(indptr).astype(U64))


# ---------------------------------------------------------------- level 1: shingles as pivots
#
# Rows of all stages are packed: a row holds many sets' shingles for one logical partition, so Spark moves bytes, not
# rows. A packed row is a count of sets, their ids and numbers of shingles, then 6 bytes for each shingle (its
# partition gives the rest of it), and in the way back a byte for its rank. Sizes go to the sets' partitions by themselves,
# as a set's shingles are spread over the more rows the more partitions there are.

ROUTED = "route int, kind int, node long, doc_id long, k_text long, n int, data binary"
#: kinds of rows: a text and its set; shingles by partition; shingles known to be common, by set; which those are; sizes of sets.
TEXT, SHINGLES, COMMON, MARKS, SIZES = 0, 1, 2, 3, 4
FLUSH_SHINGLES, LOCAL_COMMON, RANK_COMMON = 500_000, 64, 255
#: How many shingles are sorted at once where a partition's rows meet; the others wait in their packed form.
AT_ONCE = 1_000_000
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_NAMES = ["route", "kind", "node", "doc_id", "k_text", "n", "data"]


def _rows(routes, kind: int, data: list[bytes]) -> pa.RecordBatch:
    size = len(data)
    arrays = [pa.array(routes, pa.int32()), pa.array([kind] * size, pa.int32()), *(pa.nulls(size, t) for t in _KINDS[2:6]), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _partition(shingles: np.ndarray, parts: int) -> np.ndarray:
    return ((shingles >> U64(48)) * U64(parts) >> U64(16)).astype(np.int64)


def _six(shingles: np.ndarray) -> bytes:
    return np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


MOST = 65_535


def _pack(sets, owner, shingles, ranks=None) -> bytes:
    """owner: for each shingle, its set's place in sets; in order. Only sets with shingles are written; a long one as several."""
    places, counts = np.unique(owner, return_counts=True)
    if counts.max(initial=0) > MOST:
        times = -(-counts // MOST)
        last = np.cumsum(times) - 1
        rest = counts - (times - 1) * MOST
        places, counts = np.repeat(places, times), np.full(times.sum(), MOST)
        counts[last] = rest
    parts = [np.array([len(places)], "<i8"), sets[places].astype("<u8"), counts.astype("<u2")]
    return b"".join([x.tobytes() for x in parts] + [_six(shingles)] + ([] if ranks is None else [ranks.astype(np.uint8).tobytes()]))


def _unpack(data: bytes, route: int = 0, ranked: bool = False):
    """(set, shingle, rank) of each packed shingle; the shingle's upper bytes are the partition's number."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sets = np.frombuffer(data, "<u8", n, 8)
    counts = np.frombuffer(data, "<u2", n, 8 + 8 * n).astype(np.int64)
    at, total = 8 + 10 * n, int(counts.sum())
    low = np.zeros((total, 8), np.uint8)
    low[:, :6] = np.frombuffer(data, np.uint8, 6 * total, at).reshape(total, 6)
    shingles = low.view("<u8").ravel() | U64(route) << U64(48)
    ranks = np.frombuffer(data, np.uint8, total, at + 6 * total) if ranked else np.zeros(total, np.uint8)
    return np.repeat(sets, counts), shingles, ranks


def _pack_sizes(sets, sizes) -> bytes:
    return sets.astype("<u8").tobytes() + sizes.astype("<i4").tobytes()


def _unpack_sizes(data: bytes):
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i4", n, 8 * n)


def _flush(sets: list, sizes: list, shingles: list, parts: int, local_common: int) -> Iterator[pa.RecordBatch]:
    sets, sizes, values = np.concatenate(sets), np.concatenate(sizes), np.concatenate(shingles)
    owner = np.repeat(np.arange(len(sets)), sizes)
    home = (sets % U64(parts)).astype(np.int64)
    yield _rows(np.unique(home), SIZES, [_pack_sizes(sets[home == p], sizes[home == p]) for p in np.unique(home)])
    distinct, back, counts = np.unique(values, return_inverse=True, return_counts=True)
    common = counts[back] > local_common
    if common.any():
        # what many sets of this task share isn't gathered in one place: its partition gets a mark, the sets know it
        marked = distinct[counts > local_common]
        to = _partition(marked, parts)
        yield _rows(np.unique(to), MARKS, [_six(marked[to == p]) for p in np.unique(to)])
        own = values[common]
        tagged = (_partition(own, parts).astype("<u2").reshape(-1, 1).view(np.uint8), np.frombuffer(_six(own), np.uint8).reshape(-1, 6))
        places, sums = np.unique(owner[common], return_counts=True)
        head = [np.array([len(places)], "<i8"), sets[places].astype("<u8"), sizes[places].astype("<i4"), sums.astype("<i4")]
        yield _rows([int(values[0] % U64(parts))], COMMON, [b"".join(x.tobytes() for x in head) + np.hstack(tagged).tobytes()])
    owner, values = owner[~common], values[~common]
    to = _partition(values, parts)
    order = np.argsort(to, kind="stable")
    to, owner, values = to[order], owner[order], values[order]
    used, first = np.unique(to, return_index=True)
    ends = np.append(first[1:], len(to))
    for i in range(0, len(used), 64):
        yield _rows(used[i : i + 64], SHINGLES, [_pack(sets, owner[a:b], values[a:b]) for a, b in zip(first[i : i + 64], ends[i : i + 64])])


def _unpack_common(data: bytes):
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sets = np.frombuffer(data, "<u8", n, 8)
    sizes, counts = np.frombuffer(data, "<i4", 2 * n, 8 + 8 * n).reshape(2, n)
    both = np.frombuffer(data, np.uint8, 8 * int(counts.sum()), 8 + 16 * n).reshape(-1, 8)
    shingles = np.ascontiguousarray(both[:, [2, 3, 4, 5, 6, 7, 0, 1]]).view("<u8").ravel()
    return np.repeat(sets, counts), np.repeat(sizes, counts), shingles, np.full(len(shingles), RANK_COMMON, np.uint8)


def _to_partitions(parts: int, local_common: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sizes, shingles, held, serial = [], [], [], 0, 0
        for batch in text_slices(batches, "text", 2 << 20):
            values, indptr = shingle_sets(batch.column("text"))
            own, n = set_hashes(values, indptr), np.diff(indptr)
            count = batch.num_rows
            route = (np.arange(serial, serial + count) % parts).astype(np.int32)
            serial += count
            arrays = [pa.array(route), pa.array(np.zeros(count, np.int32)), pa.array(own.astype(np.int64)), batch.column("doc_id"), batch.column("k_text"), pa.array(n.astype(np.int32)), pa.nulls(count, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)
            _, once = np.unique(own, return_index=True)
            once = once[n[once] > 0]
            sets.append(own[once])
            sizes.append(n[once])
            shingles += [values[indptr[i] : indptr[i + 1]] for i in once]
            held += int(n[once].sum())
            if held >= FLUSH_SHINGLES:
                yield from _flush(sets, sizes, shingles, parts, local_common)
                sets, sizes, shingles, held = [], [], [], 0
        if held:
            yield from _flush(sets, sizes, shingles, parts, local_common)

    return of


def _by_route(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]], list[pa.RecordBatch]]]:
    """Rows sorted by route: for each route its packed rows; rows of texts are passed on as they come."""
    now, packed = None, []
    for batch in batches:
        kinds = longs(batch.column("kind"))
        if (text := kinds == TEXT).any():
            yield -1, [], [batch.filter(pa.array(text))]
        routes = longs(batch.column("route"))
        data = batch.column("data")
        for i in np.flatnonzero(~text):
            if routes[i] != now:
                if packed:
                    yield now, packed, []
                now, packed = int(routes[i]), []
            packed.append((int(kinds[i]), data[int(i)].as_py()))
    if packed:
        yield now, packed, []


def _shared_slice(own: list[bytes], route: int, i: int, slices: int, marked: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    found = []
    for data in own:
        sets, shingles, _ = _unpack(data, route)
        some = (shingles >> U64(8)) % U64(slices) == U64(i) if slices > 1 else slice(None)
        found.append((sets[some], shingles[some]))
    sets, shingles = (np.concatenate(x) for x in zip(*found))
    del found
    order = np.lexsort((sets, shingles))
    sets, shingles = sets[order], shingles[order]
    new = np.ones(len(sets), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (sets[1:] != sets[:-1])
    sets, shingles = sets[new], shingles[new]
    distinct, back, counts = np.unique(shingles, return_inverse=True, return_counts=True)
    rank = np.minimum(8 * np.log2(counts), RANK_COMMON - 1).astype(np.uint8)
    if len(marked):
        rank[np.isin(distinct, marked)] = RANK_COMMON
    rank = rank[back]
    keep = rank > 0
    sets, shingles, rank = sets[keep], shingles[keep], rank[keep]
    to = (sets % U64(parts)).astype(np.int64)
    order = np.lexsort((sets, to))
    to, sets, shingles, rank = to[order], sets[order], shingles[order], rank[order]
    used, first = np.unique(to, return_index=True)
    ends = np.append(first[1:], len(to))
    for i in range(0, len(used), 64):
        out = []
        for a, b in zip(first[i : i + 64], ends[i : i + 64]):
            one, owner = np.unique(sets[a:b], return_inverse=True)
            out.append(int(route).to_bytes(2, "little") + _pack(one, owner, shingles[a:b], rank[a:b]))
        yield _rows(used[i : i + 64], SHINGLES, out)


def _shared(parts: int):
    """In a shingle's partition: how many sets have it. Those that two or more have go back to their sets, ranked by how many."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for route, packed, texts in _by_route(batches):
            yield from texts
            yield from (_rows([i % parts], COMMON, [d]) for i, (kind, d) in enumerate(packed) if kind == COMMON)
            yield from (_rows([route], SIZES, [d]) for kind, d in packed if kind == SIZES)
            own = [d for kind, d in packed if kind == SHINGLES]
            if not own:
                continue
            marks = [d for kind, d in packed if kind == MARKS]
            low = np.zeros((sum(map(len, marks)) // 6, 8), np.uint8)
            low[:, :6] = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, 6)
            marked = low.view("<u8").ravel() | U64(route) << U64(48)
            slices = 1 + sum(map(len, own)) // (6 * AT_ONCE)
            for i in range(slices):
                yield from _shared_slice(own, route, i, slices, marked, parts)

    return of


MEMBERS = "kind int, node long, doc_id long, k_text long, n int, quota int, shingles binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a set's partition: its shared shingles, rarest first. A set that shares under 3/4 of its own links to none."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["kind", "node", "doc_id", "k_text", "n", "quota", "shingles"]
    for _, packed, texts in _by_route(batches):
        for t in texts:
            size = t.num_rows
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in names[:5]), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=names)
        if not packed:
            continue
        slices = 1 + sum(len(d) for _, d in packed) // (7 * AT_ONCE)
        for i in range(slices):
            yield from _members_slice(packed, i, slices, kinds, names)


def _members_slice(packed: list[tuple[int, bytes]], i: int, slices: int, kinds: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    found, known = [], []
    for kind, d in packed:
        if kind == SIZES:
            known.append(_unpack_sizes(d))
            continue
        if kind == SHINGLES:
            columns = _unpack(d[2:], int.from_bytes(d[:2], "little"), True)
        else:
            sets, sizes, shingles, rank = _unpack_common(d)
            columns = sets, shingles, rank
            known.append((sets, sizes))
        some = (columns[0] >> U64(32)) % U64(slices) == U64(i) if slices > 1 else slice(None)
        found.append([x[some] for x in columns])
    if not found:
        return
    sets, shingles, rank = (np.concatenate(x) for x in zip(*found))
    size_sets, at = np.unique(np.concatenate([x for x, _ in known]), return_index=True)
    sizes = np.concatenate([x for _, x in known])[at]
    del found
    order = np.lexsort((shingles, rank, sets))
    sets, shingles = sets[order], shingles[order]
    new = np.ones(len(sets), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (sets[1:] != sets[:-1])
    sets, shingles = sets[new], shingles[new]
    own, first, counts = np.unique(sets, return_index=True, return_counts=True)
    size = sizes[np.searchsorted(size_sets, own)].astype(np.int64)
    keep = np.flatnonzero(4 * counts >= 3 * size)
    quota = size // 4 + 1 - (size - counts)
    raw = shingles.astype("<u8").tobytes()
    for j in range(0, len(keep), 2_000):
        k = keep[j : j + 2_000]
        data = [raw[8 * first[x] : 8 * (first[x] + counts[x])] for x in k]
        arrays = [np.full(len(k), MEMBER, np.int32), own[k].astype(np.int64), None, None, size[k], quota[k], data]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(k), t) if x is None else pa.array(x, t) for x, t in zip(arrays, kinds)], names=names)


MEMBER = 1


def _by_set(parts: int):
    """COMMON rows hold sets of several partitions; they are dealt to the sets' ones."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = longs(batch.column("kind")) == COMMON
            if (~common).any():
                yield batch.filter(pa.array(~common))
            for data in batch.filter(pa.array(common)).column("data").to_pylist():
                sets, sizes, shingles, _ = _unpack_common(data)
                to = (sets % U64(parts)).astype(np.int64)
                for p in np.unique(to):
                    at = np.flatnonzero(to == p)
                    places, first, counts = np.unique(sets[at], return_index=True, return_counts=True)
                    order = at[np.argsort(sets[at], kind="stable")]
                    head = [np.array([len(places)], "<i8"), places.astype("<u8"), sizes[at][first].astype("<i4"), counts.astype("<i4")]
                    own = shingles[order].astype("<u8").view(np.uint8).reshape(-1, 8)
                    yield _rows([int(p)], COMMON, [b"".join(x.tobytes() for x in head) + np.ascontiguousarray(own[:, [6, 7, 0, 1, 2, 3, 4, 5]]).tobytes()])

    return of


REGIONS = "route long, u long, v long"


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One (key, smallest node) for each key, and edges from each other node of a key to that one."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(fresh)
    smallest = np.repeat(nodes[at], np.diff(np.append(at, len(keys))))
    differ = nodes != smallest
    return keys[at], nodes[at], np.unique(np.stack([nodes[differ], smallest[differ]], 1), axis=0)


def _region_rows(route, u, v=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(route.astype(np.int64)), pa.array(u.astype(np.int64)), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v.astype(np.int64))], names=["route", "u", "v"])


def _to_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, set) for the first shingles of each set; what meets in the task already is one row and edges."""
    keys, nodes, held = [], [], 0

    def emit():
        k, node, edges = _stars(np.concatenate(keys), np.concatenate(nodes))
        yield _region_rows(k, node)
        if len(edges):
            yield _region_rows(mix(edges[:, 0].astype(U64)), edges[:, 0], edges[:, 1])

    for batch in batches:
        for node, quota, data in zip(*(batch.column(c).to_pylist() for c in ("node", "quota", "shingles"))):
            keys.append(mix(np.frombuffer(data, "<u8", quota)))
            nodes.append(np.full(quota, node, np.int64))
            held += quota
        if held >= 1_000_000:
            yield from emit()
            keys, nodes, held = [], [], 0
    if held:
        yield from emit()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What meets in a region, as stars."""
    keys, nodes, edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for batch in batches:
        edge = batch.column("v").is_valid().to_numpy(zero_copy_only=False)
        route, u, v = (longs(batch.column(c)) for c in ("route", "u", "v"))
        keys.append(route[~edge])
        nodes.append(u[~edge])
        edges.append(np.stack([u[edge], v[edge]], 1))
    _, _, found = _stars(np.concatenate(keys), np.concatenate(nodes))
    edges = np.unique(np.concatenate([found, *edges]), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].astype(np.int64)), pa.array(edges[:, 1].astype(np.int64))], names=["u", "v"])


# ---------------------------------------------------------------- level 2: texts as pivots

LEAF, PIVOTS, NEAR = 64, 24, 0.25


class _Block:
    """The sets of a block, joined into components. Intersections with a set are counts over a marked universe.

    sets: of each at least its shingles that another one has, and at least one; sizes: of the whole sets.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        self.lengths = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.indptr = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = flat
        self.mark = np.zeros(flat.max() + 1, np.int64)
        self.label = np.arange(len(sets))

    def common(self, p: int, members: np.ndarray) -> np.ndarray:
        own = self.flat[self.indptr[p] : self.indptr[p + 1]]
        self.mark[own] = 1
        if len(members) == len(self.sizes):
            out = np.add.reduceat(self.mark[self.flat], self.indptr[:-1])
        else:
            first = np.concatenate([[0], np.cumsum(self.lengths[members])[:-1]])
            take = np.repeat(self.indptr[members] - first, self.lengths[members])
            out = np.add.reduceat(self.mark[self.flat[take + np.arange(len(take))]], first)
        self.mark[own] = 0
        return out

    def link(self, p: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join p with the members that it links to; which those are, and the distances to all."""
        both = self.common(p, members)
        total = self.sizes[p] + self.sizes[members]
        near = 7 * both >= 3 * total
        labels = np.unique(np.append(self.label[members[near]], self.label[p]))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
        return near, 1 - both / (total - both)

    def join(self, members: np.ndarray) -> None:
        distances, covered = [], np.zeros(len(members), bool)
        order = np.argsort(-self.sizes[members], kind="stable")
        for i in order:
            if not covered[i]:
                near, far = self.link(members[i], members)
                covered |= near
                covered[i] = True
                distances.append(far)
                if len(distances) == PIVOTS and len(members) > LEAF:
                    break
        if len(np.unique(self.label[members])) == 1:
            return
        d = np.array(distances)
        if len(members) > LEAF and len(d) > 1:
            reach = d.min(0) + 2 * NEAR + 1e-9
            regions = [np.flatnonzero(row <= reach) for row in d]
            if max(map(len, regions)) < 0.7 * len(members):
                for region in regions:
                    self.join(members[region])
                return
        labels, counts = np.unique(self.label[members], return_counts=True)
        main = labels[counts.argmax()]
        for i in np.flatnonzero(self.label[members] != main):
            window = np.flatnonzero((self.label[members] != self.label[members[i]]) & (np.abs(d - d[:, i : i + 1]) <= NEAR + 1e-9).all(0))
            if len(window):
                self.link(members[i], members[window])


def block_components(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """For each set, the index of some set of its component."""
    block = _Block(sets, sizes)
    block.join(np.arange(len(sets)))
    return block.label


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; out: each set of a block and one set of its component."""
    held: dict[int, tuple[np.ndarray, int]] = {}
    now = None

    def closed():
        nodes = np.array(list(held), np.int64)
        label = block_components([x for x, _ in held.values()], np.array([n for _, n in held.values()]))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["u", "v"])

    for batch in batches:
        for block, node, n, data in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "n", "shingles"))):
            if block != now:
                if len(held) > 1:
                    yield closed()
                now, held = block, {}
            held[node] = np.frombuffer(data, "<u8"), n
    if len(held) > 1:
        yield closed()


# ---------------------------------------------------------------- level 3: blocks as tables

EDGES = "u long, v long"
#: Pivots of a block in each round.
SLOTS = 16


def _sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all rows, one after another, and where each row's begin."""
    raw, offsets = binaries(batch.column("shingles"))
    return raw.view("<u8"), offsets // 8


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Rows sorted by place, in pieces of one place and kind and a bounded number of shingles; and whether the place is a new one."""
    now = None
    for batch in batches:
        key = np.stack([longs(batch.column("place")), longs(batch.column("kind"))], 1)
        _, offsets = _sets_of(batch)
        start = 0
        while start < batch.num_rows:
            same = np.flatnonzero((key[start:] != key[start]).any(1))
            stop = start + (int(same[0]) if len(same) else batch.num_rows - start)
            stop = max(start + 1, min(stop, int(np.searchsorted(offsets, offsets[start] + 250_000, "right")) - 1))
            place = int(key[start, 0])
            yield place != now, batch.slice(start, stop - start)
            now, start = place, stop


def _to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a place: its pivots (kind 0), then members (kind 1). Out: each member's distances to the pivots, by slot, and those it links to."""
    pivots: list[tuple[int, int, int, np.ndarray]] = []
    universe = has = None
    for fresh, batch in _by_place(batches):
        if fresh:
            pivots, universe = [], None
        values, indptr = _sets_of(batch)
        n = longs(batch.column("n"))
        nodes = longs(batch.column("node"))
        if longs(batch.column("kind"))[0] == 0:
            pivots += [(int(s), int(node), int(size), values[a:b]) for s, node, size, a, b in zip(longs(batch.column("slot")), nodes, n, indptr, indptr[1:])]
            continue
        if universe is None:
            universe = np.unique(np.concatenate([x for *_, x in pivots]))
            has = np.zeros((len(universe) + 1, len(pivots)), np.uint8)
            for k, (*_, x) in enumerate(pivots):
                has[np.searchsorted(universe, x), k] = 1
        at = np.minimum(np.searchsorted(universe, values), len(universe) - 1)
        at[universe[at] != values] = len(universe)
        both = np.add.reduceat(has[at], indptr[:-1], axis=0, dtype=np.int64)
        total = n[:, None] + np.array([size for _, _, size, _ in pivots])[None, :]
        far = np.ones((len(n), SLOTS), "<f4")
        far[:, [slot for slot, *_ in pivots]] = 1 - both / (total - both)
        near = 7 * both >= 3 * total
        pivot_nodes = np.array([node for _, node, *_ in pivots])
        hits = [pivot_nodes[row] for row in near]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("node"), pa.array([x.tobytes() for x in far], pa.binary()), pa.array(hits, pa.list_(pa.int64()))], names=["block", "node", "far", "hits"])


def _regions_of(rounds: int, all_regions: bool):
    """Adds region: that of the nearest pivot of all rounds; with all_regions each whose pivot is within 2r of that."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = np.frombuffer(binaries(batch.column("far"))[0].tobytes(), "<f4").reshape(batch.num_rows, rounds * SLOTS)
            if all_regions:
                row, region = np.nonzero(far <= far.min(1, keepdims=True) + 2 * NEAR + 1e-5)
            else:
                row, region = np.arange(batch.num_rows), far.argmin(1)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(region.astype(np.int64))], names=[*batch.schema.names, "region"])

    return of


def _rest_meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a place: members of the rest (kind 0), which are held, then other members (kind 1), a piece at a time. Out: links between
    members of different components."""
    held: list[pa.RecordBatch] = []
    for fresh, batch in _by_place(batches):
        if fresh:
            held = []
        if longs(batch.column("kind"))[0] == 0:
            held.append(batch)
            continue
        if not held:
            continue
        both = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        values, indptr = _sets_of(both)
        block = _Block([values[a:b] for a, b in zip(indptr, indptr[1:])], longs(both.column("n")))
        far = np.frombuffer(binaries(both.column("far"))[0].tobytes(), "<f4").reshape(both.num_rows, -1)
        nodes, label = longs(both.column("node")), longs(both.column("label"))
        rest = sum(x.num_rows for x in held)
        others = np.arange(rest, both.num_rows)
        found = []
        for i in range(rest):
            window = others[(label[others] != label[i]) & (np.abs(far[others] - far[i]) <= NEAR + 1e-5).all(1)]
            if len(window):
                common, total = block.common(i, window), block.sizes[i] + block.sizes[window]
                near = window[7 * common >= 3 * total]
                found.append(np.stack([np.full(len(near), nodes[i]), nodes[near]], 1))
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])


def _at_places(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "place").sortWithinPartitions("place", "kind")


def _join_large(members: DataFrame, sizes: DataFrame, bound: int, parts: int) -> DataFrame:
    """Links of blocks of any size, enough of them to connect what all links connect. members: block, node, n, shingles; sizes: block, size."""
    members = stage(members, "large")
    pieces = sizes.select("block", F.ceil(F.col("size") / bound).cast("long").alias("pieces"))
    own_edges, far, label, rest = None, None, None, members
    before, rounds = None, 0
    while True:
        slot = F.pmod(F.xxhash64("node", F.lit(rounds)), F.lit(SLOTS))
        chosen = rest.groupBy("block", slot.alias("slot")).agg(F.max_by(F.struct("node", "n", "shingles"), F.xxhash64("node")).alias("p")).select("block", "slot", "p.*")
        dealt = chosen.join(pieces, "block").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        to_all = members.join(pieces, "block").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")))
        columns = [F.xxhash64("block", "piece").alias("place"), "kind", "block", "node", "n", "slot", "shingles"]
        both = dealt.withColumn("kind", F.lit(0)).select(columns).unionByName(to_all.withColumns({"kind": F.lit(1), "slot": F.lit(0).cast("long")}).select(columns))
        found = stage(_at_places(both, parts).mapInArrow(trimmed(_to_pivots), "block long, node long, far binary, hits array<long>"), "pivots")
        edges = found.select("node", F.explode("hits").alias("v")).where("node != v").select(F.col("node").alias("u"), "v")
        own_edges = edges if own_edges is None else own_edges.unionAll(edges)
        here = found.select("block", "node", "far")
        far = here if far is None else stage(far.join(here.withColumnRenamed("far", "more"), ["block", "node"]).select("block", "node", F.concat("far", "more").alias("far")), "far")
        rounds += 1
        roots = connected(own_edges).select("node", F.col("root").alias("label"))
        label = stage(members.select("block", "node", (F.length("shingles") / 8).cast("long").alias("size")).join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
        most = label.groupBy("block", "label").agg(F.sum("size").alias("size")).groupBy("block").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
        apart = stage(label.join(most, "block").where("label != main").select("block", "node", "size"), "apart")
        left = apart.agg(F.sum("size")).first()[0] or 0
        widest = apart.groupBy("block").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] or 0
        if not left:
            return own_edges
        if widest <= bound or before is not None and left > 0.8 * before:
            break
        before, rest = left, members.join(apart.select("node"), "node", "left_semi")
    rows = members.join(far.select("node", "far"), "node").join(label.select("node", "label"), "node").select("block", "node", "n", "shingles", "far", "label")
    schema = "block long, node long, n int, shingles binary, far binary, label long, region long"
    home = rows.mapInArrow(_regions_of(rounds, False), schema)
    home = stage(home, "home")
    extent = home.groupBy("block", "region").agg(F.ceil(F.sum(F.length("shingles")) / (8 * bound)).cast("long").alias("pieces"))
    replicas = stage(rows.join(apart.select("node"), "node", "left_semi").select(rows.columns).mapInArrow(_regions_of(rounds, True), schema), "replicas")
    shares = replicas.groupBy("block", "region").agg(F.ceil(F.sum(F.length("shingles")) / (8 * bound)).cast("long").alias("shares"))
    grid = extent.join(shares, ["block", "region"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pick = lambda n: F.pmod(F.xxhash64("node", F.lit("deal")), F.col(n))
    columns = [F.xxhash64("block", "region", "piece", "share").alias("place"), "kind", "node", "n", "shingles", "far", "label"]
    a = replicas.join(grid, ["block", "region"]).withColumn("share", pick("shares")).withColumn("piece", each("pieces")).withColumn("kind", F.lit(0)).select(columns)
    b = home.join(grid, ["block", "region"]).withColumn("piece", pick("pieces")).withColumn("share", each("shares")).withColumn("kind", F.lit(1)).select(columns)
    return own_edges.unionAll(_at_places(a.unionByName(b), parts).mapInArrow(trimmed(_rest_meets), EDGES))


# ---------------------------------------------------------------- the operator


def _deal(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, F.col("route")).sortWithinPartitions("route")


def ngram_jaccard_components(docs: DataFrame, block_shingles: int = BLOCK_SHINGLES, local_common: int = LOCAL_COMMON) -> DataFrame:
    """doc_id, n_shingles, component_id (see the module's text), component (a number of it; null without shingles) and k_text,
    a hash of the row's text."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = min(partitions(spark), 1 << 16)
    rows = keyed(docs).select("doc_id", "text", "k_text")
    shared, by_set = _shared(parts), _by_set(parts)
    dealt = _deal(rows.mapInArrow(trimmed(_to_partitions(parts, local_common)), ROUTED), parts)
    found = _deal(dealt.mapInArrow(trimmed(lambda batches: by_set(shared(batches))), ROUTED), parts).mapInArrow(trimmed(_members), MEMBERS)
    found = stage(found, "members")
    texts = found.where(F.col("kind") == TEXT).select("doc_id", "node", "k_text", F.col("n").alias("n_shingles"))
    members = found.where(F.col("kind") == MEMBER).select("node", "n", "quota", "shingles")

    edges = members.select("node", "quota", "shingles").mapInArrow(trimmed(_to_regions), REGIONS).repartition(parts, "route").mapInArrow(trimmed(_meet), EDGES)
    blocks = connected(edges).select("node", F.col("root").alias("block"))
    placed = stage(members.select("node", "n", "shingles").join(blocks, "node"), "placed")
    sizes = stage(placed.groupBy("block").agg((F.sum(F.length("shingles")) / 8).cast("long").alias("size")).where(F.col("size") > block_shingles), "sizes")
    small = placed.join(sizes, "block", "left_anti") if (large := not sizes.isEmpty()) else placed
    joined = small.select("node", "n", "shingles", "block").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(trimmed(_join_blocks), EDGES)
    edges = joined.where("u != v")
    linked = connected(edges.unionAll(_join_large(placed.join(sizes.select("block"), "block"), sizes, block_shingles, parts)) if large else edges)

    # the components' names: the smallest doc_id over all texts of all their sets
    of_set = texts.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    of_set = of_set.join(linked, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    names = of_set.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of_set.join(names, "root").select("node", "component_id", F.col("root").alias("component"))
    found = texts.where("n_shingles > 0").join(named, "node").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "component", "k_text")
    alone = texts.where("n_shingles = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), "k_text")
    return found.unionByName(alone)
