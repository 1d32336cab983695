"""Media columns: baseline JPEG written, parsed and decoded to coefficients in numpy; DC thumbnails and their hashes.

A payload is stored without loss in the format's own unit, the quantised coefficient: byte b is a coefficient whose
eight magnitude bits are b (b from 128 up, else b - 255), 64 a block, in zigzag order. All have run 0 and size 8, and
with a restart after each block the DC predictor is 0, so the stream is a proper baseline scan of 72 bytes a block
(before stuffing). The payload's length stands in a comment segment; blocks that fill the last row are zero bytes.

The reader is general for baseline files, grey or of several components (interleaved with any sampling factors, or a scan each):
it parses markers and tables, removes stuffing, and Huffman-decodes the scan that has the first component, whose coefficients
(luminance in the usual colour files) it keeps. Restart intervals of all files of a batch are decoded side by side, one symbol of each at a time. The thumbnail is the DC
coefficient of each block, dequantised, level-shifted and clamped; its hash compares cells of an 8 x 8 mean-pooled thumbnail with
their mean.

Damaged files (cut, wrong markers, bad codes, missing tables) have null results. Defined results of the payload
operator: null text is the empty payload of one block of zeros; equal texts have equal files and features; repeated rows
and null ids come through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_bytes, text_slices

BLOCK = 64
SLICE_BYTES = 3 << 20


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, of the one-bit code 0."""
    return bytes([kind, 1, *[0] * 15, symbol])


_TABLES = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
_HUFFMAN = _segment(0xC4, _table(0x00, 8) + _table(0x10, 8))


def write_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A JPEG file for each payload; payload lengths are positive multiples of 64."""
    sizes = np.diff(offsets) // BLOCK
    wide = np.ceil(np.sqrt(sizes)).astype(np.int64)
    high = -(-sizes // wide)
    bits = np.zeros((len(data), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(data).reshape(-1, 8)
    scan = np.packbits(bits).reshape(-1, 72)
    fill = np.packbits(np.zeros(64 * 9, np.uint8)).tobytes()
    files = []
    first = (offsets // BLOCK).tolist()
    for i, (w, h, n) in enumerate(zip(wide.tolist(), high.tolist(), sizes.tolist())):
        blocks = np.zeros((w * h, 74), np.uint8)
        blocks[:n, :72] = scan[first[i] : first[i + 1]]
        blocks[n:, :72] = np.frombuffer(fill, np.uint8)
        blocks[:, 72], blocks[:, 73] = 0xFF, 0xD0 + np.arange(w * h) % 8
        flat = blocks.ravel()[:-2]
        stuffed = flat == 0xFF
        stuffed[72::74] = False
        at = np.flatnonzero(stuffed) + 1
        body = np.insert(flat, at, 0).tobytes() if len(at) else flat.tobytes()
        files.append(
            b"\xff\xd8" + _segment(0xFE, struct.pack(">Q", n * BLOCK)) + _TABLES
            + _segment(0xC0, struct.pack(">BHHB", 8, 8 * h, 8 * w, 1) + bytes([1, 0x11, 0])) + _HUFFMAN
            + _segment(0xDD, b"\0\1") + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9"
        )
    return files


# ---------------------------------------------------------------- the reader


@dataclass
class Image:
    width: int = 0
    height: int = 0
    quantiser: np.ndarray | None = None
    factors: tuple[int, int, int, int] = (1, 1, 1, 1)  # of the first component, across and down, and the largest ones
    slots: tuple[int, ...] = (0,)  # the place in tables of each block of a scan's unit
    first: tuple[int, ...] = (0,)  # which blocks of a unit are the first component's
    tables: tuple[tuple[bytes, bytes], ...] = ()  # DC and AC, of each component of the scan
    restart: int = 0
    dc: bytes = b""
    ac: bytes = b""
    comment: bytes = b""
    scan: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    coefficients: np.ndarray | None = None  # blocks x 64, zigzag order, still quantised

    @property
    def across(self) -> int:
        return -(-self.width * self.factors[0] // (8 * self.factors[2]))

    @property
    def down(self) -> int:
        return -(-self.height * self.factors[1] // (8 * self.factors[3]))

    @property
    def blocks(self) -> int:
        return self.across * self.down

    @property
    def units(self) -> tuple[int, int]:
        """How many units the scan has, down and across; a scan of one component has single blocks as units."""
        if len(self.tables) == 1:
            return self.down, self.across
        return -(-self.height // (8 * self.factors[3])), -(-self.width // (8 * self.factors[2]))


class Damaged(ValueError):
    pass


def parse(raw: bytes) -> Image:
    """Markers and tables of a baseline file; the scan's bytes are not decoded yet."""
    if raw[:2] != b"\xff\xd8":
        raise Damaged("no start of image")
    image, at = Image(), 2
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[int, bytes] = {}
    frame: list[tuple[int, int, int, int]] = []  # identifier, factors across and down, quantiser
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise Damaged("no marker where one should be")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise Damaged("a segment is cut")
        at += 2 + size
        try:
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[129 if wide else 65 :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    if len(body) < 17 + n:
                        raise Damaged("a Huffman table is cut")
                    tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                depth, image.height, image.width, parts = struct.unpack_from(">BHHB", body)
                if depth != 8 or not 1 <= parts <= 4 or not image.height or not image.width:
                    raise Damaged("not an image of 8 bits and one to four components")
                frame = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * parts, 3)]
                if any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in frame):
                    raise Damaged("wrong sampling factors")
            elif 0xC1 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
                raise Damaged("not baseline")
            elif marker == 0xDD:
                image.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                image.comment = body
            elif marker == 0xDA:
                own = [(body[i], body[i + 1]) for i in range(1, 1 + 2 * body[0], 2)]
                if not frame or not own or not {c for c, _ in own} <= {c for c, *_ in frame}:
                    raise Damaged("a scan of unknown components")
                if frame[0][0] not in (c for c, _ in own):
                    at = _scan_end(raw, at)
                    continue
                image.tables = tuple((tables[t >> 4], tables[0x10 | t & 15]) for _, t in own)
                image.dc, image.ac = image.tables[0]
                image.quantiser = quantisers[frame[0][3]]
                image.factors = (*frame[0][1:3], max(h for _, h, _, _ in frame), max(v for _, _, v, _ in frame))
                if len(own) > 1:
                    sizes = {c: h * v for c, h, v, _ in frame}
                    image.slots = tuple(i for i, (c, _) in enumerate(own) for _ in range(sizes[c]))
                    image.first = tuple(i for i, slot in enumerate(image.slots) if own[slot][0] == frame[0][0])
                break
        except (IndexError, KeyError, struct.error, ValueError) as error:
            raise Damaged(str(error)) from error
    if len(image.tables) < len(frame):  # other scans follow
        image.scan = np.frombuffer(raw[at : _scan_end(raw, at)] + b"\xff\xd9", np.uint8)
    else:
        image.scan = np.frombuffer(raw, np.uint8)[at:]
    return image


def _scan_end(raw: bytes, at: int) -> int:
    """Where the first marker behind a scan is that is no restart."""
    while (at := raw.find(b"\xff", at)) >= 0 and at + 1 < len(raw):
        if raw[at + 1] and not 0xD0 <= raw[at + 1] <= 0xD7:
            return at
        at += 2
    raise Damaged("a scan is cut")


def _intervals(scan: np.ndarray) -> list[np.ndarray]:
    """Restart intervals without stuffing, up to the end of the image."""
    marks = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[marks + 1]
    end = marks[after == 0xD9]
    if not len(end):
        raise Damaged("no end of image")
    inside = marks < end[0]
    marks, after = marks[inside], after[inside]
    if not np.isin(after, [0, *range(0xD0, 0xD8)]).all():
        raise Damaged("a marker inside the scan")
    cuts = marks[after != 0]
    if (scan[cuts + 1] != 0xD0 + np.arange(len(cuts)) % 8).any():
        raise Damaged("restart markers are out of order")
    keep = np.ones(end[0], bool)
    keep[marks[after == 0] + 1] = False
    keep[cuts], keep[cuts + 1] = False, False
    clean = scan[: end[0]][keep]
    places = np.cumsum(keep)[cuts] if len(cuts) else np.zeros(0, np.int64)
    return np.split(clean, places)


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            if code >= 1 << length:
                raise Damaged("a Huffman table has too many codes")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[at]
            code += 1
            at += 1
        code <<= 1
    return out


def _decode_lanes(pairs: tuple[tuple[bytes, bytes], ...], slots: tuple[int, ...], lanes: list[np.ndarray], blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (blocks of all lanes x 64, DC as differences summed up for each component of a lane), and which lanes are whole."""
    tables = np.concatenate([_lookup(x) for pair in pairs for x in pair])
    slot = np.array(slots)
    sizes = np.array([len(x) for x in lanes], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 8)])
    data = np.zeros(begin[-1], np.int64)
    data[np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] = np.concatenate(lanes)
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros((first[-1], 64), np.int16)
    good = np.ones(len(lanes), bool)
    lane = np.arange(len(lanes))
    bit, limit = begin[:-1] * 8, (begin[:-1] + sizes) * 8
    block, k = first[:-1].copy(), np.zeros(len(lanes), np.int64)
    predictor = np.zeros((len(lanes), len(pairs)), np.int64)
    while len(lane):
        of = slot[(block - first[lane]) % len(slot)] if len(slot) > 1 else 0
        rows = np.arange(len(lane)) if len(slot) > 1 else slice(None)
        at = bit >> 3
        window = data[at] << 32 | data[at + 1] << 24 | data[at + 2] << 16 | data[at + 3] << 8 | data[at + 4]
        shift = bit & 7
        found = tables[(window >> (24 - shift) & 0xFFFF) + np.where(k == 0, 0, 1 << 16) + of * (1 << 17)]
        length, symbol = found >> 8, found & 0xFF
        size = symbol & 15
        run = np.where(k == 0, 0, symbol >> 4)
        value = window >> (40 - shift - length - size) & ((1 << size) - 1)
        value = np.where((size > 0) & (value < (1 << size >> 1)), value - (1 << size) + 1, value)
        bit = bit + length + size
        bad = (length == 0) | (bit > limit) | ((k == 0) & (symbol > 11)) | ((k > 0) & (size > 10))
        is_dc = k == 0
        level = predictor[rows, of] + np.where(is_dc, value, 0)
        predictor[rows, of] = level
        end = ~is_dc & (symbol == 0)
        place = k + run
        bad |= ~end & (place > 63)
        write = ~bad & ~end & ((size > 0) | is_dc)
        out[block[write], place[write]] = np.where(is_dc, level, value)[write]
        k = np.where(end, 64, place + 1)
        over = k >= 64
        block = block + over
        k = np.where(over, 0, k)
        good[lane[bad]] = False
        on = ~bad & (block < first[lane + 1])
        if not on.all():
            lane, bit, limit, block, k, predictor = (x[on] for x in (lane, bit, limit, block, k, predictor))
    return out, good


def read(files: list[bytes | None]) -> list[Image | None]:
    """Decoded images, null where a file is null or damaged. Files with equal tables are decoded together."""
    images: list[Image | None] = []
    groups: dict[tuple, list] = defaultdict(list)
    for i, raw in enumerate(files):
        try:
            image = parse(raw or b"")
            parts = _intervals(image.scan)
            units = image.units[0] * image.units[1]
            each = image.restart or units
            if len(parts) != -(-units // each):
                raise Damaged("restart intervals are missing")
            counts = np.full(len(parts), each)
            counts[-1] = units - each * (len(parts) - 1)
            groups[image.tables, image.slots].append((i, parts, counts * len(image.slots)))
            images.append(image)
        except Damaged:
            images.append(None)
    for (pairs, slots), group in groups.items():
        try:
            blocks = np.concatenate([c for _, _, c in group])
            out, good = _decode_lanes(pairs, slots, [p for _, parts, _ in group for p in parts], blocks)
        except Damaged:
            for i, _, _ in group:
                images[i] = None
            continue
        row = lane = 0
        for i, parts, counts in group:
            image = images[i]
            image.coefficients = _first_component(image, out[row : row + int(counts.sum())])
            image.scan = np.zeros(0, np.uint8)
            if not good[lane : lane + len(parts)].all():
                images[i] = None
            row += int(counts.sum())
            lane += len(parts)
    return images


def _first_component(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The first component's blocks row by row, without those that only fill units."""
    if len(image.tables) == 1:
        return blocks
    (high, wide), (h, v) = image.units, image.factors[:2]
    own = blocks.reshape(-1, len(image.slots), 64)[:, image.first].reshape(high, wide, v, h, 64)
    return own.transpose(0, 2, 1, 3, 4).reshape(high * v, wide * h, 64)[: image.down, : image.across].reshape(-1, 64)


def thumbnail(image: Image) -> np.ndarray:
    """One luminance sample a block, from its DC coefficient."""
    dc = image.coefficients[:, 0].astype(np.int64) * int(image.quantiser[0])
    return np.clip((dc + 4 >> 3) + 128, 0, 255).reshape(-1, image.across)


def thumbnail_hash(cells: np.ndarray) -> str:
    """64 bits: which cells of the 8 x 8 mean-pooled thumbnail are above their mean (whole-number arithmetic)."""
    total = np.zeros((cells.shape[0] + 1, cells.shape[1] + 1), np.int64)
    total[1:, 1:] = cells.cumsum(0).cumsum(1)
    edge = [(np.arange(9) * n // 8) for n in cells.shape]
    low, high = [e[:-1] for e in edge], [np.maximum(e[1:], e[:-1] + 1) for e in edge]
    sums = total[high[0]][:, high[1]] - total[low[0]][:, high[1]] - total[high[0]][:, low[1]] + total[low[0]][:, low[1]]
    means = sums * 4096 // np.outer(high[0] - low[0], high[1] - low[1])
    return np.packbits(64 * means.ravel() > means.sum()).tobytes().hex()


def payload_of(image: Image) -> bytes:
    """The bytes that write_payloads() stored."""
    (size,) = struct.unpack(">Q", image.comment)
    c = image.coefficients.ravel()[:size]
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()


# ---------------------------------------------------------------- the operators


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Payloads one after another, where each begins, and the lengths before padding."""
    data, offsets = text_bytes(texts)
    sizes = np.diff(offsets)
    room = np.maximum(-(-sizes // BLOCK), 1) * BLOCK
    begin = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(begin[-1], np.uint8)
    out[np.repeat(begin[:-1] - offsets[:-1], sizes) + np.arange(len(data))] = data
    return out, begin, sizes


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's payload as a JPEG file."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE_BYTES):
            data, begin, sizes = padded(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(write_payloads(data, begin), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_bytes long, media binary")


FEATURES = "width int, height int, thumbnail_hash string, thumbnail binary"


def media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns of media but the file; width, height, thumbnail_hash and thumbnail (rows of luminance bytes), which replace
    columns of these names."""
    from pyspark.sql import types as T

    made = T.StructType.fromDDL(FEATURES)
    kept = [f for f in media.schema if f.name != column and f.name not in made.names]
    media = media.select(column, *(f.name for f in kept if f.name != column))
    schema = T.StructType([*kept, *made])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sized(batches):
            images = read(batch.column(column).to_pylist())
            cells = [None if x is None else thumbnail(x) for x in images]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept]
                + [pa.array([None if x is None else getattr(x, k) for x in images], pa.int32()) for k in ("width", "height")]
                + [pa.array([None if c is None else thumbnail_hash(c) for c in cells], pa.string()), pa.array([None if c is None else c.astype(np.uint8).tobytes() for c in cells], pa.binary())],
                names=schema.names,
            )

    return media.mapInArrow(of, schema)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield batch.slice(i, 256)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each text's payload, reads the stored file back, and describes both."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE_BYTES):
            data, begin, sizes = padded(batch.column("text"))
            files = write_payloads(data, begin)
            images = read(files)
            payloads = [payload_of(x) for x in images]
            features = []
            for x in images:
                cells = thumbnail(x)
                features.append(f"{x.width}x{x.height}:{thumbnail_hash(cells)}:{zlib.crc32(cells.astype(np.uint8).tobytes()):08x}")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes), pa.array([len(x) for x in payloads], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in payloads]), pa.array([zlib.crc32(x[-BLOCK:]) for x in payloads], pa.int64()),
                    pa.array([len(x) for x in files], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in files]), pa.array(features),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(of, schema)
