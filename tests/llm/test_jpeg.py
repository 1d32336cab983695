import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hanlake.llm import jpeg
from tests.llm.helpers import documents


def texts():
    rng = random.Random(4)
    return ["", "a", "x" * 63, "x" * 64, "x" * 65, "ÿ" * 500, "\x7f\x00" * 99, *("".join(chr(rng.randrange(1, 0x2FF)) for _ in range(rng.randrange(3000))) for _ in range(20))]


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def test_round_trip_and_slow_reader():
    data, begin, _ = jpeg.padded(pa.array(texts()))
    files = jpeg.write_payloads(data, begin)
    for text, raw, image in zip(texts(), files, jpeg.read(files)):
        assert jpeg.payload_of(image) == payload(text)
        assert slow(raw) == image.coefficients.tolist()


def slow(raw):
    """One bit at a time, for files with a restart after each block or none."""
    image = jpeg.parse(raw)
    codes = []
    for table in (image.dc, image.ac):
        out, code, at = {}, 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                out[n, code] = table[at]
                code, at = code + 1, at + 1
            code *= 2
        codes.append(out)
    blocks = []
    for part in jpeg._intervals(image.scan):
        bits = "".join(f"{b:08b}" for b in part.tobytes())
        at, predictor = 0, 0

        def take(n):
            nonlocal at
            at += n
            assert at <= len(bits)
            return int(bits[at - n : at] or "0", 2)

        def symbol(kind):
            code, n = 0, 0
            while (n, code) not in codes[kind]:
                code, n = code * 2 + take(1), n + 1
                assert n < 17
            return codes[kind][n, code]

        def value(n):
            v = take(n)
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(image.restart or image.blocks):
            if len(blocks) == image.blocks:
                break
            block = [0] * 64
            predictor += value(symbol(0))
            block[0], k = predictor, 1
            while k < 64:
                s = symbol(1)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = value(s & 15)
                k += 1
            blocks.append(block)
    return blocks


def usual_file(coefficients, restart, width, height):
    """A file with codes of many lengths, zero runs and end-of-block marks."""
    def tables(symbols):
        lengths = [min(2 + i, 14) if i < 12 else 16 for i in range(len(symbols))]
        counts = [lengths.count(n) for n in range(1, 17)]
        code, out, at = 0, {}, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                out[symbols[at]] = f"{code:0{n}b}"
                code, at = code + 1, at + 1
            code *= 2
        return bytes(counts) + bytes(symbols), out

    dc_raw, dc = tables(list(range(12)))
    ac_raw, ac = tables([0, 0xF0, *(r << 4 | s for s in range(1, 11) for r in range(16))])
    def bits(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""
    parts, run, last = [], "", 0
    for i, block in enumerate(coefficients):
        if restart and i and i % restart == 0:
            parts.append(run)
            run, last = "", 0
        n, b = bits(block[0] - last)
        last, run = block[0], run + dc[n] + b
        zeros = 0
        for v in block[1:]:
            if v:
                while zeros > 15:
                    run, zeros = run + ac[0xF0], zeros - 16
                n, b = bits(v)
                run, zeros = run + ac[zeros << 4 | n] + b, 0
            else:
                zeros += 1
        if zeros:
            run += ac[0]
    parts.append(run)
    scan = b""
    for i, p in enumerate(parts):
        p += "1" * (-len(p) % 8)
        scan += (bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + bytes(int(p[j : j + 8], 2) for j in range(0, len(p), 8)).replace(b"\xff", b"\xff\0")
    seg = jpeg._segment
    return (b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes(range(1, 65))) + seg(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
            + seg(0xC4, b"\0" + dc_raw + b"\x10" + ac_raw) + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9")


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_usual_files(restart):
    rng = random.Random(restart)
    blocks = [[rng.choice([0, 0, 0, 0, 1, -1, 5, -90, 700]) if k else rng.randrange(-300, 300) for k in range(64)] for _ in range(12)]
    blocks[3] = [7] + [0] * 62 + [1]
    blocks[4] = [0] * 64
    raw = usual_file(blocks, restart, 29, 17)
    image, damaged, missing = jpeg.read([raw, raw[:-40], None])
    assert image.coefficients.tolist() == blocks and damaged is None and missing is None
    cells = jpeg.thumbnail(image)
    assert cells.shape == (3, 4) and cells.ravel().tolist() == [min(255, max(0, (b[0] * 1 + 4) // 8 + 128)) for b in blocks]


def colour_file(planes, factors, width, height, restart, together):
    """planes: of each component its blocks by (row, column); DC and AC codes of one length, another for later components."""
    def coded(block, last, long):
        out = ""
        for k, v in enumerate(block):
            v -= last if not k else 0
            n = abs(v).bit_length()
            if k and not any(block[k:]):
                return out + f"{0:0{long}b}"
            assert v or not k
            out += f"{n:0{long}b}" + (f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else "")
        return out

    def scan(units):
        out, run, last, count = b"", "", {}, 0
        def close(run):
            run += "1" * (-len(run) % 8)
            return bytes(int(run[j : j + 8], 2) for j in range(0, len(run), 8)).replace(b"\xff", b"\xff\0")
        for i, unit in enumerate(units):
            if restart and i and i % restart == 0:
                out += close(run) + bytes([0xFF, 0xD0 + count % 8])
                run, last, count = "", {}, count + 1
            for c, block in unit:
                run += coded(block, last.get(c, 0), 4 if c == 0 else 5)
                last[c] = block[0]
        return out + close(run)

    seg, most = jpeg._segment, [max(f[i] for f in factors) for i in (0, 1)]
    tables = b"".join(bytes([kind | place]) + bytes(11 if n == long else 0 for n in range(1, 17)) + bytes(range(11)) for place, long in ((0, 4), (1, 5)) for kind in (0, 16))
    head = (b"\xff\xd8" + seg(0xDB, b"\0" + bytes([3] * 64) + b"\1" + bytes([9] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, height, width, len(planes))
            + b"".join(bytes([c + 1, h << 4 | v, min(c, 1)]) for c, (h, v) in enumerate(factors))) + seg(0xC4, tables) + (seg(0xDD, struct.pack(">H", restart)) if restart else b""))
    own = [bytes([c + 1, min(c, 1) * 17]) for c in range(len(planes))]
    if together:
        units = [[(c, planes[c][y * v + b, x * h + a]) for c, (h, v) in enumerate(factors) for b in range(v) for a in range(h)]
                 for y in range(-(-height // (8 * most[1]))) for x in range(-(-width // (8 * most[0])))]
        return head + seg(0xDA, bytes([len(planes)]) + b"".join(own) + b"\0\x3f\0") + scan(units) + b"\xff\xd9"
    for c in reversed(range(len(planes))):  # the first component comes last but one
        h, v = factors[c]
        units = [[(c, planes[c][y, x])] for y in range(-(-height * v // (8 * most[1]))) for x in range(-(-width * h // (8 * most[0])))]
        head += seg(0xDA, b"\1" + own[c] + b"\0\x3f\0") + scan(units)
    return head + b"\xff\xd9"


@pytest.mark.parametrize("factors", [[(2, 2), (1, 1), (1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(1, 1), (2, 2), (1, 1)], [(1, 2), (1, 1), (1, 1), (1, 2)]])
@pytest.mark.parametrize("restart, together", [(0, True), (1, True), (2, True), (0, False), (3, False)])
def test_colour_files(factors, restart, together):
    rng = random.Random(restart)
    planes = [{(y, x): [rng.randrange(-100, 100), *(rng.choice([-7, 2, 90]) for _ in range(rng.randrange(64)))] for y in range(12) for x in range(12)} for _ in factors]
    planes = [{at: b + [0] * (64 - len(b)) for at, b in plane.items()} for plane in planes]
    width, height, most = 37, 50, [max(f[i] for f in factors) for i in (0, 1)]
    image, damaged = jpeg.read([raw := colour_file(planes, factors, width, height, restart, together), raw[:-60]])
    across, down = -(-width * factors[0][0] // (8 * most[0])), -(-height * factors[0][1] // (8 * most[1]))
    assert (image.width, image.height) == (width, height) and damaged is None
    assert image.coefficients.tolist() == [planes[0][y, x] for y in range(down) for x in range(across)]
    assert jpeg.thumbnail(image).ravel().tolist() == [min(255, max(0, (planes[0][y, x][0] * 3 + 4) // 8 + 128)) for y in range(down) for x in range(across)]


def test_digests(spark):
    rows = [*enumerate(texts()), (99, None), (None, "a"), (1, "a")]
    out = jpeg.media_digests(documents(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in out) == sorted(
        str((i, len((t or "").encode()), len(p := payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))) for i, t in rows)
    assert len({(r.media_sha256, r.feature, r.media_bytes) for r in out if r.payload_sha256 == hashlib.sha256(payload("a")).hexdigest()}) == 1
    assert jpeg.media_digests(documents(spark, [])).collect() == []
    seen = jpeg.media_features(jpeg.to_media(documents(spark, rows))).collect()
    assert len(seen) == len(rows) and all(r.width and len(r.thumbnail_hash) == 16 for r in seen)
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "id long, media binary")
    assert [r.width for r in jpeg.media_features(broken).collect()] == [None, None]
