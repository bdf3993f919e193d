import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest

from tidemark.llm import jpeg


def slow_decode(raw):
    """Coefficients of a grey image, bit by bit, from the definition."""
    image = jpeg.parse(raw)
    scan = image.scans[0]
    data, segments = raw[scan.start : scan.end], [b""]
    i = 0
    while i < len(data):
        if data[i] == 0xFF and data[i + 1] == 0:
            segments[-1] += b"\xff"
            i += 2
        elif data[i] == 0xFF:
            segments.append(b"")
            i += 2
        else:
            segments[-1] += data[i : i + 1]
            i += 1
    across, down = image.blocks(0, False)
    blocks = []
    for number, part in enumerate(segments):
        bits = "".join(f"{b:08b}" for b in part) + "1" * 32
        at, before = 0, 0
        for _ in range(min(scan.interval or across * down, across * down - number * (scan.interval or 0))):
            block, k = [0] * 64, 0
            while k < 64:
                code = int((scan.ac if k else scan.dc)[0][int(bits[at : at + 16], 2)])
                at += code >> 8
                size, run = code & 15, (code & 255) >> 4
                if k and code & 255 == 0:
                    break
                v = int(bits[at : at + size] or "0", 2)
                at += size
                v = v if not size or v >> (size - 1) else v - (1 << size) + 1
                if k:
                    k += run
                    block[min(k, 63)] = v
                else:
                    before += v
                    block[0] = before
                k += 1
            blocks.append(block)
    return np.array(blocks)


def encode_grey(blocks, wide, interval):
    """A plain baseline encoder with long codes: every symbol has 8 bits."""
    symbols = sorted({0x00, 0xF0, *range(12), *((r << 4) | s for r in range(16) for s in range(1, 11))})
    codes = {s: f"{i:08b}" for i, s in enumerate(symbols)}
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)

    def value(v):
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    parts, bits, before = [], "", 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        parts.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
        bits = ""

    for n, block in enumerate(blocks):
        if interval and n and n % interval == 0:
            flush()
            parts.append(bytes([0xFF, 0xD0 + (n // interval - 1) % 8]))
            before = 0
        size, raw = value(int(block[0]) - before)
        before = int(block[0])
        bits += codes[size] + raw
        run = 0
        last = max([k for k in range(1, 64) if block[k]], default=0)
        for k in range(1, last + 1):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                bits += codes[0xF0]
                run -= 16
            size, raw = value(int(block[k]))
            bits += codes[run << 4 | size] + raw
            run = 0
        if last < 63:
            bits += codes[0]
    flush()
    high = len(blocks) // wide
    head = b"\xff\xd8" + jpeg.segment(0xDB, bytes([0] + [2] * 64)) + jpeg.segment(0xC4, b"\x00" + table) + jpeg.segment(0xC4, b"\x10" + table)
    head += jpeg.segment(0xDD, struct.pack(">H", interval)) + jpeg.segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00")
    return head + jpeg.segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"".join(parts) + b"\xff\xd9"


def test_payloads_come_back():
    rng = random.Random(1)
    payloads = [jpeg.padded(t) for t in (None, "", "a", "x" * 64, "é" * 99, "long " * 9000)] + [os.urandom(64 * rng.randint(1, 40)) for _ in range(40)] + [b"\xff" * 640, bytes(range(256)) * 2]
    files = jpeg.store(payloads)
    for p, raw, (image, scans) in zip(payloads, files, jpeg.decode(files), strict=True):
        assert jpeg.payload(image, scans[0][1]) == p
        if len(p) < 2000:
            assert np.array_equal(slow_decode(raw), scans[0][1])
    assert jpeg.store([payloads[3]])[0] == files[3]


@pytest.mark.parametrize("interval", [0, 1, 5])
def test_ordinary_images(interval):
    rng = np.random.default_rng(interval)
    images = []
    for wide, high in ((1, 1), (4, 3), (9, 7)):
        blocks = rng.integers(-60, 60, size=(wide * high, 64)) * (rng.random((wide * high, 64)) < 0.15)
        blocks[:, 0] = rng.integers(-300, 300, size=wide * high)
        images.append((blocks, wide, encode_grey(blocks, wide, interval)))
    for (blocks, wide, raw), (image, scans) in zip(images, jpeg.decode([r for _, _, r in images]), strict=True):
        assert np.array_equal(scans[0][1], blocks) and np.array_equal(slow_decode(raw), blocks)
        want = np.clip(np.rint(blocks[:, 0].reshape(-1, wide) * 2 / 8 + 128), 0, 255)
        assert np.array_equal(jpeg.thumbnail(image, scans), want)


def test_hash_sees_areas():
    thumb = np.zeros((16, 16), dtype=np.uint8)
    thumb[:8] = 200
    assert jpeg.average_hash(thumb) == 0xFFFFFFFF00000000 and jpeg.average_hash(np.full((1, 1), 9, dtype=np.uint8)) == 0


def test_query_and_broken_files(spark):
    texts = [None, "", "same", "same", "é" * 500, "z" * 100_000]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r.doc_id: r for r in jpeg.round_trip(docs).collect()}
    for i, t in enumerate(texts):
        p = jpeg.padded(t)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert rows[2][1:] == rows[3][1:] and rows[0][1:] == rows[1][1:]
    good = jpeg.store([bytes(128)])[0]
    media = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"nothing")), (3, None), (4, bytearray(good[:-40])), (5, bytearray(good.replace(b"\xff\xc0", b"\xff\xc2", 1)))], "k long, m binary")
    got = {r.k: r for r in jpeg.image_features(media, "k", "m").collect()}
    assert (got[1].width, got[1].height, len(got[1].thumbnail)) == (16, 8, 2) and all(got[k].width is None for k in (2, 3, 4, 5))
    assert jpeg.round_trip(docs.where("doc_id < 0")).count() == 0


def test_every_broken_file_gives_nulls(spark):
    import random

    rng = random.Random(3)
    fine = jpeg.store([jpeg.padded("some text " * 40)])[0]
    at = fine.index(b"\xff\xc0")
    no_factor = fine[: at + 11] + b"\x00" + fine[at + 12 :]
    huge = fine[: at + 5] + b"\xff\xf8\xff\xf8" + fine[at + 9 :]
    broken = [no_factor, huge, b"", b"\xff\xd8", fine[:60], fine[: at + 6]]
    for _ in range(300):
        raw = bytearray(fine)
        for _ in range(rng.randint(1, 6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        broken.append(bytes(raw[: rng.randint(1, len(raw))]) if rng.random() < 0.3 else bytes(raw))
    media = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([fine, *broken])] + [(999, None)], "k long, m binary")
    got = {r.k: r for r in jpeg.image_features(media, "k", "m").collect()}
    assert len(got) == len(broken) + 2 and got[0].width and all(got[k].width is None for k in (1, 2, 3, 4, 5, 6, 999))
