"""Media columns: baseline JPEG, down to DC-only luminance thumbnails, decoded for many images at once.

Decoding.  Markers are parsed one by one.  The entropy-coded data of all images of a batch are unstuffed together and
cut at restart markers into *lanes*; all lanes are Huffman-decoded in step, one symbol of each lane at a time, with
numpy look-ups on the next 16 bits.  The DC coefficients of the luminance blocks give a thumbnail of one sample per
block, without any inverse transform.

Storing bytes.  ``store`` keeps a payload losslessly in a valid grey baseline JPEG: each block of 64 quantised
coefficients (the format's unit, quantiser one) holds 64 payload bytes.  Byte b becomes the coefficient of category 8
whose value bits are b, so nothing is rounded; every block is a restart interval, so DC prediction never carries over.
A comment segment holds the payload's length.

Scale.  One scan without a shuffle; batches of about ``GROUP`` payload bytes bound the memory, apart from one image
that is larger by itself.

Edge cases.  Null text counts as empty and is stored as 64 zero bytes.  Progressive, 12-bit or arithmetic images and
broken data raise ``ValueError`` in ``decode``; ``image_features`` returns null features for them and for null images.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_batches

GROUP = 1 << 20
BLOCK = 64
_END_OF_SCAN = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.DOTALL)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_segment(place: int, codes: list[list[int]]) -> bytes:
    """A table segment from the symbols of each code length."""
    codes = codes + [[]] * (16 - len(codes))
    return segment(0xC4, bytes([place, *map(len, codes), *(s for row in codes for s in row)]))


#: What ``store`` writes before the sizes: identity quantiser, and codes of one bit for category 8 and two for zero.
_TABLES = segment(0xDB, bytes([0] + [1] * 64)) + huffman_segment(0x00, [[8], [0]]) + huffman_segment(0x10, [[8], [0]]) + segment(0xDD, b"\x00\x01")
_START = b"\xff\xd8" + segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
_SCAN = segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
#: A block of zeros: DC category 0, end of block, and ones to the byte's end.
_EMPTY = b"\xaf"


def padded(text: str | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


#: Blocks that are coded at a time.
TOGETHER = 1 << 14


def _coded(data: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded blocks, each with the restart marker of its number in its image, and where each one ends."""
    parts, ends, before = [], [], 0
    for first in range(0, len(data), TOGETHER):
        own = data[first : first + TOGETHER]
        bits = np.zeros((len(own), BLOCK, 9), dtype=np.uint8)
        bits[:, :, 1:] = np.unpackbits(own, axis=1).reshape(-1, BLOCK, 8)
        out = np.empty((len(own), 74), dtype=np.uint8)
        out[:, :72] = np.packbits(bits.reshape(len(own), -1), axis=1)
        out[:, 72], out[:, 73] = 0xFF, 0xD0 + number[first : first + TOGETHER] % 8
        stuffed = out == 0xFF
        stuffed[:, 72] = False
        repeats = 1 + stuffed.ravel()
        where = repeats.cumsum()
        flat = np.repeat(out.ravel(), repeats)
        flat[where[stuffed.ravel()] - 1] = 0
        parts.append(flat.tobytes())
        ends.append(where[73::74] + before)
        before += len(flat)
    return b"".join(parts), np.concatenate(ends)


def store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length must be a positive multiple of 64."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
    last = counts.cumsum()
    raw, ends = _coded(data, np.arange(len(data)) - np.repeat(last - counts, counts))
    edges, images = [0, *ends[last - 1].tolist()], []
    for i, n in enumerate(counts.tolist()):
        wide = int(np.ceil(np.sqrt(n)))
        high = -(-n // wide)
        empty = b"".join(b"\xff" + bytes([0xD0 + k % 8]) + _EMPTY for k in range(n - 1, wide * high - 1))
        sizes = segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00")
        note = segment(0xFE, b"payload %d" % len(payloads[i]))
        images.append(b"".join((_START, note, _TABLES, sizes, _SCAN, raw[edges[i] : edges[i + 1] - 2], empty, b"\xff\xd9")))
    return images


@lru_cache(maxsize=256)
def huffman_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits: the code length times 256, plus the symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    code = at = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


@dataclass
class Scan:
    """One scan: its components (by place in the frame) with their tables, and where its data lie in the file."""

    components: list[int]
    dc: list[np.ndarray]
    ac: list[np.ndarray]
    start: int
    end: int
    interval: int


@dataclass
class Image:
    """A parsed file: sizes, components as (horizontal, vertical, quantiser's first entry), scans and the comment."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int]] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    def blocks(self, component: int, interleaved: bool) -> tuple[int, int]:
        """Blocks of a component across and down, filled up to whole units in an interleaved scan."""
        most_h, most_v = max(c[0] for c in self.components), max(c[1] for c in self.components)
        h, v, _ = self.components[component]
        if interleaved:
            return -(-self.width // (8 * most_h)) * h, -(-self.height // (8 * most_v)) * v
        return -(-self.width * h // (8 * most_h)), -(-self.height * v // (8 * most_v))


def parse(raw: bytes) -> Image:
    """Markers and segments up to the end of the image."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at, interval = Image(), 2, 0
    quantisers: dict[int, int] = {}
    tables: dict[int, np.ndarray] = {}
    ids: list[int] = []
    wanted: list[int] = []
    while True:
        if at + 2 > len(raw) or raw[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (length,) = struct.unpack_from(">H", raw, at + 2)
        body = raw[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = huffman_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xC0:
            precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not n or not image.width or not image.height:
                raise ValueError("only 8-bit baseline images with known sizes are supported")
            ids = [body[6 + 3 * i] for i in range(n)]
            image.components = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, 0) for i in range(n)]
            wanted = [body[8 + 3 * i] for i in range(n)]
            if any(not 1 <= f <= 4 for h, v, _ in image.components for f in (h, v)):
                raise ValueError("a sampling factor is out of range")
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline images are supported")
        elif marker == 0xDA:
            n = body[0]
            chosen = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            found = _END_OF_SCAN.search(raw, at)
            if not found:
                raise ValueError("no end of the scan")
            try:
                pairs = [(tables[t >> 4], tables[16 + (t & 15)]) for _, t in chosen]
            except KeyError as missing:
                raise ValueError("a code table is missing") from missing
            image.scans.append(Scan([c for c, _ in chosen], [d for d, _ in pairs], [a for _, a in pairs], at, found.start(), interval))
            at = found.start()
    if not image.scans:
        raise ValueError("no scan")
    image.components = [(h, v, quantisers.get(q, 1)) for (h, v, _), q in zip(image.components, wanted, strict=True)]
    return image


def decode(files: list[bytes]) -> list[tuple[Image, list[tuple[Scan, np.ndarray, np.ndarray]]]]:
    """For each file the parsed image and, by scan, its blocks in zigzag order (DC undone) and each block's component."""
    images = [parse(raw) for raw in files]
    scans = [(i, scan) for i, image in enumerate(images) for scan in image.scans]
    coded = np.frombuffer(b"".join(files[i][s.start : s.end] + b"\xff\xd9" for i, s in scans), dtype=np.uint8)
    lengths = np.array([s.end - s.start + 2 for _, s in scans])
    first = lengths.cumsum() - lengths
    follows = np.zeros(len(coded), dtype=bool)
    follows[1:] = coded[:-1] == 0xFF
    stuffing = follows & (coded == 0)
    marker = follows & (coded >= 0xD0) & (coded <= 0xD9)
    cuts = np.flatnonzero(marker)
    drop = stuffing | marker
    drop[cuts - 1] = True
    data = np.concatenate([coded[~drop], np.full(16, 0xFF, dtype=np.uint8)])
    lane_end = cuts + 1 - np.searchsorted(np.flatnonzero(drop), cuts, side="right")  # bytes of data up to each cut
    del follows, stuffing, marker, drop
    lane_start = np.r_[0, lane_end[:-1]]
    lane_scan = np.searchsorted(first, cuts, side="right") - 1
    per_scan = np.bincount(lane_scan, minlength=len(scans))

    tables: list[np.ndarray] = []
    place: dict[int, int] = {}

    def number(table: np.ndarray) -> int:
        if id(table) not in place:
            place[id(table)] = len(tables)
            tables.append(table)
        return place[id(table)]

    units, slots, totals = [], [], []
    for i, scan in scans:
        image = images[i]
        mixed = len(scan.components) > 1
        unit = [k for k, c in enumerate(scan.components) for _ in range(image.components[c][0] * image.components[c][1] if mixed else 1)]
        across, down = image.blocks(scan.components[0], mixed)
        h, v, _ = image.components[scan.components[0]]
        totals.append(across * down // (h * v) if mixed else across * down)
        if totals[-1] * len(unit) > 4 * (scan.end - scan.start):  # a block takes two bits at least
            raise ValueError("the data are too short for the sizes declared")
        slots.append(unit)
        units.append([(number(scan.dc[k]), number(scan.ac[k]), k) for k in unit])
    most = max(map(len, units), default=1)
    table_of = np.zeros((len(scans), most, 3), dtype=np.int64)
    for s, unit in enumerate(units):
        table_of[s, : len(unit)] = unit
    n_slots, totals_of = np.array([len(u) for u in units]), np.array(totals)
    rank = np.arange(len(cuts)) - np.repeat(per_scan.cumsum() - per_scan, per_scan)
    interval = np.array([s.interval or total for (_, s), total in zip(scans, totals, strict=True)])[lane_scan]
    mcus = np.minimum(interval, totals_of[lane_scan] - rank * interval)
    if (mcus < 0).any() or (np.bincount(lane_scan, weights=mcus, minlength=len(scans)) != totals_of).any():
        raise ValueError("restart markers do not fit the image")
    todo = mcus * n_slots[lane_scan]
    block = todo.cumsum() - todo
    blocks = np.zeros((int(todo.sum()), 64), dtype=np.int16)
    _huffman(data, lane_start * 8, lane_end * 8, lane_scan, todo, block, blocks, np.stack(tables), table_of, n_slots)
    out: list[tuple[Image, list]] = [(image, []) for image in images]
    edges = np.r_[0, np.cumsum(totals_of * n_slots)]
    for s, (i, scan) in enumerate(scans):
        out[i][1].append((scan, blocks[edges[s] : edges[s + 1]], np.array(slots[s] * totals[s], dtype=np.int64)))
    return out


def _huffman(data, at, end, scan, todo, block, blocks, tables, table_of, n_slots) -> None:
    """Fill ``blocks``, one symbol of every open lane at a time."""
    windows = np.ndarray(len(data) - 7, dtype=">u8", buffer=data, strides=(1,))  # the eight bytes from each place on, without a copy
    flat = tables.ravel()
    open_lanes = np.flatnonzero(todo > 0)
    at, end, todo, block, scan = (x[open_lanes].astype(np.int64) for x in (at, end, todo, block, scan))
    k, slot = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    before = np.zeros((len(at), int(table_of[:, :, 2].max(initial=0)) + 1), dtype=np.int64)
    single = int(n_slots.max(initial=1)) == 1
    own = table_of[scan, slot]
    while len(at):
        if (at >= end).any():
            raise ValueError("the data end too early")
        window = windows[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        dc = k == 0
        code = flat[np.where(dc, own[:, 0], own[:, 1]) << 16 | (window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, symbol = code >> 8, code & 255
        if not length.all():
            raise ValueError("a code does not exist")
        size = symbol & 15
        value = ((window << length.astype(np.uint64)) >> np.uint64(48)).astype(np.int64) >> (16 - size)
        value = np.where((size > 0) & (value < 1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)
        if dc.any():
            rows = np.flatnonzero(dc)
            before[rows, own[rows, 2]] += value[rows]
            blocks[block[rows], 0] = before[rows, own[rows, 2]]
        rows = np.flatnonzero(~dc & (size > 0))
        k += np.where(dc, 0, symbol >> 4)
        if (k[rows] > 63).any():
            raise ValueError("a block is too long")
        blocks[block[rows], k[rows]] = value[rows]
        k += 1
        k[~dc & (symbol == 0)] = 64
        at += length + size
        done = np.flatnonzero(k >= 64)
        if len(done):
            k[done] = 0
            block[done] += 1
            todo[done] -= 1
            if not single:
                slot[done] = (slot[done] + 1) % n_slots[scan[done]]
            still = todo > 0
            if not still.all():
                at, end, todo, block, scan, k, slot, before = (x[still] for x in (at, end, todo, block, scan, k, slot, before))
            own = table_of[scan, slot]


def thumbnail(image: Image, scans: list[tuple[Scan, np.ndarray, np.ndarray]]) -> np.ndarray:
    """One sample per luminance block, from its DC coefficient alone."""
    scan, blocks, slots = next(x for x in scans if 0 in x[0].components)
    h, v, step = image.components[0]
    mixed = len(scan.components) > 1
    dc = blocks[slots == scan.components.index(0), 0].astype(np.int64)
    across, down = image.blocks(0, mixed)
    grid = dc.reshape(down // v, across // h, v, h).swapaxes(1, 2).reshape(down, across) if mixed else dc.reshape(down, across)
    seen_across, seen_down = image.blocks(0, False)
    return np.clip(np.rint(grid[:seen_down, :seen_across] * step / 8 + 128), 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which of 8 by 8 areas are lighter than the mean; areas share samples where the thumbnail is smaller."""
    down, across = thumb.shape
    total = np.zeros((down + 1, across + 1), dtype=np.int64)
    total[1:, 1:] = thumb.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    y0, x0 = np.arange(8) * down // 8, np.arange(8) * across // 8
    y1, x1 = np.maximum((np.arange(8) + 1) * down // 8, y0 + 1), np.maximum((np.arange(8) + 1) * across // 8, x0 + 1)
    sums = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    lighter = sums * (down * across) > total[-1, -1] * np.outer(y1 - y0, x1 - x0)
    return int(np.packbits(lighter.ravel()).view(">u8")[0])


def feature(image: Image, thumb: np.ndarray) -> str:
    """Dimensions, average hash and checksum of the thumbnail."""
    return f"{image.width}x{image.height}:{average_hash(thumb):016x}:{zlib.crc32(thumb.tobytes()):08x}"


def payload(image: Image, blocks: np.ndarray) -> bytes:
    """What ``store`` was given."""
    n = int(image.comment.removeprefix(b"payload "))
    values = blocks[: n // BLOCK]
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()


STORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def groups_by_bytes(payloads: list[bytes]):
    """Slices of at least one payload and about ``GROUP`` bytes."""
    start = held = 0
    for i, p in enumerate(payloads):
        if i > start and held + len(p) > GROUP:
            yield slice(start, i)
            start, held = i, 0
        held += len(p)
    if start < len(payloads):
        yield slice(start, len(payloads))


def round_trip(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a JPEG and read back: sizes and digests of both, and the image's feature."""

    def body(batches):
        for batch in batches:
            out: dict[str, list] = {name: [] for name in STORED.names}
            out["doc_id"] = batch["doc_id"]
            payloads = [padded(t) for t in batch["text"]]
            for part in groups_by_bytes(payloads):
                files = store(payloads[part])
                for text, raw, (image, scans) in zip(batch["text"][part], files, decode(files), strict=True):
                    back = payload(image, scans[0][1])
                    out["n_bytes"].append(len((text or "").encode("utf-8", "replace")))
                    out["payload_bytes"].append(len(back))
                    out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                    out["tail_crc32"].append(zlib.crc32(back[-BLOCK:]))
                    out["media_bytes"].append(len(raw))
                    out["media_sha256"].append(hashlib.sha256(raw).hexdigest())
                    out["feature"].append(feature(image, thumbnail(image, scans)))
            yield out

    return map_batches(docs.select("doc_id", "text"), body, STORED)


def image_features(images: DataFrame, key: str, media: str) -> DataFrame:
    """``key, width, height, thumbnail, thumbnail_hash`` of a column of JPEG files; nulls where a file cannot be read."""
    schema = T.StructType(
        [images.schema[key], T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("thumbnail", T.BinaryType()), T.StructField("thumbnail_hash", T.StringType())]
    )

    def body(batches):
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            for own, raw in zip(batch[key], batch[media], strict=True):
                row: tuple = (None, None, None, None)
                try:
                    image, scans = decode([raw or b""])[0]
                    thumb = thumbnail(image, scans)
                    row = image.width, image.height, thumb.tobytes(), f"{average_hash(thumb):016x}"
                except (ValueError, LookupError, ArithmeticError, TypeError, struct.error, StopIteration):
                    pass
                for name, value in zip(schema.names, (own, *row), strict=True):
                    out[name].append(value)
            yield out

    return map_batches(images.select(key, media), body, schema)
