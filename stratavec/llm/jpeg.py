"""Baseline JPEG media columns: a lossless store for byte payloads, and DC-only luminance thumbnails in numpy.

Reading. :func:`thumbnails` parses the markers of any baseline (SOF0) JPEG of one or three components, with or without
restart intervals and subsampling, Huffman-decodes its scan and keeps the DC coefficients of the first component: one
luminance sample for every 8 x 8 block. All restart intervals of images with the same tables are decoded side by
side, a Huffman symbol of each at a time.

Storing. :func:`store` writes a payload as grayscale JPEG whose unit is the DC coefficient: block k has the flat value
payload[k], and with a DC quantizer of 8 that value is exact. Rows are 64 blocks, each a restart interval; a payload
of over 64 x 8,191 bytes goes on in a further image, so a media value is one or more images end to end. The
thumbnail of a stored payload, read in order, is the payload.

A damaged value (markers, tables or scan cut short, bad codes, bytes after the end) raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.session import ship

from . import tokens

ROW, ROWS = 64, 8191
# Own Huffman tables: size categories 0 to 8 of DC differences, with lengths that suit text; the end of block alone for AC.
_BITS, _SYMBOLS = [0, 2, 2, 3, 1, 1] + [0] * 10, bytes([4, 7, 3, 5, 1, 2, 6, 0, 8])
_AC_BITS, _AC_SYMBOLS = [1] + [0] * 15, bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def canonical(bits: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol: (code, length) of a DHT table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code += 1
            k += 1
        code <<= 1
    return out


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Code (DC size, difference bits, end of block) and its length for each difference from -255."""
    table = canonical(_BITS, _SYMBOLS)
    code, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = table[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        code[d + 255] = ((c << size) | extra) << 1
        length[d + 255] = n + size + 1
    return code, length


_CODE, _LENGTH = _codes()


def _head(rows: int) -> bytes:
    quant = _segment(0xDB, bytes([0]) + bytes([8]) + bytes([1]) * 63)
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + bytes([1, 0x11, 0]))
    huff = _segment(0xC4, bytes([0x00, *_BITS]) + _SYMBOLS + bytes([0x10, *_AC_BITS]) + _AC_SYMBOLS)
    return b"\xff\xd8" + quant + frame + huff + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def store(payloads: list[bytes]) -> list[bytes]:
    """The media value of each payload (a positive multiple of 64 bytes)."""
    if any(len(p) % ROW or not p for p in payloads):
        raise ValueError("a payload is a positive multiple of 64 bytes")
    px = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    lanes = len(px)
    diff = px.astype(np.int16)
    diff[:, 1:] -= px[:, :-1]
    diff[:, 0] -= 128
    diff = np.ascontiguousarray(diff.T) + 255
    words = np.zeros((33 * lanes), np.uint32)  # word w of a lane stands at w * lanes + lane
    lane, at = np.arange(lanes), np.zeros(lanes, np.int64)
    for step in range(ROW):
        code, n = _CODE.take(diff[step]), _LENGTH.take(diff[step])
        spread = code << (64 - (at & 31) - n).astype(np.uint64)
        where = (at >> 5) * lanes + lane
        words[where] |= (spread >> np.uint64(32)).astype(np.uint32)
        words[where + lanes] |= (spread & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at += n
    pad = (-at) & 7  # ones up to the byte's end
    spread = ((np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)) << (64 - (at & 31) - pad).astype(np.uint64)
    where = (at >> 5) * lanes + lane
    words[where] |= (spread >> np.uint64(32)).astype(np.uint32)
    words[where + lanes] |= (spread & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    size = (at + pad) >> 3
    raw = words.reshape(33, lanes).T.astype(">u4", order="C").view(np.uint8).reshape(lanes, 132)
    raw = np.pad(raw[:, : int(size.max())], ((0, 0), (0, 2)))
    counts = np.array([len(p) // ROW for p in payloads])
    row = np.arange(lanes) - np.repeat(np.cumsum(counts) - counts, counts)
    raw[lane, size] = 0xFF
    raw[lane, size + 1] = 0xD0 + row % ROWS % 8
    keep = np.arange(raw.shape[1]) < (size + 2)[:, None]
    data = np.arange(raw.shape[1]) < size[:, None]
    flat = raw[keep]
    twice = (flat == 0xFF) & data[keep]
    reps = twice + 1
    out = np.repeat(flat, reps)
    ends = np.cumsum(reps)
    out[ends[twice] - 1] = 0
    lane_end = np.r_[0, ends[np.cumsum(size + 2) - 1]]
    blob, media, first = out.tobytes(), [], 0
    for n in counts.tolist():
        images = []
        for a in range(0, n, ROWS):
            b = min(a + ROWS, n)
            images.append(_head(b - a) + blob[lane_end[first + a] : lane_end[first + b] - 2] + b"\xff\xd9")
        media.append(b"".join(images))
        first += n
    return media


class _Image:
    """What the markers of one image say, and its restart intervals (without stuffing)."""

    __slots__ = ("height", "width", "comps", "quant", "dc", "ac", "restart", "intervals")


_AFTER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RST = re.compile(rb"\xff+[\xd0-\xd7]")


def parse(data: bytes) -> list[_Image]:
    """The images of a media value."""
    out, at = [], 0
    try:
        while at < len(data):
            image, at = _parse_one(data, at)
            out.append(image)
    except (IndexError, struct.error, KeyError) as e:
        raise ValueError(f"damaged JPEG: {e}") from e
    if not out:
        raise ValueError("no image")
    return out


def _parse_one(data: bytes, at: int) -> tuple[_Image, int]:
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    im, quant, huff, frame = _Image(), {}, {}, None
    im.restart, im.intervals = 0, None
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            if im.intervals is None:
                raise ValueError("an image without a scan")
            return im, at + 2
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("a segment is cut short")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]  # only DC's is used
                body = body[1 + 64 * (1 + bool(wide)) :]
        elif marker == 0xC4:
            while body:
                bits = tuple(body[1:17])
                n = sum(bits)
                if len(body) < 17 + n:
                    raise ValueError("a Huffman table is cut short")
                huff[body[0]] = (bits, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, im.height, im.width, n = struct.unpack_from(">BHHB", body)
            frame = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if depth != 8 or n not in (1, 3) or not im.height or not im.width:
                raise ValueError("not an 8-bit image of one or three components")
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            im.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame):
                raise ValueError("a scan without all of the frame's components")
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            im.comps = tuple((*((1, 1) if len(scan) == 1 else frame[c][:2]), huff[d], huff[16 + a]) for c, d, a in scan)
            im.quant = quant[frame[scan[0][0]][2]]
            m = _AFTER.search(data, at)
            if not m:
                raise ValueError("the scan has no end")
            im.intervals = [x.replace(b"\xff\x00", b"\xff") for x in _RST.split(data[at : m.start()])]
            at = m.start()


_tables: dict[tuple, np.ndarray] = {}


def _lookup(table: tuple) -> np.ndarray:
    """For the next 16 bits: code length << 8 | symbol; 0 where no code fits."""
    if table not in _tables:
        lut = np.zeros(1 << 16, np.int32)
        for symbol, (code, n) in canonical(list(table[0]), table[1]).items():
            if code >> n:
                raise ValueError("a Huffman table has too many codes")
            lut[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
        _tables[table] = lut
    return _tables[table]


def _scan(lanes: list[bytes], units: np.ndarray, comps: tuple) -> list[list[np.ndarray]]:
    """DC coefficients (before the quantizer) of the first component: for each block of an MCU, units by lanes."""
    n = len(lanes)
    order = np.argsort(-units, kind="stable")
    todo = units[order]
    blob = np.frombuffer(b"".join(lanes) + bytes(8), np.uint8)
    lengths = np.array([len(x) for x in lanes], np.int64)
    starts = np.cumsum(lengths) - lengths
    w = blob.astype(np.uint32)
    window = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]  # 32 bits from each byte on
    pos, limit = (starts * 8)[order], ((starts + lengths) * 8)[order]
    blocks = comps[0][0] * comps[0][1]
    out = np.zeros((blocks, int(todo[0]), n), np.int32)
    last = [np.zeros(n, np.int32) for _ in comps]

    def peek(p: np.ndarray) -> np.ndarray:
        return (window.take(p >> 3, mode="clip") << (p & 7).astype(np.uint32)) >> np.uint32(16)  # 16 bits

    def amplitude(p: np.ndarray, size: np.ndarray) -> np.ndarray:
        v = (peek(p) >> (16 - size).astype(np.uint32)).astype(np.int32)
        return np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)

    for unit in range(int(todo[0])):
        live = int(np.searchsorted(-todo, -unit, side="left"))
        for c, (h, v, dc, ac) in enumerate(comps):
            dct, act = _lookup(dc), _lookup(ac)
            for k in range(h * v):
                p = pos[:live]
                e = dct.take(peek(p))
                size = e & 255
                if (e == 0).any() or (size > 11).any():
                    raise ValueError("a bad DC code")
                p = p + (e >> 8)
                last[c][:live] += amplitude(p, size) * (size > 0)
                p += size
                if c == 0:
                    out[k, unit, :live] = last[0][:live]
                # AC: only the bits are skipped, symbol by symbol, until every block has ended
                e = act.take(peek(p))
                run, size = (e >> 4) & 15, e & 15
                p += (e >> 8) + size
                if (e == 0).any():
                    raise ValueError("a bad AC code")
                more = np.flatnonzero((e & 255) != 0)
                if len(more):
                    idx, at = more, 1 + run[more] + 1
                    if (at > 64).any():
                        _bad()
                    idx, at = idx[at < 64], at[at < 64]
                    while len(idx):
                        q = p[idx]
                        e = act.take(peek(q))
                        if (e == 0).any():
                            raise ValueError("a bad AC code")
                        run, size = (e >> 4) & 15, e & 15
                        p[idx] = q + (e >> 8) + size
                        at = at + run + 1
                        on = (e & 255) != 0
                        if (at[on] > 64).any():
                            _bad()
                        on &= at < 64
                        idx, at = idx[on], at[on]
                pos[:live] = p
    if (pos > limit).any():
        raise ValueError("a restart interval is cut short")
    if (limit - pos >= 8).any():
        raise ValueError("a restart interval has bytes left")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return [[out[k, : units[i], back[i]] for k in range(blocks)] for i in range(n)]


def _bad() -> None:
    raise ValueError("a block has more than 64 coefficients")


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(width, height, DC-only luminance) of every image of every media value."""
    parsed = [parse(m) for m in media]
    groups: dict[tuple, list[_Image]] = defaultdict(list)
    for im in (x for images in parsed for x in images):
        groups[im.comps].append(im)
    done: dict[int, np.ndarray] = {}
    for comps, images in groups.items():
        lanes, units, first = [], [], []
        hm, vm = max(c[0] for c in comps), max(c[1] for c in comps)
        for im in images:
            across, down = -(-im.width // (8 * hm)), -(-im.height // (8 * vm))
            total, step = across * down, im.restart or across * down
            if len(im.intervals) != -(-total // step):
                raise ValueError("restart intervals are missing or too many")
            first.append(len(lanes))
            lanes += im.intervals
            units += [min(step, total - a) for a in range(0, total, step)]
        got = _scan(lanes, np.array(units), comps)
        for im, at in zip(images, first):
            across, down = -(-im.width // (8 * hm)), -(-im.height // (8 * vm))
            h, v = comps[0][:2]
            grid = np.empty((down * v, across * h), np.int32)
            mine = got[at : at + len(im.intervals)]
            for k in range(h * v):
                plane = np.concatenate([x[k] for x in mine]) if len(mine) > 1 else mine[0][k]
                grid[k // h :: v, k % h :: h] = plane.reshape(down, across)
            wide, high = -(-im.width * h // (8 * hm)), -(-im.height * v // (8 * vm))
            done[id(im)] = np.clip(np.rint(grid[:high, :wide] * (im.quant / 8) + 128), 0, 255).astype(np.uint8)
    return [[(im.width, im.height, done[id(im)]) for im in images] for images in parsed]


def _boxed(grid: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Sums over about equal boxes by whole-number bounds (at least one sample each), scaled to comparable means."""
    sums = grid.astype(np.int64).cumsum(0).cumsum(1)
    sums = np.pad(sums, ((1, 0), (1, 0)))
    r0, c0 = np.arange(rows) * grid.shape[0] // rows, np.arange(cols) * grid.shape[1] // cols
    r1, c1 = np.maximum((np.arange(rows) + 1) * grid.shape[0] // rows, r0 + 1), np.maximum((np.arange(cols) + 1) * grid.shape[1] // cols, c0 + 1)
    total = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    return total * 4096 // ((r1 - r0)[:, None] * (c1 - c0)[None, :])


def feature(images: list[tuple[int, int, np.ndarray]]) -> str:
    """Per image: size, 64-bit average hash and 64-bit difference hash of its thumbnail."""
    parts = []
    for width, height, grid in images:
        box = _boxed(grid, 8, 8)
        average = int.from_bytes(np.packbits(box.ravel() * 64 > box.sum()).tobytes(), "big")
        wide = _boxed(grid, 8, 9)
        change = int.from_bytes(np.packbits((wide[:, 1:] > wide[:, :-1]).ravel()).tobytes(), "big")
        parts.append(f"{width}x{height}:{average:016x}:{change:016x}")
    return ",".join(parts)


def with_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, zero-padded to a positive multiple of 64, as JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.byte_groups(batch.column(1)):
                raw = [(t or "").encode() for t in batch.column(1).slice(a, b - a).to_pylist()]
                media = store([r + bytes(-len(r) % ROW if r else ROW) for r in raw])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, images int, width int, height int, error string"


def _read(media: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | str]:
    """The thumbnails of each media value, or why there are none."""
    there = [m for m in media if m is not None]
    try:
        found: list = thumbnails(there)
    except (ValueError, IndexError, KeyError):  # one is damaged: each on its own
        found = []
        for m in there:
            try:
                found += thumbnails([m])
            except (ValueError, IndexError, KeyError) as e:
                found.append(str(e) or type(e).__name__)
    each = iter(found)
    return [next(each) if m is not None else "no media" for m in media]


def describe(media: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, n_bytes, media) hold: digests of the payload read back, dimensions and thumbnail hashes.

    Null media give nulls and the error "no media"; damaged ones give their stored size and digest, nulls for what would be read back, and the error.
    Null ids and repeated rows are described like others; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for a, b in tokens.byte_groups(batch.column(2)):
                values = batch.column(2).slice(a, b - a).to_pylist()
                rows: list[list] = [[] for _ in kinds]
                for m, images in zip(values, _read(values)):
                    stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                    if isinstance(images, str):
                        row = (None, None, None, *stored, None, None, None, None, images)
                    else:
                        payload = b"".join(g.tobytes() for _, _, g in images)
                        row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, feature(images), len(images), images[0][0], images[0][1], None)
                    for col, v in zip(rows, row):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(r, k) for r, k in zip(rows, kinds)]], [x.split()[0] for x in MEDIA.split(", ")])

    ship(media.sparkSession)
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col("media").cast("binary").alias("media")).mapInArrow(run, MEDIA)
