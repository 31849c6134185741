"""Rotated scalar quantization to 2, 3 or 4 bits a coordinate.

A vector is normalized, rotated by two rounds of sign flips and Walsh-Hadamard transforms, and each coordinate is put in
a cell of the Lloyd-Max quantizer of N(0, 1/d). The stored scale |v| / <u, x> makes scale * <Rq, x> an almost unbiased
inner product. Dimensions are padded to a power of two. A zero vector has scale 0 and scores 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Positive Lloyd-Max levels for N(0, 1), by bit width.
LEVELS = {2: (0.4528, 1.5104), 3: (0.2451, 0.7560, 1.3439, 2.1519), 4: (0.1284, 0.3880, 0.6568, 0.9423, 1.2562, 1.6180, 2.0690, 2.7326)}
SEED = 20_240_229


@dataclass(frozen=True)
class Geometry:
    dimensions: int
    bit_width: int

    def __post_init__(self):
        if not isinstance(self.dimensions, int) or not isinstance(self.bit_width, int):
            raise ValueError("dimensions and bit_width are integers")
        if self.dimensions % 8 or not 8 <= self.dimensions <= 16384:
            raise ValueError("dimensions must be a multiple of 8 from 8 to 16384")
        if self.bit_width not in LEVELS:
            raise ValueError("bit_width must be 2, 3 or 4")

    @property
    def padded(self) -> int:
        return 1 << (self.dimensions - 1).bit_length()

    @property
    def code_bytes(self) -> int:
        return -(-self.padded * self.bit_width // 8)

    def levels(self) -> np.ndarray:
        half = np.array(LEVELS[self.bit_width])
        return np.r_[-half[::-1], half] / np.sqrt(self.padded)

    def bounds(self) -> np.ndarray:
        lv = self.levels()
        return (lv[1:] + lv[:-1]) / 2


@lru_cache(maxsize=32)
def signs(d: int) -> np.ndarray:
    """Two rows of +-1, from a fixed linear congruential sequence."""
    x, out = SEED, []
    for _ in range(2 * d):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(1.0 if x >> 63 else -1.0)
    return np.array(out).reshape(2, d)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows, divided by sqrt(d)."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, g: Geometry) -> np.ndarray:
    x = np.asarray(x, np.float64)
    if g.padded > x.shape[1]:
        x = np.pad(x, ((0, 0), (0, g.padded - x.shape[1])))
    s = signs(g.padded)
    return hadamard(hadamard(x * s[0]) * s[1])


def quantize(vectors: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    """(scales float32, codes uint8 by coordinate)."""
    v = np.asarray(vectors, np.float64)
    norms = np.sqrt((v * v).sum(axis=1))
    r = rotate(v / np.where(norms == 0, 1, norms)[:, None], g)
    codes = np.searchsorted(g.bounds(), r).astype(np.uint8)
    inner = (r * g.levels()[codes]).sum(axis=1)
    scale = np.where((norms == 0) | (inner <= 0), 0, norms / np.where(inner == 0, 1, inner))
    return scale.astype(np.float32), codes


def pack(codes: np.ndarray, g: Geometry) -> list[bytes]:
    bits = ((codes[:, :, None] >> np.arange(g.bit_width)) & 1).astype(np.uint8).reshape(len(codes), -1)
    return [row.tobytes() for row in np.packbits(bits, axis=1, bitorder="little")]


def unpack(packed: list[bytes], g: Geometry) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), g.code_bytes)
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : g.padded * g.bit_width].reshape(len(packed), g.padded, g.bit_width)
    return (bits << np.arange(g.bit_width, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def scores(scale: np.ndarray, codes: np.ndarray, queries: np.ndarray, g: Geometry) -> np.ndarray:
    """Approximate inner products, rows by queries."""
    return (g.levels()[codes] @ rotate(queries, g).T) * scale.astype(np.float64)[:, None]


def planes_of(codes: np.ndarray, g: Geometry) -> list[bytes]:
    """The codes' two highest bit planes, packed."""
    return pack(codes >> (g.bit_width - 2), Geometry(g.dimensions, 2))


def coarse(packed: list[bytes], g: Geometry) -> np.ndarray:
    """Rows by their two highest planes: each coordinate is the mean of N(0, 1/d) over the levels it may have."""
    return coarse_with_rest(packed, g)[0]


def coarse_with_rest(packed: list[bytes], g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    """:func:`coarse`, and for each row the most that its whole code can be away from that, as a norm."""
    lv = g.levels().reshape(4, -1)
    weight = np.exp(-lv * lv * g.padded / 2) * np.gradient(g.levels()).reshape(4, -1)
    mean = (lv * weight).sum(axis=1) / weight.sum(axis=1)
    cells = unpack(packed, Geometry(g.dimensions, 2))
    widest = np.abs(lv - mean[:, None]).max(axis=1)
    return mean[cells], np.sqrt((widest * widest)[cells].sum(axis=1))
