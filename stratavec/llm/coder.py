"""Adaptive context-mixing range coder for token ids, many independent blocks at a time.

A block is a run of at most ``BLOCK`` ids with a model and a coder of its own. Its model predicts the next id from
the last two ids (order 2), from the last one (order 1), and from how often ids have come so far (order 0: adaptive counts
of the ids that came most, ``KEPT`` of them, and of the bit lengths of all others, uniform within a length). An id that
isn't kept takes the place of one of the less frequent ones. The three orders are mixed with weights that follow how often each
order's guess held, separately for guesses with a longer and a shorter record; a 16-bit range coder spends bits on the
mix. Encoder and decoder run the same steps, one id of every block at a time, so numpy works on whole blocks' columns;
short blocks make these columns long.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 512
LANES = 8192
KEPT = 16
_ONE, _TABLE, _MASK = 1 << 16, 1 << 8, (1 << 8) - 1
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_LEN = np.zeros(1 << 16, np.int32)  # bit length of id + 1, less one
for _k in range(17):
    _LEN[(1 << _k) - 1 : (2 << _k) - 1] = min(_k, 16)
_S16, _S48 = np.uint64(16), np.uint64(48)
_ROWS = KEPT + 17
_LONGER = np.array([1, 2, 3, 3], np.int32) << 16  # a guess's record after it has held once more
_PLACES = np.arange(1, KEPT + 1, dtype=np.int8)[:, None]
_STEPS = np.arange(_ROWS + 1, dtype=np.int16)[:, None]


class _Model:
    """The mixed prediction of every block, and its update."""

    def __init__(self, lanes: int):
        # orders 1 and 2 stand one above the other: the id last seen in each context with its record, and how often guesses held
        self.base = np.arange(2 * lanes).reshape(2, lanes) * _TABLE
        self.conf = np.arange(2 * lanes, dtype=np.int32).reshape(2, lanes) * 4
        self.table = np.empty(2 * lanes * _TABLE, np.int32)  # written to at once, which lets the system use large pages
        self.table.fill(0)
        self.held = np.repeat(np.array([_ONE // 16, _ONE // 8], np.int32), lanes * 4)
        self.cum = np.repeat(_STEPS, lanes, axis=1)  # by kept id or bit length, then block; 8 an id stay within 16 bits
        self.kept = np.full((KEPT, lanes), -1, np.int32)
        self.step = 0
        self.rows = np.arange(lanes)
        self.a = np.zeros(lanes, np.int32)
        self.b = np.zeros(lanes, np.int32)

    def predict(self) -> None:
        self.at = self.base.copy()
        self.at[0] += self.a & _MASK
        self.at[1] += (self.a * 11 + self.b * 1021 + (self.b >> 7)) & _MASK
        e = self.table.take(self.at)
        self.guess = e & 0xFFFF
        self.c1, self.c2 = self.guess
        self.k = self.conf + (e >> 16)
        self.odds = self.held.take(self.k)
        w1, w2 = self.odds >> 1
        w1 = ((32768 - w2) * w1) >> 15
        same = self.c1 == self.c2
        self.w2 = (w2 + w1 * same) * 7 >> 2  # both orders agree: their shares add up; order 0 keeps an eighth
        self.w1 = w1 * ~same * 7 >> 2
        self.lead = self.w1 + self.w2
        self.rest = _ONE - self.lead
        self.tot = self.cum[_ROWS]

    def order0(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a row's share of the rest begins and ends; exact, as all numbers are far below 2**53."""
        n = len(self.rows)
        at = self.rows + row * n
        scale = self.rest.astype(np.float64)
        return np.floor(scale * self.cum.take(at) / self.tot).astype(np.int32), np.floor(scale * self.cum.take(at + n) / self.tot).astype(np.int32)

    def row(self, sym: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The row order 0 has for an id: its place among the kept ones, or its bit length."""
        place = np.add.reduce((self.kept == sym).view(np.int8) * _PLACES, axis=0, dtype=np.int8)  # an id is kept once
        return np.where(place, place - np.int8(1), KEPT + length)

    def update(self, sym: np.ndarray, row: np.ndarray, coded: np.ndarray) -> None:
        hit = self.guess == sym
        self.held[self.k] = self.odds + ((hit * np.int32(_ONE - 128) + (64 - self.odds)) >> 5)
        self.table[self.at] = _LONGER.take(self.k & 3) * hit | sym
        # 8 more for the rows above the id's: the sign of a difference, as a number
        above = np.where(coded, row, _ROWS).astype(np.int16) - _STEPS
        above >>= 12
        above &= 8
        self.cum += above
        # two kept ids stand for election, in turn; the less frequent one goes
        self.step += 1
        x, y = self.step % KEPT, (self.step // KEPT * 2 + 1 + self.step) % KEPT
        new = coded & (row >= KEPT)
        first = self.cum[x + 1] - self.cum[x] <= self.cum[y + 1] - self.cum[y]
        np.copyto(self.kept[x], sym, where=new & first, casting="unsafe")
        np.copyto(self.kept[y], sym, where=new & ~first, casting="unsafe")
        self.b, self.a = self.a, sym

    def shrink(self, n: int) -> None:
        """Only the first n blocks go on (blocks stand by falling length)."""
        for k in ("base", "conf", "a", "b", "rows", "cum", "kept"):
            setattr(self, k, np.ascontiguousarray(getattr(self, k)[..., :n]))


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded form of each block (1 to BLOCK ids below 65,536 each)."""
    out: list[bytes] = []
    for a, b in _shares(len(blocks)):
        out += _encode(blocks[a:b])
    return out


def _shares(n: int) -> list[tuple[int, int]]:
    """About equal parts of n blocks, of about LANES."""
    parts = max(1, round(n / LANES))
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)] if n else []


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    n = len(order)
    syms = np.zeros((sizes[0], n), np.int32)
    for lane, i in enumerate(order):
        syms[: sizes[lane], lane] = blocks[i]
    lens = _LEN.take(syms)
    extra = syms + 1 - (1 << lens)
    m = _Model(n)
    low, rng = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    words, pos = np.zeros((2 * int(sizes[0]) + 16) * n, np.uint16), np.arange(n)  # word j of a block stands at j * n + its lane
    live = n

    def push(k: int) -> None:
        todo = np.flatnonzero(((low[:k] ^ (low[:k] + rng[:k])) < _TOP) | (rng[:k] < _BOTTOM))
        while len(todo):
            lo, r = low[todo], rng[todo]
            apart = (lo ^ (lo + r)) >= _TOP
            r = np.where(apart, (~lo + np.uint64(1)) & (_BOTTOM - np.uint64(1)), r)
            at = pos[todo]
            words[at] = (lo >> _S48).astype(np.uint16)
            pos[todo] = at + n
            lo, r = lo << _S16, r << _S16
            low[todo], rng[todo] = lo, r
            todo = todo[((lo ^ (lo + r)) < _TOP) | (r < _BOTTOM)]

    for step in range(int(sizes[0])):
        if sizes[live - 1] <= step:
            live = int(np.searchsorted(-sizes, -step, side="left"))
            m.shrink(live)
        sym, length = syms[step, :live], lens[step, :live]
        m.predict()
        is2 = m.c2 == sym
        is1 = (m.c1 == sym) & ~is2 & (m.w1 > 0)
        plain = ~(is1 | is2)
        row = m.row(sym, length)
        first, last = m.order0(row)
        start = np.where(plain, m.lead + first, m.w2 * is1).astype(np.uint64)
        size = np.where(plain, last - first, np.where(is2, m.w2, m.w1)).astype(np.uint64)
        r = rng[:live] >> _S16
        low[:live] += r * start
        within = plain & (row >= KEPT)
        r = r * size >> (length * within).astype(np.uint64)
        low[:live] += r * (extra[step, :live] * within).astype(np.uint64)
        rng[:live] = r
        push(live)
        m.update(sym, row, plain)
    for _ in range(4):
        words[pos] = (low >> _S48).astype(np.uint16)
        low <<= _S16
        pos += n
    out: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        out[i] = words[lane : pos[lane] : n].astype("<u2").tobytes()
    return out


def decode_blocks(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block; sizes: how many each holds."""
    out: list[np.ndarray] = []
    for a, b in _shares(len(coded)):
        out += _decode(coded[a:b], sizes[a:b])
    return out


def _decode(coded: list[bytes], counts: list[int]) -> list[np.ndarray]:
    order = sorted(range(len(coded)), key=lambda i: -counts[i])
    sizes = np.array([counts[i] for i in order])
    n = len(order)
    words = np.zeros((max(len(c) for c in coded) // 2 + 8, n), np.uint16)
    for lane, i in enumerate(order):
        w = np.frombuffer(coded[i], "<u2")
        words[: len(w), lane] = w
    m = _Model(n)
    low, rng = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    code = np.zeros(n, np.uint64)
    for j in range(4):
        code = (code << _S16) | words[j].astype(np.uint64)
    pos = 4 * n + np.arange(n)
    syms = np.zeros((int(sizes[0]), n), np.int32)
    live, words = n, words.ravel()

    def pull(k: int) -> None:
        todo = np.flatnonzero(((low[:k] ^ (low[:k] + rng[:k])) < _TOP) | (rng[:k] < _BOTTOM))
        while len(todo):
            lo, r = low[todo], rng[todo]
            apart = (lo ^ (lo + r)) >= _TOP
            r = np.where(apart, (~lo + np.uint64(1)) & (_BOTTOM - np.uint64(1)), r)
            at = pos[todo]
            code[todo] = (code[todo] << _S16) | words.take(at, mode="clip")
            pos[todo] = at + n
            lo, r = lo << _S16, r << _S16
            low[todo], rng[todo] = lo, r
            todo = todo[((lo ^ (lo + r)) < _TOP) | (r < _BOTTOM)]

    for step in range(int(sizes[0])):
        if sizes[live - 1] <= step:
            live = int(np.searchsorted(-sizes, -step, side="left"))
            m.shrink(live)
        m.predict()
        r = rng[:live] >> _S16
        value = np.minimum((code[:live] - low[:live]) // r, np.uint64(_ONE - 1)).astype(np.int32)
        is2, plain = value < m.w2, value >= m.lead
        upto = np.floor(((value - m.lead + 1) * m.tot.astype(np.float64) - 1) / m.rest)
        row = np.add.reduce((m.cum[1:_ROWS] <= upto.astype(np.int16)).view(np.int8), axis=0, dtype=np.int8).astype(np.int32) * plain
        first, last = m.order0(row)
        length = np.maximum(row - KEPT, 0)
        start = np.where(plain, m.lead + first, m.w2 * ~is2).astype(np.uint64)
        size = np.where(plain, last - first, np.where(is2, m.w2, m.w1)).astype(np.uint64)
        low[:live] += r * start
        bits = length.astype(np.uint64)
        r = r * size >> bits
        offset = np.minimum((code[:live] - low[:live]) // r, (np.uint64(1) << bits) - np.uint64(1))
        low[:live] += r * offset
        rng[:live] = r
        pull(live)
        coded = np.where(row >= KEPT, offset.astype(np.int32) + (1 << length) - 1, m.kept.ravel().take(m.rows + np.minimum(row, KEPT - 1) * live))
        sym = np.where(plain, coded, np.where(is2, m.c2, m.c1)).astype(np.int32)
        m.update(sym, row, plain)
        syms[step, :live] = sym
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
    for lane, i in enumerate(order):
        out[i] = syms[: sizes[lane], lane]
    return out


def checksum(coded: bytes, count: int) -> int:
    return zlib.crc32(coded, count)
