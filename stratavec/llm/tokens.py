"""Token ids of whole texts by the ``tokenizers`` library.

Most words of a corpus recur, so a worker keeps the ids of the words it has met. A text is cut wherever white space
begins; byte-level BPE pre-tokenizers always begin a token there, hence the ids of the text are those of its pieces one
after another. Pieces are cut, looked up and put together as columns; only new ones reach the library. Texts with a
special token's string or with characters that are white space in some Unicode versions only, and tokenizers of another
kind, go to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a worker remembers at most, and their longest; others are encoded anew, with the same result. When there are too
#: many, those go that haven't come again.
MAX_WORDS, MAX_BYTES = 1_200_000, 48
#: Bytes of text looked up at a time, and pieces put together at a time.
SLICE, PUT = 24_000_000, 1_000_000
_GROUP = 200
# ASCII white space as the pre-tokenizer sees it; texts with any other character that might be white space aren't cut.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DOUBTFUL = "[\x1c-\x1f\x7f\u0085\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"

_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """``encode(column)`` gives the ids of all texts and how many each has; ``dtype`` is the ids' width."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.by_word = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
        # what is remembered: pieces, where their ids begin, the ids one after another, and whether the piece has come again
        self.known, self.at, self.flat, self.again = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, self.dtype), np.zeros(0, bool)
        if self.by_word:
            self.spaced = np.zeros(size, bool)
            self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "Ġ"]] = True
            if hasattr(self.tokenizer.model, "_resize_cache"):
                self.tokenizer.model._resize_cache(0)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and how many each has.

        Pieces whose only white space is a blank at their start are encoded in groups, where tokens with a leading blank delimit them.
        """
        plain = pc.match_substring_regex(pieces, r"^ [^ \t\n\x0b\f\r]+$").to_numpy(zero_copy_only=False)
        first, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        some = pa.concat_arrays([pieces.take(pa.array(first))])
        edges = np.frombuffer(some.buffers()[1], np.int32)[: len(first) + 1].tolist() if len(first) else [0]
        raw = some.buffers()[2].to_pybytes() if len(first) else b""
        starts = list(range(0, len(first), _GROUP))
        got, sizes = [], []
        for at, ids in zip(starts, self.whole([raw[edges[i] : edges[min(i + _GROUP, len(first))]].decode() for i in starts])):
            n, begin = min(_GROUP, len(first) - at), np.flatnonzero(self.spaced[ids])
            if len(begin) != n or begin[0]:
                each = self.whole(some.slice(at, n).to_pylist())
                ids, begin = np.concatenate(each), np.cumsum([0, *(len(x) for x in each)])[:-1]
            got.append(ids)
            sizes.append(np.diff(np.r_[begin, len(ids)]))
        others = self.whole(pieces.take(pa.array(rest)).to_pylist())
        flat = np.concatenate([*got, *others, np.zeros(0, self.dtype)])
        size = np.concatenate([*sizes, np.array([len(x) for x in others], np.int64)])
        back = np.empty(len(pieces), np.int64)
        back[np.r_[first, rest]] = np.arange(len(pieces))
        return gathered(flat, np.r_[0, np.cumsum(size)], back), size[back]

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and where each text's begin (one more entry at the end)."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.r_[0, ends]
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if ends[-1] else np.zeros(0, np.uint8)
        space = _SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        np.greater(space[1:], space[:-1], out=cut[1:-1])
        odd = pc.match_substring_regex(texts, _DOUBTFUL).to_numpy(zero_copy_only=False)
        for s in self.specials:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            cut[starts[i] : starts[i + 1]] = False
        cut[starts] = True
        at = np.flatnonzero(cut[:-1])
        buffer = np.r_[at, len(raw)].astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(buffer), pa.py_buffer(raw)), np.searchsorted(at, starts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, first = self.pieces(texts)
        which = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(which)).dictionary_encode()
        del pieces
        which = np.array(pc.fill_null(which, -1).to_numpy(zero_copy_only=False))
        at, flat = self.at, self.flat
        unknown = which < 0
        self.again[which[~unknown]] = True
        if len(new):
            which[unknown] = new.indices.to_numpy() + np.int32(len(self.known))
            ids, size = self.fresh(new.dictionary)
            at, flat = np.r_[at, at[-1] + np.cumsum(size)], np.concatenate([flat, ids])
            self.remember(new.dictionary, ids, size)
        out = [gathered(flat, at, which[i : i + PUT]) for i in range(0, len(which), PUT)]
        ends = np.cumsum((at[1:] - at[:-1])[which])
        return np.concatenate([*out, np.zeros(0, self.dtype)]), np.diff(np.r_[0, ends][first])

    def remember(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(words), MAX_BYTES).to_numpy(zero_copy_only=False)
        if len(self.known) + short.sum() > MAX_WORDS:
            kept = np.flatnonzero(self.again)
            self.flat, self.known = gathered(self.flat, self.at, kept), self.known.take(pa.array(kept))
            self.at = np.r_[0, np.cumsum((self.at[1:] - self.at[:-1])[kept])]
            self.again = np.zeros(len(kept), bool)
        short &= np.cumsum(short) <= MAX_WORDS - len(self.known)
        if short.any():
            self.known = pa.concat_arrays([self.known, words.filter(pa.array(short))])
            self.flat = np.concatenate([self.flat, ids[np.repeat(short, size)]])
            self.at = np.r_[self.at, self.at[-1] + np.cumsum(size[short])]
        self.again = np.r_[self.again, np.zeros(len(self.known) - len(self.again), bool)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (nulls have none), and how many each has."""
        texts = pc.fill_null(texts, "")
        if not len(texts) or not self.by_word:
            each = self.whole(texts.to_pylist())
            return np.concatenate([*each, np.zeros(0, self.dtype)]), np.array([len(x) for x in each], np.int64)
        parts = [self._encode(texts.slice(a, b - a)) for a, b in byte_groups(texts, SLICE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def ids(self, texts: list[str]) -> list[bytes]:
        """The little-endian ids of each text."""
        flat, size = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])] if len(size) else []


def gathered(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[at[i] : at[i + 1]] for i of ``which``, one after another."""
    size = (at[1:] - at[:-1])[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + len(flat) < 1 << 31 else np.int64
    return flat[np.arange(total, dtype=kind) + np.repeat((at[:-1][which] - ends + size).astype(kind), size)]


def binaries(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of ids, ``size`` each, as binary values."""
    ends = np.cumsum(size) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def with_end(flat: np.ndarray, size: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after those of each text, and the new counts."""
    out = np.full(len(flat) + len(size), end_id, flat.dtype)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
    return out, size + 1


def encoder(path: str) -> Encoder:
    """The worker's own encoder for the vocabulary file at ``path``."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_path() -> str:
    """The vocabulary the queries use; it's a parameter of every operator."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_groups(column, most: int = 2_000_000):
    """Slices [a, b) of an Arrow string column, so that one holds a bounded amount of text (a single longer text stands alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a, n = 0, len(ends)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b
