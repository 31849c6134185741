"""Suffix-array dedup of exact substrings by threshold-bounded interval expansion.

A byte goes if a ``LENGTH``-byte string over it also starts in a document of a smaller id. To bring equal strings
together without sending every position around, each window of LENGTH bytes has an anchor: the least hash of its
16-byte strings. Equal windows have equal anchors, and one anchor serves about 18 windows in a row.
Of equal texts only the one of the least id takes part, the others go whole (SHA-256 digests tell). Anchors that occur in
one text only are dropped (hashes meet in their order, once, and go back to their texts). So are an anchor's windows if no other text has the same 17 bytes before
the anchor, or for windows that don't hold these, the same 18 after it. Around every other anchor its windows are cut out as a snippet; equal snippets are one, with the least document id that has it.
Snippets overlap, so those of a text in which every anchor is repeated are over three times its size. They are therefore cut, sorted and dropped
a part of the anchors at a time, and only the texts with their anchors' places stay on disk: a part's snippets are at most about SHARE of the texts.

The snippets of an anchor meet in one task; those of an anchor with very many (the hashes' meeting tells) are cut into parts at once, by finer anchors of
nearly a window's length. It sorts their suffixes, forms the Burrows-Wheeler transform and derives
common-prefix lengths by increasing value: breadth-first, every interval of a string W is extended backward to the
intervals of cW, and an interval whose right neighbour has no value yet gives it the present length. The search stops
at LENGTH, so what is left without a value is a common prefix of at least LENGTH bytes; suffixes between two values
are one LENGTH-byte string, and the least document id among them decides its windows. Runs of such decisions go
back to the documents, where overlapping removals are merged.

Defined results: null texts count as empty; matches never cross documents; texts below LENGTH bytes lose nothing; rows
with equal ids aren't smaller than each other; null ids count as larger than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.session import materialize, remove, ship, trim

from . import tokens

LENGTH, GRAM = 50, 16  # bytes of a matching string, and of those an anchor is chosen from
_SEP = 0xFF  # no UTF-8 text has this byte


#: Distinct snippets from which, about, an anchor is hot; one in SAMPLED is counted. Its snippets are split by finer anchors of STEP windows each.
HOT, SAMPLED, STEP = 2048, 16, 4
#: Bytes of hashes compared at a time.
MEET = 1 << 23
#: Bytes of text hashed or sorted at a time, so that the working arrays stay in a core's cache.
PIECE = 1 << 18
#: Whole texts handed to Python at a time.
BATCH = 1000
#: Rows and bytes handed to Python at a time where these are texts first and hashes then.
ROWS, BYTES = 20_000, 4_000_000
#: Bytes of snippets in a part of the anchors, as a share of the texts' bytes, and bytes that always fit in one part.
SHARE, SMALL = 0.6, 1 << 26


def grams(text: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each position."""
    h = text.astype(np.uint64) + np.uint64(1)
    prime, have = 0x100000001B3, 1
    while have < width:
        ahead = min(have, width - have)  # the last two runs of bytes may overlap
        h = h[:-ahead] * np.uint64(pow(prime, have, 1 << 64)) + h[ahead:]
        have += ahead
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def anchors(raws: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of a text's windows with the same anchor: number of the text, the anchor, the first window's start and the last one's."""
    return marked(raws, length)[:4]


def marked(raws: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """As anchors, with the place of each run's anchor and a mark: what stands before it and after it, hashed.

    A window whose anchor begins at its byte middle(length) or later has the left bytes, any other the right ones; the mark's upper half is the
    left hash and its lower half the right one, 0 where no window of the run has those bytes. It is -1 if the anchor stands in the run twice,
    as then its windows' places differ.
    """
    sizes = np.array([len(x) for x in raws], np.int64)
    if sizes.sum() < length:
        return (np.zeros(0, np.int64),) * 6
    h = mixed(grams(np.frombuffer(b"".join(raws), np.uint8), GRAM))
    span, least, have = length - GRAM + 1, h, 1
    while have < span:
        ahead = min(have, span - have)
        least = np.minimum(least[:-ahead], least[ahead:])
        have += ahead
    ends = np.cumsum(sizes)
    starts = ends - sizes
    stops = starts + np.maximum(sizes - length + 1, 0)  # where windows begin to reach into the next text
    change = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=change[1:])
    for edge in (starts, stops):
        change[edge[edge < len(change)]] = True
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(change)] - 1
    owner = np.searchsorted(ends, first, side="right")
    whole = first < stops[owner]
    owner, first, last = owner[whole], first[whole], last[whole]
    anchor, mid = least[first], middle(length)
    place = last.copy()  # the anchor begins at the run's last window or after it
    todo = np.flatnonzero(h[last] != anchor)
    for k in range(1, span):
        if not len(todo):
            break
        at = last[todo] + k
        found = h[at] == anchor[todo]
        place[todo[found]] = at[found]
        todo = todo[~found]
    begins = np.r_[0, np.cumsum(h[: len(least)] == least, dtype=np.int32)]  # windows that begin with their anchor
    twice = begins[last] > begins[first]
    wide = length - mid + 1 - GRAM
    sides = []
    for steps, has in ((range(-mid, 0, GRAM), place - first >= mid), ((*range(GRAM, wide, GRAM), wide), place - last < mid)):
        side = anchor.copy()
        for k in steps:
            side = side * np.uint64(0x9E3779B97F4A7C15) + h[np.where(has, place + k, 0)]
        sides.append(((mixed(side) >> np.uint64(33)) + np.uint64(1)) * has)
    mark = np.where(twice, np.int64(-1), (sides[0] << np.uint64(32) | sides[1]).view(np.int64))
    return owner, anchor.view(np.int64), first - starts[owner], last - starts[owner], place - starts[owner], mark


def middle(length: int) -> int:
    return (length - GRAM + 1) // 2


def sided(h: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and their left and right bytes as one key each."""
    wild = mark == -1
    left, right = (mark >> 32) * ~wild, (mark & 0xFFFFFFFF) * ~wild
    return tuple(mixed(h.view(np.uint64) + part.view(np.uint64) * np.uint64(odd)).view(np.int64) for part, odd in ((left, 0xD6E8FEB86659FD93), (right, 0xA0761D6478BD642F)))


def whole_keys(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows that come in order of their first column, all of a key together, about ``most`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > most:
            now = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = now.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if last:
                yield now.slice(0, last)
            held = [now.slice(last)]
            size = 0 if last else -size  # a larger key waits until it has doubled
    if held and (now := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield now.to_batches()[0]


def shared(h: np.ndarray, row: np.ndarray, mark: np.ndarray, hot: int, sampled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors in order, with the texts they are in: (row, key, False) for what two texts or more share, (row, anchor, True) for such anchors with very many snippets.

    A key is an anchor with its left or its right bytes; of anchors with a mark of -1 it is the anchor alone, for all texts.
    """
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    many = np.minimum.reduceat(row, edge) != np.maximum.reduceat(row, edge)
    size = np.diff(np.r_[edge, len(h)])
    keep = np.repeat(many, size)
    h, row, mark, size = h[keep], row[keep], mark[keep], size[many]
    if not len(h):
        return row, h, np.zeros(0, bool)
    begin, group, least = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size), max(1, hot // sampled)
    wild = np.repeat(np.logical_or.reduceat(mark == -1, begin), size)
    rows, keys, any_ = [row[wild]], [h[wild]], wild.copy()
    for key, part in zip(sided(h, mark), (mark >> 32, mark & 0xFFFFFFFF)):
        some = np.flatnonzero(~wild & (part != 0))
        meet = group[some] << 32 | part[some]
        order = np.argsort(meet)
        some, meet = some[order], meet[order]
        first = np.flatnonzero(np.r_[True, meet[1:] != meet[:-1]][: len(meet)])
        if len(first):
            both = np.minimum.reduceat(row[some], first) != np.maximum.reduceat(row[some], first)
            some = some[np.repeat(both, np.diff(np.r_[first, len(some)]))]
            rows.append(row[some])
            keys.append(key[some])
            any_[some] = True
    is_hot = np.zeros(len(size), bool)
    for g in np.flatnonzero(np.add.reduceat(any_, begin, dtype=np.int64) >= least).tolist():
        some = mark[begin[g] : begin[g] + size[g]][any_[begin[g] : begin[g] + size[g]]]
        is_hot[g] = len(np.unique(some[mixed(some.view(np.uint64)) % np.uint64(sampled) == 0])) >= least
    is_hot = np.repeat(is_hot, size) & any_
    flags = [np.zeros(sum(map(len, rows)), bool), np.ones(is_hot.sum(), bool)]
    row, key, flag = np.concatenate([*rows, row[is_hot]]), np.concatenate([*keys, h[is_hot]]), np.concatenate(flags)
    order = np.lexsort((row, key))
    order = order[np.argsort(flag[order], kind="stable")]
    row, key, flag = row[order], key[order], flag[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (flag[1:] != flag[:-1])][: len(key)]
    return row[new], key[new], flag[new]


def pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about PIECE bytes, by their sizes; a longer text is a run of its own."""
    a = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > PIECE:
            yield a, i
            a, total = i, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def heads(text: np.ndarray, width: int = 8) -> np.ndarray:
    """Each position's next ``width`` bytes, at most 8, as one number."""
    n = len(text)
    padded = np.r_[text, np.full(width, _SEP, np.uint8)]
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key << np.uint64(8)) | padded[k : k + n]
    return key


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions by the first ``depth`` bytes at least (prefix doubling from 8 bytes, of ties only), in any order where these are equal."""
    n, have = len(text), 8
    key = heads(text)
    order = np.argsort(key)
    key = key[order]
    rank = np.full(2 * n + depth + 8, n, np.int64)  # place of the first suffix that is equal so far; past the end, n
    slots, new = np.arange(n), np.r_[True, key[1:] != key[:-1]]
    while True:
        first = slots[np.flatnonzero(new)]
        rank[order[slots]] = np.repeat(first, np.diff(np.r_[np.flatnonzero(new), len(slots)]))
        if have >= depth:
            return order
        slots = slots[~(new & np.r_[new[1:], True])]
        if not len(slots):
            return order
        tied = order[slots]
        key = rank[tied].astype(np.uint64) * np.uint64(n + 1) + rank[tied + have].astype(np.uint64)
        by = np.argsort(key)
        order[slots], key = tied[by], key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        have *= 2


def bounded_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order: whether each shares fewer than ``length`` bytes with the one before it.

    text ends with the separator. Right for suffixes without a separator in their first ``length`` bytes. The search
    begins with the intervals of all 8-byte strings, which one comparison of the ordered suffixes gives.
    """
    n, width = len(text), min(8, length)
    bwt, head = text[order - 1], text[order]
    lf = np.empty(n, np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    key = heads(text, width)[order]
    known = np.ones(n + 1, bool)
    np.not_equal(key[1:], key[:-1], out=known[1:n])
    separators = np.cumsum(np.r_[text == _SEP, np.ones(width, bool)], dtype=np.int32)
    pure = separators[width - 1 : n + width - 1] - separators[:n] + (text == _SEP) == 0
    lo = np.flatnonzero(known[:n]).astype(np.int32)  # of strings without a separator
    hi = np.r_[lo[1:], np.int32(n)] - 1
    keep = pure[order[lo]]
    lo, hi = lo[keep], hi[keep]
    owner = np.zeros(n, np.int32)
    for _ in range(width, length):
        if not len(lo):
            break
        one = lo == hi
        alone = lo[one]
        alone = lf[alone[bwt[alone] != _SEP]]
        lo, hi = lo[~one], hi[~one]
        size = hi - lo + 1
        ends = np.cumsum(size, dtype=np.int32)
        which = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        rows = np.arange(len(which), dtype=np.int32) + np.repeat(lo - ends + size, size)
        real = bwt[rows] != _SEP
        to, which = lf[rows[real]], which[real]
        owner[to] = which
        to.sort()
        o, c = owner[to], head[to]
        new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (c[1:] != c[:-1])][: len(to)])
        a, b = np.r_[to[new], alone], np.r_[to[np.r_[new[1:], len(to)] - 1] if len(to) else to, alone]
        fresh = ~known[b + 1]
        known[b[fresh] + 1] = True
        lo, hi = a[fresh], b[fresh]
    return known[:n]


def joined_text(snippets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The snippets' bytes, a separator after each, and their sizes."""
    sizes = pc.binary_length(snippets).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.full(int(sizes.sum()) + len(sizes), _SEP, np.uint8)
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(snippets)], pa.int32()), snippets), b"")[0].as_buffer(), np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
    return text, sizes


def split(snippets: pa.Array, h: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The snippets of anchors h in smaller parts: number of the snippet, a finer anchor, the part's place in the snippet, the part.

    A window's finer anchor is the hash of nearly all of it: of length - STEP + 1 bytes whose place the anchor's first occurrence in the
    window tells, to STEP bytes. So equal windows have equal finer anchors, and a part has at most STEP windows.
    """
    text, sizes = joined_text(snippets)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    here = np.full(len(text), len(text))
    at = np.flatnonzero(mixed(grams(text, GRAM)).view(np.int64) == h[owner[: len(text) - GRAM + 1]])
    at = at[at + GRAM < ends[owner[at]]]
    here[at] = at
    here = np.minimum.accumulate(here[::-1])[::-1]
    window = np.flatnonzero(np.arange(len(text)) < (ends - length)[owner])
    offset = (here[window] - window) // STEP
    base = here[window] - offset * STEP
    first = np.flatnonzero(np.r_[True, (base[1:] != base[:-1]) | (owner[window[1:]] != owner[window[:-1]])])
    last = np.r_[first[1:], len(window)] - 1
    finer = mixed(grams(text, length - STEP + 1)[base[first]] * np.uint64(2 * STEP + 1) + offset[first].astype(np.uint64))
    begin, size = window[first], window[last] - window[first] + length
    parts = tokens.binaries(text[np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)], size)
    return owner[begin], finer.view(np.int64), begin - starts[owner[begin]], parts


def decide(snippets: pa.Array, docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The least document id of the string of each window of each snippet (at least ``length`` bytes), and how many windows a snippet has."""
    text, sizes = joined_text(snippets)
    order = suffix_order(text, length)
    bounds = bounded_boundaries(text, order, length)
    windows = sizes - length + 1
    ends = np.cumsum(sizes + 1)
    snippet = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = np.arange(len(text)) < (ends - length)[snippet]
    ranked = order[whole[order]]
    group = np.cumsum(bounds)[whole[order]]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(docs[snippet[ranked]], first)
    out = np.zeros(len(text), np.int64)
    out[ranked] = np.repeat(least, np.diff(np.r_[first, len(ranked)]))
    return out[whole], windows


def runs(least: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> pa.ListArray:
    """For each snippet the byte ranges [a, b) that windows of one least document id cover, with that id."""
    begin = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(windows)), windows)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[begin] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(least)] - 1
    each = pa.StructArray.from_arrays([pa.array(first - begin[owner[first]]), pa.array(last - begin[owner[last]] + length), pa.array(least[first])], ["a", "b", "m"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner[first], minlength=len(windows)))], pa.int32()), each)


_LARGEST = (1 << 63) - 1


def find(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, row, spans): the bytes [a, b) that go from the document, unmerged; row is a hash of the text.

    Rows of a text that a smaller id has too go whole. So only one row of each text takes part in the search, and an anchor
    counts if it occurs in two different texts.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LARGEST)).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc", "text", F.xxhash64("text").alias("row"))

    # digests alone are shuffled; equal SHA-256 digests are equal texts
    narrow = rows.select("doc", F.xxhash64("text").alias("row"), F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest")).where(F.col("n") >= length)
    # only texts with copies are joined, as a table, so that one with very many rows can be split
    copied = materialize(narrow.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("digest", "first"), "copied-texts")
    first = materialize(narrow.join(copied, "digest", "left").select("doc", "row", "n", F.coalesce("first", "doc").alias("first")).distinct(), "texts")
    remove(spark, copied)
    copies = first.where("doc > first").select("doc", "row", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("spans"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
            for a, b in pieces(pc.binary_length(texts).to_pylist()):
                owner, h, _, _, _, mark = marked(texts.slice(a, b - a).to_pylist(), length)
                order = np.lexsort((mark, h, owner))
                owner, h, mark = owner[order], h[order], mark[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])][: len(h)]  # a snippet counts once a text
                each, h, mark = keys[a:b][owner[new]], h[new], mark[new]
                for at in range(0, len(h), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (h, each, mark)], ["h", "row", "mark"])
        trim()

    hot_from, sampled = HOT, SAMPLED

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The repeated anchors of rows (h, row, mark) in order of h."""
        for now in whole_keys(batches, MEET):
            out = shared(*(now.column(c).to_numpy() for c in range(3)), hot_from, sampled)
            for at in range(0, len(out[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in out], ["row", "h", "hot"])
        trim()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (row, h, hot) in order of row: the keys each text shares, and its hot anchors."""
        for now in whole_keys(batches, MEET):
            row, h, hot = now.column(0).to_numpy(), now.column(1), now.column(2)
            edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            ends = np.r_[0, np.cumsum(hot.to_numpy(zero_copy_only=False))]
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[edge, len(row)] - ends[np.r_[edge, len(row)]], pa.int32()), h.filter(pc.invert(hot))), pa.ListArray.from_arrays(pa.array(ends[np.r_[edge, len(row)]], pa.int32()), h.filter(hot))]
            yield from pa.Table.from_arrays([pa.array(row[edge]), *lists], ["row", "hs", "hots"]).to_batches(max_chunksize=2_000)
        trim()

    found = keyed.select("row", "text").mapInArrow(hashes, "h long, row long, mark long")
    repeated = found.repartition("h").sortWithinPartitions("h").mapInArrow(meet, "row long, h long, hot boolean")
    by_row = repeated.repartition("row").sortWithinPartitions("row").mapInArrow(listed, "row long, hs array<long>, hots array<long>")
    one = first.where("doc = first").select("doc", F.col("row").alias("r"))
    mine = materialize(one.join(by_row, F.col("r") == F.col("row")).select("doc", "row", "hs", "hots"), "anchors-by-text", batch=ROWS, size=BYTES)

    mid = middle(length)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with their repeated anchors, the snippets' places and sizes, the hot anchors, and the bytes of text and snippets."""
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for x, y in pieces(sizes.tolist()):
                owner, h, a, b, p, mark = marked(texts.slice(x, y - x).to_pylist(), length)
                keys = batch.column(3).slice(x, y - x).flatten().to_numpy()  # shared by one text is shared by all
                whole, (left, right) = np.isin(h, keys), (np.isin(k, keys) for k in sided(h, mark))
                left, right = whole | left & (mark >> 32 > 0), whole | right & (mark > 0) & (mark & 0xFFFFFFFF != 0)
                a, b = np.where(left, a, np.maximum(a, p - mid + 1)), np.where(right, b, np.minimum(b, p - mid))
                hit = np.flatnonzero((left | right) & (a <= b))
                owner, h, at, size = owner[hit], h[hit], a[hit].astype(np.int32), (b[hit] - a[hit] + length).astype(np.int32)
                edges = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=y - x))], pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (h, at, size)]
                cut_bytes = np.bincount(owner, size, minlength=y - x).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(x, y - x) for c in range(3)), *lists, batch.column(4).slice(x, y - x), pa.array(sizes[x:y]), pa.array(cut_bytes)], ["doc", "row", "text", "hs", "at", "size", "hots", "n", "cut"])
        trim()

    def cut(part: int, parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The snippets of the anchors of one part; of hot anchors, the finer ones."""
            for batch in batches:
                docs_, rows_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                texts = batch.column(2).cast(pa.binary())
                for x, y in pieces(pc.binary_length(texts).to_pylist()):
                    raws = texts.slice(x, y - x).to_pylist()
                    lists = [batch.column(c).slice(x, y - x) for c in (3, 4, 5)]
                    o = np.repeat(np.arange(y - x), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
                    h, at, size = (c.flatten().to_numpy() for c in lists)
                    hit = np.flatnonzero(h.view(np.uint64) % np.uint64(parts) == part)
                    o, h, at, to = o[hit], h[hit], at[hit].astype(np.int64), at[hit].astype(np.int64) + size[hit]
                    is_hot = np.isin(h, batch.column(6).slice(x, y - x).flatten().to_numpy())
                    for which, most in ((np.flatnonzero(~is_hot), 20_000), (np.flatnonzero(is_hot), 4_000)):
                        for i in range(0, len(which), most):
                            z = which[i : i + most]
                            snips = pa.array([raws[k][s:e] for k, s, e in zip(o[z].tolist(), at[z].tolist(), to[z].tolist())], pa.binary())
                            key, place = h[z], at[z]
                            if most == 4_000:
                                of, key, inside, snips = split(snips, key, length)
                                z, place = z[of], place[of] + inside
                            yield pa.RecordBatch.from_arrays([pa.array(docs_[x + o[z]]), pa.array(rows_[x + o[z]]), pa.array(key), pa.array(place), snips], ["doc", "row", "h", "at", "snip"])
            trim()

        return run

    both = keyed.join(mine, ["doc", "row"]).select("doc", "row", "text", "hs", "hots")
    placed = materialize(both.mapInArrow(locate, "doc long, row long, text string, hs array<long>, at array<int>, size array<int>, hots array<long>, n long, cut long"), "anchors-placed", batch=BATCH)
    remove(spark, mine)
    bytes_, snips = (x or 0 for x in placed.agg(F.sum("n"), F.sum("cut")).first())
    parts = max(1, -(-snips // max(int(SHARE * bytes_), SMALL)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, sid, doc, snip) come by anchor; whole anchors of about PIECE bytes of text are sorted at a time."""
        for now in whole_keys(batches, PIECE):
            yield from settle(now)
        trim()

    def settle(now: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h = now.column(0).to_numpy()
        size = np.cumsum(pc.binary_length(now.column(3)).to_numpy(zero_copy_only=False) + 1)
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        part = size[edge] // PIECE
        cuts = [*edge[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])].tolist(), len(h)]
        for a, b in zip(cuts, cuts[1:]):
            some = now.slice(a, b - a)
            least, windows = decide(some.column(3), some.column(2).to_numpy(), length)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), runs(least, windows, length)], ["h2", "s2", "runs"])

    def spans_of(part: int) -> DataFrame:
        """(doc, row, spans) by the anchors of one part; what was written on the way is gone."""
        occ = placed.select("doc", "row", "text", "hs", "at", "size", "hots").mapInArrow(cut(part, parts), "doc long, row long, h long, at long, snip binary")
        occ = materialize(occ.withColumn("sid", F.xxhash64("snip")), "snippets", batch=BATCH)
        distinct = occ.groupBy("h", "snip").agg(F.min("doc").alias("doc")).withColumn("sid", F.xxhash64("snip"))
        judged = distinct.select("h", "sid", "doc", "snip").repartition("h").sortWithinPartitions("h").mapInArrow(judge, "h2 long, s2 long, runs array<struct<a: long, b: long, m: long>>")
        judged = materialize(judged, "judged")
        back = occ.select("doc", "row", "h", "at", "sid").join(judged, (F.col("h") == F.col("h2")) & (F.col("sid") == F.col("s2")))
        gone = back.select("doc", "row", "at", F.explode(F.expr("filter(runs, r -> r.m < doc)")).alias("r")).select("doc", "row", F.struct((F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b")).alias("s"))
        out = materialize(gone.groupBy("doc", "row").agg(F.collect_set("s").alias("spans")), "spans-of-part")
        for x in (occ, judged):
            remove(spark, x)
        return out

    found_in = [spans_of(k) for k in range(parts)]
    remove(spark, placed)
    spans = found_in[0]
    for x in found_in[1:]:
        spans = spans.unionByName(x)
    spans = spans.groupBy("doc", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = materialize(spans.unionByName(copies), "spans")
    for x in (*found_in, first):
        remove(spark, x)
    return out


def merged(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (owner, a, b) covered by each owner's ranges [a, b), in order."""
    if not len(a):
        return owner, a, b
    width = int(b.max()) + 1
    a, b = a + owner * width, b + owner * width
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    owner = a[first] // width
    return owner, a[first] - owner * width, reach[np.r_[first[1:], len(a)] - 1] - owner * width


def dedup(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; kept is what is left, as bytes."""
    spans = find(docs, length, text, key)
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LARGEST)).alias("d2"), F.xxhash64("text").alias("r2"))
    both = keyed.join(spans, (F.col("d2") == F.col("doc")) & (F.col("r2") == F.col("row")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for x, y in tokens.byte_groups(texts):
                raws, lists = texts.slice(x, y - x).to_pylist(), batch.column(2).slice(x, y - x)
                flat = lists.flatten()
                owner = np.repeat(np.arange(y - x), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                owner, a, b = merged(owner, flat.field("a").to_numpy(zero_copy_only=False), flat.field("b").to_numpy(zero_copy_only=False))
                spans = np.bincount(owner, minlength=y - x)
                removed = np.bincount(owner, b - a, minlength=y - x).astype(np.int64)
                kept, k, a, b = [], 0, a.tolist(), b.tolist()
                for raw, n in zip(raws, spans.tolist()):
                    edges = [0, *(e for s in range(k, k + n) for e in (a[s], b[s])), len(raw)]
                    kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])) if n else raw)
                    k += n
                sizes = pa.array([len(r) for r in raws], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), sizes, pa.array(removed), pa.array(spans.astype(np.int64)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM b WHERE length(x) >= 100),
s AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY substr(x, 2 * i + 1, 100)) AS gone FROM p),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM s WHERE gone),
r AS (SELECT doc_id, i, sum(CASE WHEN step IS NULL OR step > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
m AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM m),
j AS (SELECT doc_id, string_agg(substr(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS front, max(z) AS last, sum(z - a) AS n, count(*) AS c FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN j.doc_id IS NULL THEN x ELSE front || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM b LEFT JOIN j ON j.doc_id = b.doc_id
"""
