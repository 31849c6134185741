"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. With r blocks of bits, two
fingerprints at most d bits apart agree on at least r - d whole blocks, so every such pair meets in a bucket of some
r - d blocks; there the distance is verified. r grows with the number of distinct fingerprints, so that buckets of
unrelated fingerprints stay small; every choice of r finds every pair. Equal fingerprints are one node, a bucket hands
on one edge a member, not its pairs, and large buckets are compared cell by cell (:mod:`graph`).

Defined results: null and empty texts have fingerprint zero, linked like any other; rows with equal keys count as one
document; null keys are left out of the links and get a null component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.session import materialize, ship

from . import graph

_ROWS = 1 << 16
#: Shingles in a cell of documents that are verified against another one.
_MOST = 1 << 20


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; fewer words than a shingle make one, none make none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return int(majority(shingle_hashes(text, shingle)))


def majority(h: np.ndarray) -> np.uint64:
    """A bit is set where over half of the hashes have it."""
    n = len(h)
    count = np.zeros(64, np.int64)
    for i in range(0, n, _ROWS):
        part = h[i : i + _ROWS].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > n).view(">u8")[0].astype(np.uint64)


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes under the k-th further hash function (0: as they are)."""
    if not k:
        return h
    x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)  # an odd multiplier
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def fingerprints(docs: DataFrame, shingle: int = 4, functions: int = 1, text: str = "text", key: str = "doc_id", sets: bool = False) -> DataFrame:
    """(doc_id, fps): a fingerprint for each hash function, the 64 bits as a signed long.

    ``sets`` counts a repeated shingle once and adds ``set_id``, a digest of the set of shingle hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids = np.empty((batch.num_rows, functions), np.uint64), []
            for i, t in enumerate(batch.column(1)):
                h = shingle_hashes(t.as_py(), shingle)
                if sets:
                    h = np.unique(h)
                    ids.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                fps[i] = [majority(remixed(h, k)) for k in range(functions)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * functions, pa.int32()), pa.array(fps.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, *([pa.array(ids, pa.binary())] if sets else [])], ["doc_id", "fps", "set_id"][: 2 + sets])

    ship(docs.sparkSession)
    schema = "doc_id long, fps array<long>" + ", set_id binary" * sets
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def block_keys(n: int, distance: int, spare: float = 4.0) -> list[int]:
    """Bit masks of the bucket keys for n distinct fingerprints: r - distance of r blocks each."""
    r = distance + 1
    while r < 2 * distance and n / 2 ** (64 * (r - distance) / r) > spare:
        r += 1
    edges = [round(64 * i / r) for i in range(r + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, r - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near(nodes: DataFrame, distance: int = 4, spare: float = 4.0, total: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the nodes (node, fps) whose fingerprints by the same hash function are within the distance.

    With ``total``, also nodes that share a bucket and differ in at most so many bits over all hash functions.
    """
    masks = block_keys(nodes.count(), distance, spare)
    each = nodes.select("node", "fps", F.posexplode("fps").alias("f", "fp"))
    keys = F.explode(F.array(*[F.xxhash64(F.col("f") * len(masks) + i, F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for i, m in enumerate(masks)]))
    rows = each.select(keys.alias("bucket"), "node", F.col("fp" if total is None else "fps").alias("fp"))

    def flat(x):
        return x.view(np.uint64).reshape(len(x), -1)

    def close(x, y):
        """Whether the fingerprints (last axis: hash functions) of two broadcastable arrays are near."""
        bits = [np.bitwise_count(x[..., f] ^ y[..., f]) for f in range(x.shape[-1])]
        hit = np.logical_or.reduce([b <= distance for b in bits])
        return hit if total is None else hit | (np.add.reduce([b.astype(np.uint16) for b in bits]) <= total)

    def compare(col, mine, others, same):
        idx = mine if same else np.sort(np.r_[mine, others])
        idx = idx[np.argsort(col["node"][idx], kind="stable")]
        fp, ids = flat(col["fp"][idx]), col["node"][idx]
        links = np.zeros((len(fp), len(fp)), bool)
        for i in range(0, len(fp), 512):
            links[i : i + 512] = close(fp[i : i + 512, None], fp[None])
        child, parent = graph.tree(links)
        gather(ids[parent], ids[child])
        return ()

    def linked(col, i, j):
        return close(flat(col["fp"][i]), flat(col["fp"][j]))

    def take(col, i, j):
        gather(col["node"][i], col["node"][j])
        return ()

    # many buckets connect the same nodes again: a task hands on no more pairs than it has nodes
    out: list[tuple[np.ndarray, np.ndarray]] = []
    size = [0, 1 << 18]

    def gather(a, b):
        out.append((a, b))
        size[0] += len(a)
        if size[0] > size[1] or len(out) > 20_000:
            contract()
            size[1] = max(size[1], 2 * size[0])

    def contract():
        out[:] = [graph.stars(*(np.concatenate([x[k] for x in out] + [np.zeros(0, np.int64)]) for k in (0, 1)))]
        size[0] = len(out[0][0])

    def flush():
        contract()
        pairs = out.pop()
        size[0] = 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])

    return graph.compare_in_buckets(rows, "a long, b long", compare, finish=flush, linked=linked, take=take)


def _verified(edges: DataFrame, docs: DataFrame, shingle: int, jaccard: float, text: str, key: str) -> DataFrame:
    """Edges that connect the documents whose sets of shingles have at least this Jaccard similarity.

    Every two documents of a connected group of candidates are tested, and only then is a spanning forest handed on.
    Texts are fetched for members of such groups alone, their sets once a document; large groups are dealt into cells.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column(2)]
            size = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), size], ["bucket", "node", "set", "size"])

    def compare(col, mine, others, same):
        idx = mine if same else np.r_[mine, others]
        idx = idx[np.argsort(col["node"][idx], kind="stable")]
        size = np.array([len(x) for x in col["set"][idx]])
        both = graph.overlaps(list(col["set"][idx]))
        child, parent = graph.tree(both >= jaccard * (size[:, None] + size[None, :] - both))
        out.append((col["node"][idx[parent]], col["node"][idx[child]]))
        if len(out) > 5_000:
            yield flush()

    out: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        pairs = [np.concatenate([x[k] for x in out] + [np.zeros(0, np.int64)]) for k in (0, 1)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])

    members = graph.components(edges, "candidates").select(F.col("component").alias("bucket"), F.col("node"))
    texts = members.join(docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("_t")), "node").select("bucket", "node", "_t").distinct()
    rows = materialize(texts.mapInArrow(sets, "bucket long, node long, set array<long>, size long"), "sets")
    return graph.compare_in_buckets(rows, "a long, b long", compare, finish=flush, weight="size", most=_MOST)


def groups(docs: DataFrame, shingle: int = 4, distance: int = 4, functions: int = 1, jaccard: float | None = None, spare: float = 4.0, text: str = "text", key: str = "doc_id", total: int | None = None) -> DataFrame:
    """(doc_id, fps, component_id) for every document; component_id is the least id reachable over links.

    With several hash functions a pair within the distance by any of them is a candidate; ``jaccard`` then keeps the
    candidates whose shingle sets are that similar. There fingerprints are those of the sets, only documents with
    equal sets are one node, and equal fingerprints are candidates like others. One 64-bit fingerprint with a short
    distance finds few of the pairs at 0.8; several with a longer one find most, and ``total`` (see :func:`near`)
    nearly all: at 0.8 a bit differs with about 0.15, in unrelated texts with 0.5.
    """
    same = "fps" if jaccard is None else "set_id"
    fps = materialize(fingerprints(docs, shingle, functions, text, key, sets=jaccard is not None), "fingerprints")
    nodes = materialize(fps.where("doc_id is not null").groupBy(*{"fps": 0, same: 0}).agg(F.min("doc_id").alias("node")), "nodes")
    edges = materialize(near(nodes, distance, spare, total), "near")
    if jaccard is not None:
        edges = _verified(edges, docs, shingle, jaccard, text, key)
    # rows of one id are one document: their nodes are linked
    several = fps.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    of = fps.join(several, "doc_id").join(nodes.select(same, "node"), same).select("doc_id", "node")
    least = of.groupBy("doc_id").agg(F.min("node").alias("a"))
    edges = edges.unionByName(of.join(least, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    comp = graph.components(edges)
    by_node = nodes.join(comp, "node", "left").select(same, F.coalesce("component", "node").alias("component_id"))
    out = fps.join(by_node, same, "left")
    return out.select("doc_id", "fps", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
