"""Connected components and bucketed comparison, both without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.session import materialize, remove, ship

#: Members of a bucket compared in one piece; a larger bucket is dealt out as pairs of cells of about this size.
CELL = 2048
MOST_BROADCAST = 100_000
#: Buckets up to this size are tested as whole columns of pairs, this many rows at a time.
SMALL, CHUNK = 64, 100_000
#: Values of more sets than this are counted by matrix products.
FEW = 32


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), two longs; the component is its least node.

    Alternating stars: every node's neighbours are re-linked to the least of them, first the larger ones, then the
    smaller ones, until nothing changes. Only minima are aggregated, so a hub's edges stay spread over tasks. Every
    round is written to the shared folder. Self-loops give a node on its own; empty input gives no rows.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    was = state(now)
    while was[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: neighbours above the node go to the least
        large = both.join(least, both.a == least.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below it, and the node itself
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low, large.a == low.n).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("n", "m")).where("a <> b").distinct()
        nxt = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        remove(now.sparkSession, now)
        now, old, was = nxt, was, state(nxt)
        if was == old:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).union(loops.select("node", "node"))
    return out.groupBy("node").agg(F.min("component").alias("component"))


def linked_pairs(starts: np.ndarray, ends: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket number, i, j) of the pairs within the runs [start, end) that pass ``test(i, j)``, found a distance at a time."""
    size = ends - starts
    which = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(which)) + np.repeat(starts - np.cumsum(size) + size, size)
    after = ends[which] - at - 1
    out: list[tuple[np.ndarray, ...]] = []
    for d in range(1, int(size.max(initial=1))):
        fits = after >= d
        which, at, after = which[fits], at[fits], after[fits]
        hit = np.flatnonzero(test(at, at + d))
        out.append((which[hit], at[hit], at[hit] + d))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def compare_in_buckets(rows: DataFrame, schema: str, compare: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, bool], Iterator[pa.RecordBatch]], finish: Callable[[], pa.RecordBatch], linked: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray] | None = None, take: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], Iterator[pa.RecordBatch]] | None = None, weight: str | None = None, most: int = 1) -> DataFrame:
    """Bring the rows of each bucket (column ``bucket``, long) together and compare them.

    compare(columns, mine, others, same) gets numpy columns of a task's rows and the indexes of two sides of a bucket's
    cell (``same``: one side with itself, to be compared once a pair); it yields record batches of ``schema`` when it has
    gathered enough, and finish() gives the last one. A bucket
    of more than CELL rows is dealt into cells and every pair of cells becomes a unit of its own, so no task holds or
    compares more than two cells of a bucket at once, and every pair of rows still meets exactly once.

    With ``linked`` (which of the pairs at two aligned index arrays are links) and ``take`` (gathers linked pairs) the
    buckets of up to SMALL rows are tested as columns. Of these compare gets only the dense ones, with over two links a
    row; the others' links are taken one by one. Rows of a bucket then stand by their first column.

    With ``weight`` (a column, not handed on) a cell also holds about ``most`` of its sum at most. Lists come as a matrix
    where all are of one length and no weight is given, otherwise as an array of arrays.
    """
    spark = rows.sparkSession
    ship(spark)
    cells = F.ceil(F.count(F.lit(1)) / CELL)
    if weight:
        cells = F.greatest(cells, F.ceil(F.sum(weight) / most))
    counts = rows.groupBy("bucket").agg(cells.cast("int").alias("cells")).where("cells > 1")
    big = materialize(counts, "large-buckets")
    some = big.limit(MOST_BROADCAST + 1).count()
    names = [c for c in rows.columns if c not in ("bucket", weight)]
    if some:  # 12 bytes a large bucket; beyond the checked number the join is an ordinary one
        rows = rows.join(F.broadcast(big) if some <= MOST_BROADCAST else big, "bucket", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        rows = rows.withColumn("cell", F.pmod(F.xxhash64(*[F.col(c) for c in names[:1]]), F.col("cells")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, cells - 1)")))
        code = (F.least("cell", "other").cast("long") * (1 << 31) + F.greatest("cell", "other")) * 2 + (F.col("cell") <= F.col("other")).cast("long")
        dealt = rows.select("bucket", code.alias("code"), *names)
    else:
        dealt = rows.select("bucket", F.lit(1).cast("long").alias("code"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        col = {}
        for c in t.column_names:
            x = t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
            if pa.types.is_list(x.type) and weight:
                flat, at = x.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]
                col[c] = np.empty(len(x), object)
                col[c][:] = [flat[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            elif pa.types.is_list(x.type):
                width = len(x.values) // max(len(x), 1)
                col[c] = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)
            else:
                col[c] = x.to_numpy(zero_copy_only=False)
        unit = col["code"] >> 1
        order = np.lexsort(((col[names[0]],) if linked else ()) + (unit, col["bucket"]))
        b, u = col["bucket"][order], unit[order]
        new = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (u[1:] != u[:-1])])
        ends = np.r_[new[1:], len(order)]
        size = ends - new
        several = np.flatnonzero(size > 1)
        if linked:
            one_cell = u[new] >> 31 == u[new] & ((1 << 31) - 1)
            small = np.flatnonzero((size > 1) & (size <= SMALL) & one_cell)
            several = np.flatnonzero((size > 1) & ~((size <= SMALL) & one_cell))
            piece = np.cumsum(size[small]) // CHUNK
            for part in np.split(small, np.flatnonzero(np.diff(piece)) + 1):
                k, i, j = linked_pairs(new[part], ends[part], lambda x, y: linked(col, order[x], order[y]))
                dense = np.bincount(k, minlength=len(part)) > 2 * size[part]
                few = ~dense[k]
                yield from take(col, order[i[few]], order[j[few]])
                several = np.r_[several, part[dense]]
        for s, e in zip(new[several].tolist(), ends[several].tolist()):
            idx, pair = order[s:e], int(u[s])
            if pair >> 31 == pair & ((1 << 31) - 1):
                yield from compare(col, idx, idx, True)
            else:
                first = (col["code"][idx] & 1).astype(bool)
                if first.any() and not first.all():
                    yield from compare(col, idx[first], idx[~first], False)
        yield finish()

    return dealt.repartition(F.xxhash64("bucket", F.shiftright("code", 1))).mapInArrow(run, schema)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the intersections of sets (arrays of distinct values); the diagonal isn't counted.

    Values of few sets are counted pair by pair, those of many (at most 1/FEW of all entries) by matrix products.
    """
    n = len(sets)
    out = np.zeros((n, n), np.int32)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values = np.concatenate([*sets, np.zeros(0, np.int64)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])[: len(values)]
    size = np.diff(np.r_[starts, len(values)])
    rare = (size > 1) & (size <= FEW)
    _, i, j = linked_pairs(starts[rare], starts[rare] + size[rare], lambda a, b: np.ones(len(a), bool))
    np.add.at(out, (owner[i], owner[j]), 1)
    out += out.T
    common = np.flatnonzero(size > FEW)
    for k in range(0, len(common), 2048):
        part = common[k : k + 2048]
        has = np.zeros((n, len(part)), np.float32)
        for c, (s, m) in enumerate(zip(starts[part].tolist(), size[part].tolist())):
            has[owner[s : s + m], c] = 1
        out += (has @ has.T).astype(np.int32)  # at most 2,048 a product: exact
    return out


def spanning(links: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n items from their symmetric boolean link matrix."""
    n = len(links)
    label = np.full(n, -1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        front = np.array([seed])
        while len(front):
            near = links[front].any(axis=0) & (label < 0)
            front = np.flatnonzero(near)
            label[front] = seed
    return label


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest pairs that connect the same nodes as the pairs (a, b): the least node of each connected group with every other one."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[far]], nodes[far]


def tree(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of n items' symmetric boolean link matrix as (item, parent), every edge a link; roots are least."""
    label = spanning(links)
    child = np.flatnonzero(label != np.arange(len(links)))
    direct = links[child, label[child]]
    parent = label[child]
    if not direct.all():
        done = np.zeros(len(links), bool)
        done[label[label == np.arange(len(links))]] = True
        done[child[direct]] = True
        left, front = child[~direct], done.copy()
        while len(left):
            near = links[left][:, front]
            got = near.any(axis=1)
            parent[np.searchsorted(child, left[got])] = np.flatnonzero(front)[near[got].argmax(axis=1)]
            front = np.zeros(len(links), bool)
            front[left[got]] = True
            left = left[~got]
    return child, parent
