"""Top-k inner-product search, exact and over quantized codes: single, filtered, paged and batched.

``filter`` is applied before the top-k, by a semi join below the scoring; predicates on the result apply after it. Ties
stand by ascending id. Scoring in batches keeps k rows a query and task, so what is shuffled is k * tasks rows a query.
Query tables of a checked size are broadcast; larger ones meet the rows in a grid of cells of rows and queries. A task
never holds more than ``SCORES`` scores at once, besides the best so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.errors import DimensionMismatch, InvalidSearch
from stratavec.functions import quant, vectors
from stratavec.session import materialize, ship

#: Rows up to which a top-k is held by every task; longer pages are cut out of the written order.
TOP = 10_000
#: Bytes of query vectors broadcast at most, and scores a task computes at a time.
QUERY_BYTES, SCORES = 16 << 20, 4 << 20
#: Rows and queries of a cell, where there are more queries.
ROW_CELL, QUERY_CELL = 65_536, 4_096
#: Rows from which a staged search shortlists by bit planes first, and how many times k (and at least how many rows) it keeps.
STAGED_ROWS, STAGED_FACTOR, STAGED_LEAST = 32_768, 32, 512


def effective_k(k: int | None = None, limit: int | None = None, offset: int = 0, rows: int | None = None, order: str | None = "score desc") -> tuple[int | None, int]:
    """How many candidates a search fetches (null: all), and its offset.

    Raises where neither k nor limit is given, where a limit lacks the plain descending score order, where k and
    limit come together without that order, and for a negative k. A negative limit is no limit, a negative offset is 0.
    """
    offset = max(offset or 0, 0)
    if k is None and limit is None:
        raise InvalidSearch("a search needs k or a limit")
    if limit is not None and order != "score desc":
        raise InvalidSearch("a limit needs ORDER BY the unmodified score, descending")
    n = None
    if k is not None:
        n = vectors.check_k(k)
    if limit is not None and limit >= 0:
        n = limit + offset if n is None else min(n, limit + offset)
    if rows is not None:
        n = rows if n is None else min(n, rows)
    return n, offset


def allowed(df: DataFrame, filter: DataFrame | list | None, key: str = "id") -> DataFrame:
    """Rows whose id is in ``filter``; null, negative and unknown ids are ignored, other types are refused."""
    if filter is None:
        return df
    if isinstance(filter, (list, tuple, set)):
        if any(x is not None and (isinstance(x, bool) or not isinstance(x, int)) for x in filter):
            raise TypeError("an allowlist holds integers")
        ids = sorted({x for x in filter if x is not None and x >= 0})
        return df.where(F.col(key).isin(ids)) if ids else df.where(F.lit(False))
    name, kind = filter.dtypes[0]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("an allowlist holds integers")
    return df.join(filter.select(F.col(name).cast("long").alias("_allowed")).where("_allowed >= 0"), F.col(key) == F.col("_allowed"), "left_semi")


def _paged(scored: DataFrame, n: int | None, offset: int) -> DataFrame:
    """Rows ``offset`` to ``n`` (null: all) by score and id.

    A page that ends beyond TOP is found by place: the order is written, a row's place is its place in its partition
    and what the partitions before it hold. So no task holds or gets more than its own range.
    """
    order = [F.desc("score"), F.col("id")]
    out = scored.orderBy(*order)
    if n is None and not offset:
        return out
    if n is not None and n <= TOP:
        out = out.limit(n)
        return out.offset(offset) if offset else out
    placed = materialize(out.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at")
    page = placed.join(F.broadcast(before), "_part").where(place >= offset)  # one row a partition
    return (page if n is None else page.where(place < n)).select(*scored.columns).orderBy(*order)


def knn(rows: DataFrame, query, k: int | None = None, limit: int | None = None, offset: int = 0, filter=None, order: str | None = "score desc", key: str = "id", column: str = "embedding") -> DataFrame:
    """(id, score) of the exact top-k for one query: a literal vector, or a one-row DataFrame with one vector column."""
    n, offset = effective_k(k, limit, offset, None, order)
    base = allowed(rows.select(F.col(key).alias("id"), F.col(column).alias("v")), filter)
    if isinstance(query, DataFrame):
        base = base.crossJoin(F.broadcast(query.select(F.col(query.columns[0]).alias("q")).limit(1)))  # one row
        q = F.col("q")
    else:
        q = F.array(*[F.lit(float(x)) for x in vectors.parse(query)])
    return _paged(base.select("id", vectors.dot(F.col("v"), q).alias("score")), n, offset)


class _Top:
    """The k best rows of each query so far, by score then id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        """s: scores, rows by queries."""
        if not self.k or not s.size:
            return
        cut = self.floor
        if self.k < len(s):
            cut = np.maximum(cut, np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k])
        row, query = np.nonzero((s >= cut) & (s > -np.inf))
        query, id_, score = np.r_[self.query, query], np.r_[self.id, ids[row]], np.r_[self.score, s[row, query]]
        order = np.lexsort((id_, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        order = order[keep]
        self.query, self.id, self.score = query[keep], id_[order], score[order]
        last = rank[keep] == self.k - 1
        self.floor[self.query[last]] = self.score[last]

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(qids[self.query]), pa.array(self.id), pa.array(self.score)], ["qid", "id", "score"])


_HITS = "qid long, id long, score double"


def _slices(batch: pa.RecordBatch, queries: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SCORES // max(queries, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(lists)
    if n and len(flat) != n * (len(flat) // n) or (np.diff(lists.offsets.to_numpy()) != (len(flat) // n if n else 0)).any():
        raise DimensionMismatch("vectors differ in their dimensions")
    return flat.reshape(n, -1)


def _grid(rows: DataFrame, queries: DataFrame, k: int, prepare: Callable, score: Callable, by: list[str], schema: list[str]) -> DataFrame:
    """The hits of every cell: rows and queries carry the cell's columns ``by``, and each pair of a row and a query shares one cell."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, top = prepare(_matrix(right["embedding"].combine_chunks())), _Top(right.num_rows, k)
        for batch in left.select(schema).combine_chunks().to_batches() if right.num_rows else []:
            for part in _slices(batch, len(q)):
                top.add(part.column(0).to_numpy(), score(part, q))
        return pa.Table.from_batches([top.batch(right["qid"].to_numpy())])

    other = queries.withColumnsRenamed({c: f"{c}2" for c in by})  # rows and queries may come from one table
    return rows.groupBy(*by).cogroup(other.groupBy(*[f"{c}2" for c in by])).applyInArrow(run, _HITS)


def _batch(rows: DataFrame, queries: DataFrame, k: int, prepare: Callable, score: Callable) -> DataFrame:
    """(qid, id, score, rank): score(batch of rows, prepare(query matrix)) gives a matrix, rows by queries."""
    spark = rows.sparkSession
    ship(spark)
    queries = queries.select(F.col(queries.columns[0]).cast("long").alias("qid"), F.col(queries.columns[1]).alias("embedding"))
    if dict(queries.dtypes)["embedding"] in ("string", "binary"):
        queries = queries.withColumn("embedding", vectors.f32_array("embedding"))
    n, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n * max(dims or 0, 1) * 8 <= QUERY_BYTES:
        got = queries.collect()  # at most QUERY_BYTES
        qids = np.array([r.qid for r in got], np.int64)
        parsed = [vectors.parse(r.embedding) for r in got]
        if len({len(x) for x in parsed}) > 1:
            raise DimensionMismatch("queries differ in their dimensions")
        held = spark.sparkContext.broadcast((qids, np.stack(parsed).astype(np.float64) if got else np.zeros((0, 0))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = held.value
            if not len(qids):
                return
            q, top = prepare(q), _Top(len(qids), k)
            for batch in batches:
                for part in _slices(batch, len(qids)):
                    top.add(part.column(0).to_numpy(), score(part, q))
            yield top.batch(qids)

        found = rows.mapInArrow(run, _HITS)
    else:
        across, down = -(-n // QUERY_CELL), max(1, -(-rows.count() // ROW_CELL))
        names = rows.columns
        left = rows.withColumn("_r", F.pmod(F.xxhash64("id"), F.lit(down).cast("long"))).withColumn("_q", F.explode(F.expr(f"sequence(0L, {across - 1}L)")))
        right = queries.withColumn("_q", F.pmod(F.xxhash64("qid"), F.lit(across).cast("long"))).withColumn("_r", F.explode(F.expr(f"sequence(0L, {down - 1}L)")))
        found = _grid(left, right, k, prepare, score, ["_r", "_q"], names)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _inner(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    x = _matrix(batch.column(1))
    if x.shape[1] != q.shape[1]:
        raise DimensionMismatch(f"vectors differ from the queries' {q.shape[1]} dimensions")
    return x @ q.T


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, filter=None, key: str = "id", column: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the exact top-k of each row (qid, embedding) of ``queries``."""
    base = allowed(rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v")), filter)
    return _batch(base, queries, vectors.check_k(k), lambda q: q, _inner)


def knn_within(rows: DataFrame, by: str, k: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): each row's exact top-k among the other rows of its group, in one pass.

    A group of more than ROW_CELL rows is dealt into cells, and every two cells of it meet in a task of their own.
    """
    k = vectors.check_k(k)
    ship(rows.sparkSession)
    base = rows.select(F.col(by).alias("_g"), F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    cells = base.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / QUERY_CELL).alias("_n"))
    dealt = base.join(cells.withColumnRenamed("_g", "_g2"), F.col("_g").eqNullSafe(F.col("_g2"))).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n"))).withColumn("_other", F.explode(F.expr("sequence(0L, _n - 1)")))
    left = dealt.select("_g", F.col("_own").alias("_r"), F.col("_other").alias("_q"), "id", "v")
    right = dealt.select(F.col("_g").alias("_g"), F.col("_other").alias("_r"), F.col("_own").alias("_q"), F.col("id").alias("qid"), F.col("v").alias("embedding"))
    found = _grid(left, right, k + 1, lambda q: q, _inner, ["_g", "_r", "_q"], ["id", "v"])  # one more, as a row finds itself
    return _ranked(found.where("qid <> id"), k)


def codes(rows: DataFrame, g: quant.Geometry, key: str = "id", column: str = "embedding") -> DataFrame:
    """(id, scale, codes, planes) of validated vectors; planes are the codes' two highest bit planes, which the staged search reads alone."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                b = batch.slice(a, 4096)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, g.dimensions)
                scale, c = quant.quantize(x, g)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scale), pa.array(quant.pack(c, g), pa.binary()), pa.array(quant.planes_of(c, g), pa.binary())], ["id", "scale", "codes", "planes"])

    valid = vectors.validate(rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("embedding")), g.dimensions)
    return valid.mapInArrow(run, "id long, scale float, codes binary, planes binary")


def _rotated(g: quant.Geometry) -> Callable[[np.ndarray], np.ndarray]:
    def prepare(q: np.ndarray) -> np.ndarray:
        if q.shape[1] != g.dimensions:
            raise DimensionMismatch(f"queries have {q.shape[1]} dimensions, the index has {g.dimensions}")
        return quant.rotate(q, g)

    return prepare


def _full(g: quant.Geometry) -> Callable[[pa.RecordBatch, np.ndarray], np.ndarray]:
    def score(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
        return (g.levels()[quant.unpack(batch.column(2).to_pylist(), g)] @ q.T) * batch.column(1).to_numpy().astype(np.float64)[:, None]

    return score


def knn_codes(coded: DataFrame, queries: DataFrame, k: int, g: quant.Geometry, filter=None, staged: bool = False) -> DataFrame:
    """(qid, id, score, rank) under the compressed score.

    ``staged`` first takes STAGED_FACTOR * k rows a query, over all tasks, by the two highest bit planes, and scores these
    in full; the k-th score is then a floor, and all rows whose planes allow a score that high are scored in full too. So the
    result is the full scan's; at 2 bits these planes are the whole code, so there it is the full scan.
    """
    k = vectors.check_k(k)
    base = allowed(coded, filter)
    if not staged or g.bit_width == 2 or not k:
        return _batch(base.select("id", "scale", "codes"), queries, k, _rotated(g), _full(g))

    def coarse(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
        return (quant.coarse(batch.column(2).to_pylist(), g) @ q.T) * batch.column(1).to_numpy().astype(np.float64)[:, None]

    short = _batch(base.select("id", "scale", "planes"), queries, max(STAGED_FACTOR * k, STAGED_LEAST), _rotated(g), coarse).select("qid", "id")
    q = queries.select(F.col(queries.columns[0]).cast("long").alias("qid"), F.col(queries.columns[1]).alias("embedding"))
    if dict(q.dtypes)["embedding"] in ("string", "binary"):
        q = q.withColumn("embedding", vectors.f32_array("embedding"))
    rows = short.join(base.select("id", "scale", "codes"), "id").join(q, "qid").select("qid", "id", "scale", "codes", "embedding")

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                b = batch.slice(a, 4096)
                x = g.levels()[quant.unpack(b.column(3).to_pylist(), g)]
                s = np.einsum("ij,ij->i", x, quant.rotate(_matrix(b.column(4)), g)) * b.column(2).to_numpy().astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["qid", "id", "score"])

    floors = _ranked(rows.mapInArrow(refine, _HITS), k).where(F.col("rank") == k).groupBy("qid").agg(F.min("score").alias("_f"))
    # the floor goes with the query as its last coordinate, lowered beyond what single precision rounds
    lowered = F.coalesce(F.greatest(F.col("_f") - F.abs("_f") * 1e-6, F.lit(_NO_FLOOR)), F.lit(_NO_FLOOR)).cast("float")
    floored = materialize(q.join(floors, "qid", "left").select("qid", F.concat(F.col("embedding").cast("array<float>"), F.array(lowered)).alias("embedding")), "floors")
    return _batch(base.select("id", "scale", "planes", "codes"), floored, k, _floored(g), _above(g))


_NO_FLOOR = -9e15


def _floored(g: quant.Geometry) -> Callable[[np.ndarray], _Queries]:
    return lambda q: _Queries(_rotated(g)(q[:, :-1]), q[:, -1])


class _Queries:
    """Rotated queries with their floors."""

    def __init__(self, q: np.ndarray, floor: np.ndarray):
        self.q, self.floor, self.norm = q, floor, np.sqrt((q * q).sum(axis=1))

    def __len__(self) -> int:
        return len(self.q)


def _above(g: quant.Geometry) -> Callable[[pa.RecordBatch, _Queries], np.ndarray]:
    """Full scores of the rows that may reach a query's floor, minus infinity elsewhere.

    A row's score is off its planes' by at most its scale times the norms of the query and of the widest rest the planes leave.
    Matrix products round by their shape, so what reaches the floor is summed pair by pair: equal rows have equal scores.
    """

    def score(batch: pa.RecordBatch, of: _Queries) -> np.ndarray:
        scale = batch.column(1).to_numpy().astype(np.float64)
        near, rest = quant.coarse_with_rest(batch.column(2).to_pylist(), g)
        s = near @ of.q.T
        s += rest[:, None] * (of.norm * (1 + 1e-6))
        s *= scale[:, None]
        may = s >= of.floor
        s.fill(-np.inf)
        rows = np.flatnonzero(may.any(axis=1))
        x, scale = g.levels()[quant.unpack(batch.column(3).take(pa.array(rows)).to_pylist(), g)], scale[rows]
        full = (x @ of.q.T + 1e-12 * of.norm) * scale[:, None]
        i, j = np.nonzero(may[rows] & (full >= of.floor))
        for k in range(0, len(i), 65_536):
            a, b = i[k : k + 65_536], j[k : k + 65_536]
            s[rows[a], b] = np.einsum("ij,ij->i", x[a], of.q[b]) * scale[a]
        return s

    return score


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(queries, recall, top1): mean share of the exact top k that was found, and agreement on the first."""
    a = exact.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("id").alias("e"), F.min_by("id", "rank").alias("e1"))
    b = found.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("id").alias("f"), F.min_by("id", "rank").alias("f1"))
    both = a.join(b, "qid", "left")
    share = F.size(F.array_intersect("e", F.coalesce("f", F.array().cast("array<long>")))) / F.size("e")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.avg(share).alias("recall"), F.avg(F.coalesce((F.col("e1") == F.col("f1")).cast("double"), F.lit(0.0))).alias("top1"))


def evaluation(found: DataFrame, exact: DataFrame, k: int, seconds: list[float]) -> DataFrame:
    """:func:`recall` with the queries a second and the 50th, 95th and 99th percentile of their seconds, measured by the caller."""
    spark = found.sparkSession
    times = spark.createDataFrame([(float(s),) for s in seconds], "s double")
    speed = times.agg((F.count(F.lit(1)) / F.sum("s")).alias("qps"), *[F.percentile("s", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)])
    return recall(found, exact, k).crossJoin(speed).withColumn("quality_adjusted_qps", F.col("qps") * F.col("recall"))  # one row each
