"""The engine's registered queries over the ``embeddings``, ``documents`` and ``labels`` tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.functions import payload, quant, vectors
from stratavec.operators import search
from stratavec.session import scratch_path, ship
from stratavec.sources.index import VectorIndex, must_compact

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def one(spark: SparkSession, sf_dir: str, id: int = 0) -> DataFrame:
    """The query vector, as a scalar subquery would give it."""
    return rows(spark, sf_dir).where(F.col("id") == id).select("embedding")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's own query table: every vector that also names a toxic-labelled document."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return rows(spark, sf_dir).join(toxic, "id", "left_semi").select(F.col("id").alias("qid"), "embedding")


def _r(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_S = f"WITH {_E}, s AS (SELECT e.id, list_inner_product(e.v, q.v) AS score FROM e, (SELECT v FROM e WHERE id = 0) q{{where}})"
_HIT = " SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {n} OFFSET {o}"


def _single(where: str = "", n: int = 10, o: int = 0) -> str:
    return _S.format(where=where) + _HIT.format(n=n, o=o)


@_query(_single())
def knn_exact_top10(spark, sf_dir):
    return _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir), k=10))


@_query(_single(n=10, o=5))
def knn_exact_offset(spark, sf_dir):
    return _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir), limit=10, offset=5))


@_query(_single(n=1_000_000_000))
def knn_k_exceeds_rows(spark, sf_dir):
    return _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir), k=1_000_000_000))


@_query(_single(n=1_000_000_000, o=0))
def knn_negative_limit(spark, sf_dir):
    return _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir), limit=-1, offset=-3))


@_query(_single(" WHERE label = 3"))
def knn_filtered_label(spark, sf_dir):
    r = rows(spark, sf_dir)
    return _r(search.knn(r, one(spark, sf_dir), k=10, filter=r.where("label = 3").select("id")))


@_query(_single(" WHERE id IN (1, 5, 9, 200, 301)"))
def knn_filtered_id_list(spark, sf_dir):
    return _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir), k=10, filter=[1, 5, None, -1, 9, 200, 301, 99_999_999]))


@_query(_single(" WHERE false"))
def knn_filtered_empty(spark, sf_dir):
    return _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir), k=10, filter=[]))


@_query(_single(" WHERE id = 7"))
def knn_single_id(spark, sf_dir):
    return _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir), k=10, filter=[7]))


@_query(f"SELECT id, score FROM ({_single(n=50)}) WHERE score < 0.3 AND id % 2 = 0")
def knn_postfilter_score(spark, sf_dir):
    return _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir), k=50)).where("score < 0.3 and id % 2 = 0")


@_query(f"SELECT h.id, h.score, d.lang, d.n_chars FROM ({_single(n=25)}) h JOIN documents d ON d.doc_id = h.id")
def knn_join_content(spark, sf_dir):
    hits = _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir), k=25))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(F.broadcast(hits), docs.doc_id == hits.id).select("id", "score", "lang", "n_chars")  # 25 rows


@_query(_single(n=10).replace("id = 0", "id = 42"))
def knn_scalar_subquery_query(spark, sf_dir):
    return _r(search.knn(rows(spark, sf_dir), one(spark, sf_dir, 42), k=10))


_B = f"WITH {_E}, q AS (SELECT id AS qid, v AS w FROM e WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)), s AS (SELECT qid, id, list_inner_product(v, w) AS score FROM e, q{{where}}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM s) SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"


@_query(_B.format(where=""))
def knn_batch_k10(spark, sf_dir):
    return _r(search.knn_batch(rows(spark, sf_dir), batch(spark, sf_dir), 10))


@_query(_B.format(where=" WHERE label < 5"))
def knn_batch_filtered(spark, sf_dir):
    r = rows(spark, sf_dir)
    return _r(search.knn_batch(r, batch(spark, sf_dir), 10, filter=r.where("label < 5").select("id")))


@_query("SELECT vec_id AS id FROM embeddings")
def ids_scan(spark, sf_dir):
    return _index(spark, sf_dir).ids()


@_query("SELECT count(*)::BIGINT AS n FROM embeddings")
def ids_count(spark, sf_dir):
    return spark.createDataFrame([(_index(spark, sf_dir).count(),)], "n long")


@_query("SELECT vec_id AS id FROM embeddings WHERE vec_id = 17")
def ids_point_lookup(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.lookup(17).unionByName(index.lookup(-1)).unionByName(index.lookup(1 << 40))


@_query("SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def ids_semi(spark, sf_dir):
    return search.allowed(rows(spark, sf_dir).select("id"), table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id"))


@_query("SELECT vec_id AS id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)")
def ids_anti(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return rows(spark, sf_dir).select("id").join(labels, "id", "left_anti")


@_query("SELECT vec_id AS id, 'delete' AS op FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'insert' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def reconcile_plan(spark, sf_dir):
    """What reconciling the index with the labelled documents does, as its commit recorded it."""
    index = _index(spark, sf_dir)
    axis = F.array(*[F.lit(float(i == 0)).cast("float") for i in range(64)])
    index.reconcile(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), axis.alias("embedding")))
    return spark.read.parquet(f"{index.path}/delta/gen=2").select("id", "op")


@_query(f"WITH {_E} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM e")
def vector_norms(spark, sf_dir):
    return rows(spark, sf_dir).select("id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@_query("SELECT label, count(*)::BIGINT AS n, count(*)::BIGINT AS valid FROM embeddings GROUP BY label")
def vector_validate(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(vectors.is_valid(F.col("embedding"), 64).cast("long")).alias("valid"))


@_query("SELECT vec_id AS id, (4 * len(embedding))::INTEGER AS bytes, true AS same FROM embeddings")
def f32_roundtrip(spark, sf_dir):
    ship(spark)
    blobs = rows(spark, sf_dir).withColumn("blob", vectors.f32("embedding"))
    return blobs.select("id", F.octet_length("blob").alias("bytes"), (vectors.f32_array("blob") == F.col("embedding")).alias("same"))


@_query("SELECT vec_id AS id, len(embedding)::INTEGER AS dims, true AS same FROM embeddings")
def json_roundtrip(spark, sf_dir):
    ship(spark)
    back = rows(spark, sf_dir).withColumn("back", vectors.f32_array(F.to_json("embedding")))
    return back.select("id", F.size("back").alias("dims"), (F.col("back") == F.col("embedding")).alias("same"))


def _rotation_sql(g: quant.Geometry) -> str:
    """The rotation's rows as a literal: exact multiples of 1/d."""
    r = quant.rotate(np.eye(g.padded), g).T
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in r) + "]::DOUBLE[][]"


def _codes_sql(g: quant.Geometry) -> str:
    bounds = ", ".join(repr(float(x)) for x in g.bounds())
    levels = ", ".join(repr(float(x)) for x in g.levels())
    return f"""WITH m AS MATERIALIZED (SELECT {_rotation_sql(g)} AS r, [{bounds}]::DOUBLE[] AS b, [{levels}]::DOUBLE[] AS l),
{_E}, u AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM e),
y AS MATERIALIZED (SELECT id, n, list_transform(m.r, lambda w: list_inner_product(list_transform(v, lambda x: x / n), w)) AS y, m.b AS b, m.l AS l FROM u, m),
c AS MATERIALIZED (SELECT id, n, y, l, list_transform(y, lambda x: len(list_filter(b, lambda t: t < x))) AS c FROM y),
d AS MATERIALIZED (SELECT id, c, y, list_transform(c, lambda k: l[k + 1]) AS x, (n / list_inner_product(y, list_transform(c, lambda k: l[k + 1])))::FLOAT::DOUBLE AS scale, n FROM c)"""


def _coded(spark, sf_dir, bits: int) -> tuple[DataFrame, quant.Geometry]:
    g = quant.Geometry(64, bits)
    return search.codes(rows(spark, sf_dir), g), g


def _codes_query(bits: int) -> None:
    g = quant.Geometry(64, bits)

    def f(spark, sf_dir):
        coded, g = _coded(spark, sf_dir, bits)
        ship(spark)
        pick = F.pandas_udf(lambda s: s.map(lambda b: int(quant.unpack([b], g).astype(int).sum())), "long")
        return coded.select("id", pick("codes").alias("code_sum"), F.octet_length("codes").alias("bytes"), F.round(F.col("scale").cast("double"), 5).alias("scale"))

    f.__name__ = f"quant_codes_{bits}bit"
    _query(_codes_sql(g) + f" SELECT id, list_sum(c)::BIGINT AS code_sum, {g.code_bytes}::INTEGER AS bytes, round(scale, 5) AS scale FROM d")(f)

    def knn(spark, sf_dir):
        coded, g = _coded(spark, sf_dir, bits)
        q = batch(spark, sf_dir)
        return _r(search.knn_codes(coded, q, 10, g))

    knn.__name__ = f"knn_quant_{bits}bit"
    _query(_codes_sql(g) + """, q AS (SELECT id AS qid, list_transform(y, lambda x: x * n) AS w FROM d WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
s AS (SELECT qid, id, list_inner_product(x, w) * scale AS score FROM d, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM s) SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")(knn)


for _bits in (2, 3, 4):
    _codes_query(_bits)


def _recall(k: int) -> None:
    def f(spark, sf_dir):
        q, out = batch(spark, sf_dir), None
        exact = search.knn_batch(rows(spark, sf_dir), q, k)
        for bits in (2, 3, 4):
            coded, g = _coded(spark, sf_dir, bits)
            part = search.recall(search.knn_codes(coded, q, k, g), exact, k).withColumn("bits", F.lit(bits))
            out = part if out is None else out.unionByName(part)
        return out.select("bits", "queries", F.round("recall", 9).alias("recall"), F.round("top1", 9).alias("top1"))

    def sql(bits: int) -> str:
        return f"""SELECT {bits} AS bits, count(*)::BIGINT AS queries, round(avg(share), 9) AS recall, round(avg(top1), 9) AS top1 FROM ({_codes_sql(quant.Geometry(64, bits))},
q AS (SELECT e.id AS qid, e.v AS v, list_transform(d.y, lambda x: x * d.n) AS w FROM e JOIN d ON d.id = e.id WHERE e.id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
f AS (SELECT qid, d.id, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(x, w) * scale DESC, d.id) AS rank FROM d, q),
t AS (SELECT qid, e.id, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(e.v, q.v) DESC, e.id) AS rank FROM e, q)
SELECT t.qid, count(f.id) / count(*) AS share, max(CASE WHEN t.rank = 1 AND f.rank = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS top1
FROM t LEFT JOIN f ON f.qid = t.qid AND f.id = t.id AND f.rank <= {k} WHERE t.rank <= {k} GROUP BY t.qid)"""

    f.__name__ = f"recall_at_{k}"
    _query(" UNION ALL ".join(sql(b) for b in (2, 3, 4)))(f)


_recall(10)
_recall(40)


@_query(SQL["knn_quant_4bit"])
def knn_staged_4bit(spark, sf_dir):
    coded, g = _coded(spark, sf_dir, 4)
    return _r(search.knn_codes(coded, batch(spark, sf_dir), 10, g, staged=True))


@_query("SELECT label, count(*)::BIGINT AS rows, 64 AS dimensions, 4 AS bit_width FROM embeddings GROUP BY label")
def payload_build_info(spark, sf_dir):
    built = _payloads(spark, sf_dir)
    return built.select("label", payload.length("payload").alias("rows"), payload.dimensions("payload").alias("dimensions"), payload.bit_width("payload").alias("bit_width"))


def _payloads(spark, sf_dir) -> DataFrame:
    ship(spark)
    return payload.build_groups(rows(spark, sf_dir), quant.Geometry(64, 4), "label")


@_query("SELECT label, (count(*) + 1)::BIGINT AS added, count(*)::BIGINT AS back FROM embeddings GROUP BY label")
def payload_add_remove(spark, sf_dir):
    vec = F.to_json(F.array(*[F.lit(1.0)] + [F.lit(0.0)] * 63))
    more = _payloads(spark, sf_dir).withColumn("more", payload.add("payload", F.lit(10_000_000), vec))
    return more.select("label", payload.length("more").alias("added"), payload.length(payload.drop("more", F.lit(10_000_000))).alias("back"))


@_query(_codes_sql(quant.Geometry(64, 4)) + """, q AS (SELECT list_transform(y, lambda x: x * n) AS w FROM d WHERE id = 0),
s AS (SELECT label, d.id, list_inner_product(x, w) * scale AS score FROM d JOIN e ON e.id = d.id, q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM s) SELECT label, id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def payload_knn(spark, sf_dir):
    payload.register(spark)
    q = one(spark, sf_dir).select(F.to_json("embedding").alias("q"))
    _payloads(spark, sf_dir).crossJoin(F.broadcast(q)).createOrReplaceTempView("_stratavec_payloads")
    return spark.sql("SELECT label, id, round(score, 6) AS score FROM _stratavec_payloads, LATERAL stratavec_knn(payload, q, 5)")


def _index(spark, sf_dir, upto: str | None = None) -> VectorIndex:
    index = VectorIndex.create(spark, scratch_path(spark, "index"), dimensions=64, bit_width=4)
    index.insert(rows(spark, sf_dir).select("id", "embedding") if upto is None else rows(spark, sf_dir).where(upto).select("id", "embedding"))
    return index


@_query("SELECT vec_id AS id FROM embeddings WHERE label <> 2 UNION SELECT vec_id + 1000000 FROM embeddings WHERE label = 1")
def txn_insert_replace_delete_merge(spark, sf_dir):
    r = rows(spark, sf_dir)
    index = _index(spark, sf_dir)
    with index.transaction() as t:
        t.delete(r.where("label = 2").select("id"))
        t.insert(r.where("label = 3").select("id", "embedding"), "replace")
        t.insert(r.where("label = 1").select((F.col("id") + 1_000_000).alias("id"), "embedding"))
    return index.ids()


@_query("SELECT count(*)::BIGINT AS inserted FROM embeddings WHERE label <> 4")
def txn_ignore(spark, sf_dir):
    index = _index(spark, sf_dir, "label = 4")
    n = index.insert(rows(spark, sf_dir).select("id", "embedding"), "ignore")
    return spark.range(1).select(F.lit(n).cast("long").alias("inserted"))


@_query("SELECT vec_id AS id FROM embeddings WHERE vec_id >= 100 OR vec_id < 40 ")
def txn_fail_prefix(spark, sf_dir):
    from stratavec.errors import DuplicateId

    index = _index(spark, sf_dir, "id >= 100")
    more = rows(spark, sf_dir).where("id < 40").unionByName(rows(spark, sf_dir).where("id = 100")).unionByName(rows(spark, sf_dir).where("id between 40 and 60"))
    order = F.when(F.col("id") < 40, F.col("id")).when(F.col("id") == 100, 40).otherwise(F.col("id") + 1)
    try:
        index.insert(more.select("id", "embedding", order.cast("long").alias("seq")), "fail")
    except DuplicateId:
        pass
    return index.refresh().ids()


@_query("SELECT label, count(*) FILTER (vec_id % 3 <> 0)::BIGINT AS net FROM embeddings GROUP BY label")
def delta_net_rows(spark, sf_dir):
    """Rows a commit's log adds: an insert counts 1 unless it replaces a row, a delete -1."""
    r = rows(spark, sf_dir)
    index = _index(spark, sf_dir, "false")
    with index.transaction() as t:
        t.insert(r.select("id", "embedding"))
        t.insert(r.where("id % 5 = 0").select("id", "embedding"), "replace")
        t.delete(r.where("id % 3 = 0").select("id"))
    log = spark.read.parquet(f"{index.path}/delta/gen={index.manifest.generation}")
    before = F.lag("op").over(Window.partitionBy("id").orderBy("seq"))
    net = log.withColumn("n", F.when(F.col("op") == "delete", -1).when(F.coalesce(before, F.lit("delete")) == "insert", 0).otherwise(1))
    return net.join(r.select("id", "label"), "id").groupBy("label").agg(F.sum("n").alias("net"))


_POLICY = [(1000, 10, 1, 10), (2 << 20, 1 << 20, 5, 1_000_000), (64 << 20, 16 << 20, 5, 1_000_000), (2 << 20, 2 << 20, 5, 1_000_000), (64 << 20, 10, 9_999, 20_000), (64 << 20, 10, 10_000, 20_000), (64 << 20, 10, 10_000, 80_000)]


@_query(f"SELECT base, delta, ops, n, base < 1048576 OR delta >= least(greatest(base // 4, 16777216), greatest(base, 1048576)) OR ops >= greatest(n // 4, 10000) AS compact FROM (VALUES {', '.join(map(str, _POLICY))}) t(base, delta, ops, n)")
def compaction_policy(spark, sf_dir):
    return spark.createDataFrame([(*p, must_compact(*p)) for p in _POLICY], "base int, delta int, ops int, n int, compact boolean")


@_query("SELECT count(*)::BIGINT AS count, 4 AS bit_width, 64 AS dimensions, 1::BIGINT AS generation, 0::BIGINT AS delta_operations FROM embeddings")
def index_info(spark, sf_dir):
    i = _index(spark, sf_dir).info()
    return spark.createDataFrame([(i["count"], i["bit_width"], i["dimensions"], i["generation"], i["delta_operations"])], "count long, bit_width int, dimensions int, generation long, delta_operations long")


@_query("SELECT 'ok' AS report")
def integrity_report(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _index(spark, sf_dir).check()], "report string")


@_query("SELECT (SELECT count(*) FROM embeddings)::BIGINT AS old_count, (SELECT count(*) FROM embeddings WHERE label <> 0)::BIGINT AS new_count")
def snapshot_read(spark, sf_dir):
    index = _index(spark, sf_dir)
    reader = VectorIndex.open(spark, index.path)
    index.delete(rows(spark, sf_dir).where("label = 0").select("id"))
    return spark.range(1).select(F.lit(reader.ids().count()).cast("long").alias("old_count"), F.lit(index.ids().count()).cast("long").alias("new_count"))


#: Copies of the vectors that make a base large enough to keep deltas; a copy's ids are shifted.
COPIES, SHIFT = 60, 1_000_000


def _large(spark, sf_dir) -> VectorIndex:
    index = VectorIndex.create(spark, scratch_path(spark, "index"), dimensions=64, bit_width=4)
    many = rows(spark, sf_dir).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    index.insert(many.select((F.col("id") + F.col("c") * SHIFT).alias("id"), "embedding"))
    return index


def _edited(spark, sf_dir) -> VectorIndex:
    """Three commits on a large base, all kept as deltas: new rows, replaced vectors (the negated ones), deletions."""
    index, r = _large(spark, sf_dir), rows(spark, sf_dir)
    index.insert(r.where("label = 1").select((F.col("id") + COPIES * SHIFT).alias("id"), "embedding"))
    index.insert(r.where("label = 3").select("id", F.transform("embedding", lambda x: -x).alias("embedding")), "replace")
    index.delete(r.where("label = 2").select("id"))
    return index


@_query(_codes_sql(quant.Geometry(64, 4)) + f""", l AS (SELECT d.id, label, list_sum(c)::BIGINT AS s, round(scale, 5) AS scale FROM d JOIN e ON e.id = d.id)
SELECT id, CASE WHEN label = 3 THEN 960 - s ELSE s END AS code_sum, scale FROM l WHERE label <> 2 UNION ALL SELECT id + {SHIFT}, s, scale FROM l UNION ALL SELECT id + {COPIES * SHIFT}, s, scale FROM l WHERE label = 1""")
def delta_merge_codes(spark, sf_dir):
    """Live codes of the first two copies and the added rows, merged from a base and three deltas."""
    index = _edited(spark, sf_dir)
    if len(index.manifest.deltas) != 3:
        raise ValueError("the commits should be kept as deltas")
    ship(spark)
    g = index.geometry
    pick = F.pandas_udf(lambda s: s.map(lambda b: int(quant.unpack([b], g).astype(int).sum())), "long")
    live = index.rows().where(f"id < {2 * SHIFT} or id >= {COPIES * SHIFT}")
    return live.select("id", pick("codes").alias("code_sum"), F.round(F.col("scale").cast("double"), 5).alias("scale"))


_LIVE = f"SELECT count(*) * {COPIES} + count(*) FILTER (label = 1) - count(*) FILTER (label = 2) AS n, count(*) FILTER (label IN (1, 2, 3)) AS ops, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 3) AS r, count(*) FILTER (label = 2) AS d, count(*) * {COPIES} AS base FROM embeddings"


@_query(f"SELECT base::BIGINT AS before, n::BIGINT AS after, ops::BIGINT AS operations, 3::BIGINT AS deltas, (3 * 16 + 9 * ops + 256 * (a + r))::BIGINT AS delta_bytes, 'ok' AS report FROM ({_LIVE})")
def delta_catch_up(spark, sf_dir):
    """A reader opened before three commits, what it sees, and after catching up."""
    index, r = _large(spark, sf_dir), rows(spark, sf_dir)
    reader = VectorIndex.open(spark, index.path)
    before = reader.ids().count()
    index.insert(r.where("label = 1").select((F.col("id") + COPIES * SHIFT).alias("id"), "embedding"))
    reader.refresh().ids().count()
    index.insert(r.where("label = 3").select("id", F.transform("embedding", lambda x: -x).alias("embedding")), "replace")
    index.delete(r.where("label = 2").select("id"))
    after, m = reader.refresh().ids().count(), reader.manifest
    return spark.createDataFrame([(before, after, m.delta_operations, len(m.deltas), m.delta_bytes, reader.check()[0])], "before long, after long, operations long, deltas long, delta_bytes long, report string")


@_query(f"SELECT (n * {COPIES - 25})::BIGINT AS count, 0::BIGINT AS deltas, 2::BIGINT AS base, 'ok' AS report FROM (SELECT count(*) AS n FROM embeddings)")
def delta_compaction(spark, sf_dir):
    """Deleting over a quarter of the rows writes a new base."""
    index = _large(spark, sf_dir)
    index.delete(index.ids().where(f"id < {25 * SHIFT}"))
    m = index.manifest
    return spark.createDataFrame([(m.row_count, len(m.deltas), m.base, index.check()[0])], "count long, deltas long, base long, report string")


@_query(f"SELECT 1::BIGINT AS gen, 'insert' AS op, (count(*) * {COPIES})::BIGINT AS n FROM embeddings UNION ALL SELECT 2, 'insert', count(*) FROM embeddings WHERE label = 1 UNION ALL SELECT 3, 'insert', count(*) FROM embeddings WHERE label = 3 UNION ALL SELECT 4, 'delete', count(*) FROM embeddings WHERE label = 2")
def change_feed_operations(spark, sf_dir):
    """Every commit's operations, read as a stream; the first wrote a new base."""
    from stratavec.streaming.sink import change_feed

    index, out = _edited(spark, sf_dir), scratch_path(spark, "feed")
    feed = change_feed(spark, index.path).select("gen", "op", "id")
    feed.writeStream.format("parquet").option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("gen", "op").agg(F.count(F.lit(1)).alias("n"))


@_query(_codes_sql(quant.Geometry(64, 4)) + """, q AS (SELECT list_transform(y, lambda x: x * n) AS w FROM d WHERE id = 0)
SELECT id, round(list_inner_product(x, w) * scale, 6) AS score FROM d, q WHERE id IN (SELECT id FROM e WHERE label = 3) ORDER BY list_inner_product(x, w) * scale DESC, id LIMIT 7 OFFSET 2""")
def sql_match(spark, sf_dir):
    """The search in SQL: allowlist, order, limit and offset."""
    _index(spark, sf_dir).register("stratavec_ix")
    rows(spark, sf_dir).createOrReplaceTempView("stratavec_rows")
    return spark.sql("""SELECT id, round(score, 6) AS score FROM (SELECT id, stratavec_ix_score(scale, codes, (SELECT to_json(embedding) FROM stratavec_rows WHERE id = 0)) AS score FROM stratavec_ix
        WHERE id IN (SELECT id FROM stratavec_rows WHERE label = 3) ORDER BY score DESC, id LIMIT 7 OFFSET 2)""")


@_query("SELECT 1::BIGINT AS generation, count(*)::BIGINT AS count, 4::BIGINT AS bit_width, 64::BIGINT AS dimensions, (44 * count(*))::BIGINT AS serialized_bytes, (44 * count(*))::BIGINT AS base_bytes, 0::BIGINT AS delta_bytes, 0::BIGINT AS delta_operations, 1::BIGINT AS format_version, 2::BIGINT AS format_revision FROM embeddings")
def sql_info(spark, sf_dir):
    _index(spark, sf_dir).register("stratavec_facts")
    return spark.sql("SELECT * FROM stratavec_facts_info").drop("table")


@_query("SELECT e.vec_id AS id, l.quality, l.toxic FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id JOIN documents d ON d.doc_id = e.vec_id WHERE d.source LIKE 'src1%'")
def content_pattern_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("source").like("src1%")).select("doc_id")
    return rows(spark, sf_dir).select("id").join(docs, F.col("id") == docs.doc_id, "left_semi").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), "id").select("id", "quality", "toxic")


@_query(f"WITH {_E}, p AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS s FROM e a, e b WHERE a.label = b.label AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p) SELECT a, b, round(s, 6) AS score FROM r WHERE k = 1")
def nearest_in_label(spark, sf_dir):
    """Each vector's nearest other vector of its label."""
    best = search.knn_within(rows(spark, sf_dir), "label", 1)
    return best.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.round("score", 6).alias("score"))
