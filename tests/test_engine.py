import numpy as np
import pytest

from stratavec import errors
from stratavec.functions import payload, quant, vectors
from stratavec.operators import search
from stratavec.sources.index import OPS, VectorIndex, delta_size, must_compact


def axis(*k):
    return [float(k.count(i)) for i in range(8)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(rows)], "id long, embedding array<float>, seq long")


@pytest.fixture
def index(spark, tmp_path):
    ix = VectorIndex.create(spark, str(tmp_path / "ix"), dimensions=8, bit_width=4)
    ix.insert(frame(spark, [(1, axis(0)), (2, axis(1)), (3, [0.9, 0.1] + [0.0] * 6)]))
    return ix


def ids(ix):
    return sorted(r.id for r in ix.ids().collect())


@pytest.mark.parametrize("bad", [b"abc", "[1,null]", '["1"]', "[1e39]", "[NaN]", "{}", "x", 5, None, [1.0, None], "[1e17]", "[true]"])
def test_invalid_vectors_are_refused(bad):
    with pytest.raises(errors.VectorFormatError):
        vectors.parse(bad)


def test_encoding_is_little_endian_float32():
    assert vectors.encode("[1,2,3]") == np.array([1, 2, 3], "<f4").tobytes()
    assert vectors.parse(vectors.encode([0.5, -2])).tolist() == [0.5, -2.0]


@pytest.mark.parametrize("dims,bits", [(7, 4), (8, 5), (0, 4), (16392, 2)])
def test_geometry_is_checked(dims, bits):
    with pytest.raises(ValueError):
        quant.Geometry(dims, bits)


def test_quantizer_round_trip_and_recall():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.argsort(-(x @ x[:50].T), axis=0)[:10]
    for bits, floor in ((4, 0.85), (3, 0.7), (2, 0.5)):
        g = quant.Geometry(64, bits)
        scale, codes = quant.quantize(x, g)
        assert (quant.unpack(quant.pack(codes, g), g) == codes).all()
        got = np.argsort(-quant.scores(scale, codes, x[:50], g), axis=0)[:10]
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.T, got.T)]) > floor
    assert quant.quantize(np.zeros((1, 64)), quant.Geometry(64, 4))[0][0] == 0


def test_effective_k():
    assert search.effective_k(k=5, limit=3, offset=4) == (5, 4)
    assert search.effective_k(limit=-1, offset=-2, rows=7) == (7, 0)
    for bad in ({}, {"limit": 3, "order": None}):
        with pytest.raises(errors.InvalidSearch):
            search.effective_k(**bad)
    with pytest.raises(ValueError):
        search.effective_k(k=-1)


def test_filter_applies_before_the_top_k(spark):
    rows = frame(spark, [(i, [1.0 - i / 100] + [0.0] * 7) for i in range(50)])
    got = search.knn(rows, axis(0), k=3, filter=[40, 45, 44, None, -1, 999])
    assert [r.id for r in got.collect()] == [40, 44, 45]
    with pytest.raises(TypeError):
        search.knn(rows, axis(0), k=3, filter=["a"])
    plan = search.knn(rows, axis(0), k=3, filter=rows.select("id").where("id > 40"))._jdf.queryExecution().toString()
    assert "LeftSemi" in plan


def test_search_paging_and_batch(spark, index):
    assert [r.id for r in index.search(axis(0), limit=2).collect()] == [1, 3]
    assert [r.id for r in index.search(axis(0), limit=1, offset=1).collect()] == [3]
    q = spark.createDataFrame([(7, axis(0)), (8, axis(1))], "qid long, embedding array<float>")
    got = {(r.qid, r["rank"]): r.id for r in index.search_batch(q, 1).collect()}
    assert got == {(7, 1): 1, (8, 1): 2}


def test_transactions_and_savepoints(spark, index):
    with index.transaction() as t:
        t.insert(frame(spark, [(4, axis(2))]))
        t.savepoint("a")
        t.insert(frame(spark, [(5, axis(3))]))
        t.rollback_to("a")
    assert ids(index) == [1, 2, 3, 4] and index.manifest.generation == 2
    t = index.transaction()
    t.delete([1])
    assert t.count() == 3
    with pytest.raises(errors.TransactionError):
        index.transaction()
    with pytest.raises(errors.TransactionError):
        t.release("none")
    t.rollback()
    assert ids(index) == [1, 2, 3, 4] and index.check() == ["ok"]


def test_conflict_policies(spark, index):
    with pytest.raises(errors.DuplicateId):
        index.insert(frame(spark, [(7, axis(2)), (1, axis(2))]))
    assert ids(index) == [1, 2, 3]
    assert index.insert(frame(spark, [(1, axis(5)), (9, axis(5)), (9, axis(6))]), "ignore") == 1
    assert index.insert(frame(spark, [(1, axis(5)), (1, axis(1))]), "replace") == 1
    assert index.search(axis(1), k=2).count() == 2
    with pytest.raises(errors.DuplicateId):
        index.insert(frame(spark, [(20, axis(2)), (1, axis(0)), (21, axis(0))]), "fail")
    assert ids(index.refresh()) == [1, 2, 3, 9, 20]
    assert index.delete([2, 99]) == 1
    with pytest.raises(NotImplementedError):
        index.update()
    assert index.reconcile(frame(spark, [(1, axis(0)), (50, axis(3))])) == (3, 1)
    assert ids(index) == [1, 50]


def test_deltas_snapshots_and_corruption(spark, index, monkeypatch):
    monkeypatch.setattr("stratavec.sources.index.must_compact", lambda *a: False)
    reader = VectorIndex.open(spark, index.path)
    index.insert(frame(spark, [(30, axis(4))]))
    index.delete([1])
    assert index.manifest.deltas == [2, 3] and index.manifest.delta_operations == 2
    assert index.manifest.delta_bytes == delta_size(8, 1, 1) + delta_size(8, 1, 0)
    assert ids(reader) == [1, 2, 3] and ids(index) == [2, 3, 30]
    assert [r.id for r in index.search(axis(4), k=1).collect()] == [30]
    assert index.verified().count() == 3
    spark.createDataFrame([(0, "delete", 2, None, None, None, None)], OPS).write.mode("append").parquet(f"{index.path}/delta/gen=3")
    assert index.check() == ["delta 3 differs from its checksum"]
    with pytest.raises(errors.GeometryMismatch):
        VectorIndex.open(spark, index.path, dimensions=16)


def test_compaction_policy():
    assert must_compact(100, 1, 1, 10)
    assert not must_compact(64 << 20, 1 << 20, 9_999, 20_000)
    assert must_compact(64 << 20, 1 << 20, 10_000, 20_000)
    assert must_compact(64 << 20, 16 << 20, 1, 10**9)


def test_invalid_rows_raise(spark, index):
    for rows in ([(-1, axis(0))], [(5, [1.0])], [(5, None)], [(5, [float("nan")] + [0.0] * 7)]):
        with pytest.raises(Exception, match="id is negative|dimensions|required|finite"):
            index.insert(frame(spark, rows))
    assert ids(index.refresh()) == [1, 2, 3]


def test_payloads():
    g = quant.Geometry(8, 4)
    p = payload.Payload(g).add([1, 2, 3], [axis(0), axis(1), [0.9, 0.1] + [0.0] * 6])
    raw = p.to_bytes()
    assert [i for i, _ in payload.Payload.from_bytes(raw).search(axis(0), 2)] == [1, 3]
    assert len(p.remove(2).ids) == 2
    with pytest.raises(errors.DuplicateId):
        p.add([1], [axis(0)])
    with pytest.raises(errors.UnknownId):
        p.remove(9)
    for bad in (raw[:5], b"XXXX" + raw[4:], raw[:4] + b"\x09" + raw[5:], raw[:-1], raw[:-1] + b"\x01"):
        with pytest.raises(errors.PayloadFormatError):
            payload.Payload.from_bytes(bad)
    with pytest.raises(ValueError):
        payload.build([], [], [], [])


def test_sql_functions(spark):
    payload.register(spark)
    spark.createDataFrame([(1, "[1,0,0,0,0,0,0,0]"), (2, "[0,1,0,0,0,0,0,0]")], "id long, v string").createOrReplaceTempView("v")
    spark.sql("SELECT stratavec_build(8, 4, id, v) AS p FROM v").createOrReplaceTempView("b")
    assert spark.sql("SELECT stratavec_len(p) n, stratavec_bit_width(p) w FROM b").first() == (2, 4)
    assert [r.id for r in spark.sql("SELECT id FROM b, LATERAL stratavec_knn(p, '[0,1,0,0,0,0,0,0]', 1)").collect()] == [2]


def test_stream_batches_apply_once(spark, index):
    from stratavec.streaming.sink import apply_batch

    batch = spark.createDataFrame([(1, None), (70, axis(2))], "id long, embedding array<float>")
    assert apply_batch(index, batch, 0) and not apply_batch(index, batch, 0)
    assert ids(index) == [2, 3, 70]


def unit_rows(n=60, seed=3):
    x = np.random.default_rng(seed).standard_normal((n, 8))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_staged_search_ignores_how_rows_lie_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "STAGED_LEAST", 8)
    monkeypatch.setattr(search, "SCORES", 50)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    queries = table.where("id < 20").select("id", "embedding")
    g = quant.Geometry(64, 4)
    full = {(r.qid, r.id) for r in search.knn_codes(search.codes(table, g), queries, 10, g).collect()}
    found = []
    for parts, size in ((1, 10_000), (7, 100)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        coded = search.codes(table.repartition(parts), g)
        found.append({(r.qid, r.id, round(r.score, 9)) for r in search.knn_codes(coded, queries, 10, g, staged=True).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len({x[:2] for x in found[0]} & full) >= 0.99 * len(full)


def test_staged_search_is_the_full_scan(spark, monkeypatch):
    """A shortlist of one row a query, filled by copies and by rows whose two planes flatter them."""
    monkeypatch.setattr(search, "STAGED_LEAST", 1)
    monkeypatch.setattr(search, "STAGED_FACTOR", 1)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((300, 64)), np.repeat(rng.standard_normal((30, 64)), 20, axis=0)])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 64)))], "id long, embedding array<float>")
    for bits in (3, 4):
        g = quant.Geometry(64, bits)
        coded = search.codes(table, g)
        scale, codes = quant.quantize(x.astype(np.float32), g)
        for k, batch in ((7, queries), (1000, queries.where("id < 2")), (1, queries.where("id = 3"))):
            got = {(r.qid, r["rank"]): r.id for r in search.knn_codes(coded, batch, k, g, staged=True).collect()}
            for q in batch.collect():
                s = np.round(quant.scores(scale, codes, np.float32([q.embedding]), g)[:, 0], 9)
                want = np.lexsort((np.arange(len(x)), -s))[:k]
                assert [got[q.id, n + 1] for n in range(len(want))] == want.tolist()
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    again = {(r.qid, r.id) for r in search.knn_codes(coded, queries, 7, g, staged=True).collect()}
    assert again == {(r.qid, r.id) for r in search.knn_codes(coded, queries, 7, g).collect()}
    assert search.knn_codes(coded, queries.limit(0), 7, g, staged=True).count() == 0


def test_long_pages_are_cut_by_place(spark, monkeypatch):
    monkeypatch.setattr(search, "TOP", 10)
    table = frame(spark, [(i, [float(i % 7)] + [0.0] * 7) for i in range(60)]).repartition(5)
    want = [r for _, r in sorted((-(i % 7), i) for i in range(60))]
    for k, limit, offset in ((1_000_000_000, None, 0), (25, None, 3), (None, 40, 5), (None, -1, 50), (60, None, 60), (12, None, 0), (4, None, 2)):
        out = search.knn(table, axis(0), k=k, limit=limit, offset=offset)
        end = k if k is not None else limit + offset if limit >= 0 else 60
        assert [r.id for r in out.collect()] == want[offset:end]
    plan = search.knn(table, axis(0), k=1_000_000_000)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_large_query_tables_meet_rows_in_a_grid(spark, monkeypatch):
    x = unit_rows()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    small = sorted(map(tuple, search.knn_batch(table, table, 5).collect()))
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    monkeypatch.setattr(search, "ROW_CELL", 25)
    monkeypatch.setattr(search, "QUERY_CELL", 16)
    assert sorted(map(tuple, search.knn_batch(table, table, 5).collect())) == small and len(small) == 300
    within = {r.qid: r.id for r in search.knn_within(table.selectExpr("id % 2 as half", "id", "embedding"), "half", 1).collect()}
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -9)
    s[np.add.outer(np.arange(60), np.arange(60)) % 2 == 1] = -9
    assert within == dict(enumerate(s.argmax(axis=1).tolist()))


def test_equal_scores_stand_by_id(spark, monkeypatch):
    monkeypatch.setattr(search, "SCORES", 3)
    table = frame(spark, [(i, axis(i % 2)) for i in range(40)]).repartition(3)
    got = [(r.qid, r["rank"], r.id) for r in search.knn_batch(table, frame(spark, [(0, axis(0)), (1, axis(1))]).select("id", "embedding"), 3).orderBy("qid", "rank").collect()]
    assert got == [(0, 1, 0), (0, 2, 2), (0, 3, 4), (1, 1, 1), (1, 2, 3), (1, 3, 5)]
    assert search.knn_batch(table, table.limit(0).select("id", "embedding"), 3).count() == 0


def test_evaluation(spark):
    hits = spark.createDataFrame([(q, i, 1.0, i + 1) for q in range(2) for i in range(4)], "qid long, id long, score double, rank int")
    r = search.evaluation(hits.where("id < 2"), hits, 4, [0.1, 0.3]).first()
    assert (r.queries, r.recall, r.top1) == (2, 0.5, 1.0) and r.qps == pytest.approx(5) and r.p50 == pytest.approx(0.2) and r.quality_adjusted_qps == pytest.approx(2.5)


def test_rollback_policy_and_release(spark, index):
    t = index.transaction()
    t.insert(frame(spark, [(4, axis(3))]))
    with pytest.raises(errors.DuplicateId):
        t.insert(frame(spark, [(1, axis(3))]), "rollback")
    assert t.done and ids(index.refresh()) == [1, 2, 3]
    with index.transaction() as t:
        t.savepoint("a")
        t.insert(frame(spark, [(5, axis(3))]))
        t.savepoint("b")
        t.delete([1])
        t.release("b")
        with pytest.raises(errors.TransactionError):
            t.rollback_to("b")
        t.release("a")
        assert [r.id for r in t.search(axis(3), k=1).collect()] == [5]
    assert ids(index.refresh()) == [2, 3, 5]


def test_a_crashed_writers_lock_is_taken_over(spark, index, monkeypatch):
    dead = index.transaction()
    dead.insert(frame(spark, [(8, axis(3))]))
    with pytest.raises(errors.TransactionError):
        index.transaction()
    monkeypatch.setattr("stratavec.sources.index.LOCK_SECONDS", 0)
    with index.transaction() as t:
        t.insert(frame(spark, [(9, axis(3))]))
    assert ids(index.refresh()) == [1, 2, 3, 9]
    with pytest.raises(errors.TransactionError):
        dead.commit()
    assert ids(index.refresh()) == [1, 2, 3, 9] and index.check() == ["ok"]


def test_two_connections(spark, index):
    other = VectorIndex.open(spark, index.path)
    index.insert(frame(spark, [(4, axis(2))]))
    assert ids(other) == [1, 2, 3]
    other.insert(frame(spark, [(5, axis(3))]))  # a writer begins from the newest generation
    assert ids(other) == [1, 2, 3, 4, 5] == ids(index.refresh())
    moved = other.rename(other.path + "-moved")
    assert ids(moved) == [1, 2, 3, 4, 5] and moved.lookup(4).count() == 1 and moved.lookup(6).count() == 0
    moved.drop()
    with pytest.raises(ValueError):
        VectorIndex.open(spark, moved.path)


def _rewrite(spark, path, change):
    rows = spark.createDataFrame(spark.read.parquet(path).collect(), spark.read.parquet(path).schema)
    change(rows).write.mode("overwrite").parquet(path)


@pytest.mark.parametrize("what", ["scale", "codes", "planes", "missing", "twice", "negative", "files", "op", "delta", "gap", "count", "manifest"])
def test_damage_is_found(spark, index, monkeypatch, what):
    import json
    import pathlib
    import shutil

    from pyspark.sql import functions as F

    monkeypatch.setattr("stratavec.sources.index.must_compact", lambda *a: False)
    base = f"{index.path}/base/gen={index.manifest.base}"
    index.insert(frame(spark, [(30, axis(4))]))
    index.delete([1])
    delta, manifest = f"{index.path}/delta/gen=2", f"{index.path}/manifest.json"
    change = {
        "scale": lambda d: d.withColumn("scale", F.col("scale") * 2),
        "codes": lambda d: d.withColumn("codes", F.expr("substring(codes, 1, 3)")),
        "planes": lambda d: d.withColumn("planes", F.unhex(F.lit("00"))),
        "missing": lambda d: d.where("id <> 2"),
        "twice": lambda d: d.union(d.where("id = 2")),
        "negative": lambda d: d.withColumn("id", -F.col("id")),
    }
    if what in change:
        _rewrite(spark, base, change[what])
    elif what == "op":
        _rewrite(spark, delta, lambda d: d.withColumn("op", F.lit("update")))
    elif what in ("files", "delta"):
        shutil.rmtree(base if what == "files" else delta)
    else:
        m = json.load(open(manifest))
        m |= {"gap": {"deltas": [3]}, "count": {"row_count": 9}}.get(what, {})
        with open(manifest, "w") as f:
            f.write(json.dumps(m)[: -9 if what == "manifest" else None])
        pathlib.Path(index.path, ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(errors.CorruptIndex):
        VectorIndex.open(spark, index.path, verify=True)


def test_damage_under_a_right_checksum_is_found(spark, index):
    import json
    import pathlib

    from pyspark.sql import functions as F

    from stratavec.sources.index import _base_check

    base = f"{index.path}/base/gen={index.manifest.base}"
    _rewrite(spark, base, lambda d: d.withColumn("codes", F.expr("substring(codes, 1, 3)")))
    path = pathlib.Path(index.path, "manifest.json")
    m = json.loads(path.read_text())
    m["checks"]["base"] = _base_check(spark.read.parquet(base))
    path.write_text(json.dumps(m))
    pathlib.Path(index.path, ".manifest.json.crc").unlink(missing_ok=True)
    assert VectorIndex.open(spark, index.path).check() == ["a row of the base is damaged"]


def test_the_first_write_upgrades_revision_1(spark, index):
    import json
    import pathlib

    from stratavec.sources.index import _base_check

    base = f"{index.path}/base/gen={index.manifest.base}"
    _rewrite(spark, base, lambda d: d.drop("planes"))
    path = pathlib.Path(index.path, "manifest.json")
    m = json.loads(path.read_text()) | {"revision": 1}
    m["checks"]["base"] = _base_check(spark.read.parquet(base), 1)
    path.write_text(json.dumps(m))
    pathlib.Path(index.path, ".manifest.json.crc").unlink(missing_ok=True)
    old = VectorIndex.open(spark, index.path, verify=True)
    before = sorted(map(tuple, old.rows().collect()))
    assert [r.id for r in old.search(axis(1), k=1).collect()] == [2] and old.refresh().manifest.revision == 1
    t = old.transaction()
    t.insert(frame(spark, [(6, axis(5))]))
    t.rollback()
    assert old.refresh().manifest.revision == 1
    old.insert(frame(spark, [(6, axis(5))]))
    assert old.manifest.revision == 2 and old.check() == ["ok"]
    assert sorted(map(tuple, old.rows().where("id <> 6").collect())) == before and all(r[3] is not None for r in before)


def test_random_operations_against_a_model(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr("stratavec.sources.index.must_compact", lambda *a: r.random() < 0.4)
    r, x = random.Random(9), unit_rows(200, 8)
    index, model, n = VectorIndex.create(spark, str(tmp_path / "model"), dimensions=8, bit_width=4), {}, 0
    for _ in range(5):
        t, now, marks = index.transaction(), dict(model), []
        for _ in range(r.randint(1, 4)):
            kind = r.choice(["insert", "replace", "ignore", "delete", "savepoint", "back"])
            some = [r.randrange(12) for _ in range(r.randint(1, 4))]
            if kind == "delete":
                t.delete(some)
                now = {k: v for k, v in now.items() if k not in some}
            elif kind == "savepoint":
                t.savepoint("s")
                marks.append(dict(now))
            elif kind == "back" and marks:
                t.rollback_to("s")
                now = dict(marks[-1])
            elif kind in ("insert", "replace", "ignore"):
                rows = [(k, n + i) for i, k in enumerate(some)]
                n += len(some)
                df = frame(spark, [(k, x[v].tolist()) for k, v in rows])
                if kind == "insert":
                    if len(set(some)) < len(some) or set(some) & set(now):
                        with pytest.raises(errors.DuplicateId):
                            t.insert(df)
                    else:
                        t.insert(df)
                        now |= dict(rows)
                else:
                    t.insert(df, kind)
                    for k, v in rows:
                        if kind == "replace" or k not in now:
                            now[k] = v
        if r.random() < 0.25:
            t.rollback()
        else:
            t.commit()
            model = now
        index.refresh()
        want = search.codes(frame(spark, [(k, x[v].tolist()) for k, v in model.items()]).select("id", "embedding"), index.geometry) if model else index.rows().limit(0)
        assert sorted(map(tuple, index.rows().collect())) == sorted(map(tuple, want.collect()))
        assert index.count() == len(model) and index.check() == ["ok"]


def test_prepare_and_sql(spark, index):
    index.prepare()
    assert [r.id for r in index.search(axis(0), k=1).collect()] == [1]
    index.insert(frame(spark, [(4, axis(6))]))
    assert [r.id for r in index.search(axis(6), k=1).collect()] == [4]  # what was kept is of an older generation
    index.release()
    index.register("t_ix")
    q = "[0,0,0,0,0,0,1,0]"
    assert [r.id for r in spark.sql(f"SELECT id FROM t_ix WHERE id > 1 ORDER BY t_ix_score(scale, codes, '{q}') DESC, id LIMIT 2").collect()][0] == 4
    assert spark.sql("SELECT count, format_revision FROM t_ix_info").first() == (4, 2)


def test_payload_new_and_version(spark):
    payload.register(spark)
    assert spark.sql("SELECT stratavec_len(stratavec_new(8, 4)) n, stratavec_version() v").first().n == 0
    with pytest.raises(Exception, match="multiple of 8"):
        spark.sql("SELECT stratavec_new(7, 4)").collect()


def test_feed_has_every_generation(spark, index, tmp_path):
    from stratavec.streaming.sink import change_feed

    index.delete([2])
    out = str(tmp_path / "feed")
    change_feed(spark, index.path).writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
    assert sorted((r.gen, r.op, r.id) for r in spark.read.parquet(out).collect()) == [(1, "insert", 1), (1, "insert", 2), (1, "insert", 3), (2, "delete", 2)]


def test_scratch_tables_can_be_cleaned(spark):
    from stratavec import session

    kept = session.materialize(spark.range(3), "kept")
    assert kept.count() == 3
    session.clean(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])
