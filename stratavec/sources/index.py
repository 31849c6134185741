"""A versioned, transactional vector index over Parquet.

``base/gen=N`` holds compressed rows (id, scale, codes, planes), sorted by id so that point lookups and clustered allowlists prune
row groups; ``delta/gen=N`` holds one commit's operations (seq, op, id, embedding, and the embedding's scale, codes and planes: readers
quantize nothing). ``manifest.json`` names the current
generation and its files and is replaced by one rename, so a commit is atomic and readers keep the snapshot they opened:
files of a generation never change. One writer at a time holds ``writer.lock``; a lock that is older than ``LOCK_SECONDS`` is
a crashed writer's and is taken over. A commit always writes its delta, which the change feed reads; when deltas
outgrow the policy it also writes a new base, and the manifest starts anew without deltas.

Revision 1 had no planes and only embeddings in its deltas. Such an index can be read as it is; the first commit rewrites it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.errors import CorruptIndex, DuplicateId, GeometryMismatch, StorageFormatError, TransactionError
from stratavec.functions import quant, vectors
from stratavec.operators import search
from stratavec.session import ship

FORMAT, REVISION = 1, 2
LOCK_SECONDS = 3600
CODES = "id long, scale float, codes binary, planes binary"
OPS = "seq long, op string, id long, embedding array<float>, scale float, codes binary, planes binary"
_MIB = 1 << 20


@dataclass(frozen=True)
class Manifest:
    dimensions: int
    bit_width: int
    generation: int = 0
    base: int = 0
    base_rows: int = 0
    row_count: int = 0
    base_bytes: int = 0
    delta_bytes: int = 0
    delta_operations: int = 0
    deltas: list[int] = field(default_factory=list)
    checks: dict[str, list[int]] = field(default_factory=dict)
    last_batch: int = -1
    format: int = FORMAT
    revision: int = REVISION


def delta_size(dims: int, ops: int, inserts: int) -> int:
    """Counted bytes of a commit's operations."""
    return 12 + 9 * ops + 4 * dims * inserts + 4


def must_compact(base_bytes: int, delta_bytes: int, ops: int, rows: int) -> bool:
    """Small bases are rewritten at once; larger ones when deltas reach a quarter of the base or of its rows, within bounds."""
    most = min(max(base_bytes // 4, 16 * _MIB), max(base_bytes, _MIB))
    return base_bytes < _MIB or delta_bytes >= most or ops >= max(rows // 4, 10_000)


class _Files:
    """The Hadoop file system of a path: works wherever Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Raises where the file exists."""
        stream = self.fs.create(self.path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def replace(self, name: str, text: str) -> None:
        tmp = f".{name}-{uuid.uuid4().hex}"
        self.create(tmp, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(self.path(tmp), self.path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VectorIndex:
    """An open index, pinned to the generation it was opened or last refreshed at."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest, self.files = spark, path.rstrip("/"), manifest, _Files(spark, path)
        self.geometry = quant.Geometry(manifest.dimensions, manifest.bit_width)
        self._read: dict[int, DataFrame] = {}
        self._live: tuple[int, DataFrame] | None = None

    # -- lifecycle
    @classmethod
    def create(cls, spark: SparkSession, path: str, **geometry) -> VectorIndex:
        """create(spark, path, dimensions=.., bit_width=..): an empty index at generation 0."""
        unknown, missing = set(geometry) - {"dimensions", "bit_width"}, {"dimensions", "bit_width"} - set(geometry)
        if unknown or missing:
            raise ValueError(f"unknown arguments {sorted(unknown)}" if unknown else f"missing arguments {sorted(missing)}")
        g = quant.Geometry(**geometry)
        files = _Files(spark, path)
        if files.exists("manifest.json"):
            raise ValueError(f"{path} holds an index already")
        spark.createDataFrame([], CODES).write.mode("overwrite").parquet(f"{path}/base/gen=0")
        manifest = Manifest(g.dimensions, g.bit_width, checks={"base": [0, 0]})
        files.create("manifest.json", json.dumps(asdict(manifest)))
        return cls(spark, path, manifest)

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimensions: int | None = None, bit_width: int | None = None, verify: bool = False) -> VectorIndex:
        """Reads the manifest only; with ``verify`` all files too, and raises ``CorruptIndex`` where they contradict it."""
        m = cls._manifest(spark, path)
        if (dimensions not in (None, m.dimensions)) or (bit_width not in (None, m.bit_width)):
            raise GeometryMismatch(f"the index has {m.dimensions} dimensions of {m.bit_width} bits")
        index = cls(spark, path, m)
        return index.verified() if verify else index

    @staticmethod
    def _manifest(spark: SparkSession, path: str) -> Manifest:
        files = _Files(spark, path)
        if not files.exists("manifest.json"):
            raise ValueError(f"{path} is no index")
        try:
            raw = json.loads(files.read("manifest.json"))
        except json.JSONDecodeError as e:
            raise CorruptIndex("the manifest can't be read") from e
        if raw.get("format") != FORMAT or raw.get("revision") not in range(1, REVISION + 1):
            raise StorageFormatError(f"storage format {raw.get('format')}.{raw.get('revision')} is not supported")
        try:
            return Manifest(**raw)
        except TypeError as e:
            raise CorruptIndex("the manifest's fields are wrong") from e

    def refresh(self) -> VectorIndex:
        """Moves to the newest committed generation."""
        self.manifest = self._manifest(self.spark, self.path)
        return self

    def drop(self) -> None:
        self.files.delete("")

    def rename(self, path: str) -> VectorIndex:
        target = self.files.jvm.org.apache.hadoop.fs.Path(path)
        if self.files.fs.exists(target):
            raise ValueError(f"{path} exists")
        if not self.files.fs.rename(self.files.path(""), target):
            raise ValueError(f"{self.path} can't be renamed to {path}")
        return VectorIndex.open(self.spark, path)

    # -- reading
    def _base(self) -> DataFrame:
        return self.spark.read.schema(CODES).parquet(f"{self.path}/base/gen={self.manifest.base}")

    def _ops(self) -> DataFrame | None:
        """The deltas' operations. Generations that were read before aren't listed again."""
        deltas = self.manifest.deltas
        self._read = {g: df for g, df in self._read.items() if g in deltas}
        out = None
        for gen in deltas:
            if gen not in self._read:
                self._read[gen] = self.spark.read.schema(OPS).parquet(f"{self.path}/delta/gen={gen}").withColumn("gen", F.lit(gen))
            out = self._read[gen] if out is None else out.unionByName(self._read[gen])
        return out

    def rows(self, pending: DataFrame | None = None) -> DataFrame:
        """(id, scale, codes, planes) of the live rows: the base less what deltas touched, and the deltas' last word on each id.

        Deltas are bounded by the compaction policy; the base is only filtered by an anti join, never shuffled by it
        when the deltas fit a broadcast.
        """
        if pending is None and self._live and self._live[0] == self.manifest.generation:
            return self._live[1]
        base, old = self._base(), self.manifest.revision == 1
        if old:
            base = self._planed(base)
        ops = self._ops()
        if pending is not None:
            pending = pending.withColumn("gen", F.lit(self.manifest.generation + 1))
            ops = pending if ops is None else ops.unionByName(pending)
        if ops is None:
            return base
        last = ops.groupBy("id").agg(F.max_by(F.struct("op", "embedding", "scale", "codes", "planes"), F.struct("gen", "seq")).alias("x")).select("id", "x.*")
        inserts = last.where("op = 'insert'")
        fresh = search.codes(inserts, self.geometry) if old else inserts.select("id", "scale", "codes", "planes")
        return base.join(last.select("id"), "id", "left_anti").unionByName(fresh)

    def _planed(self, base: DataFrame) -> DataFrame:
        g = self.geometry

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                planes = quant.planes_of(quant.unpack(b.column(2).to_pylist(), g), g) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(planes, pa.binary())], ["id", "scale", "codes", "planes"])

        ship(self.spark)
        return base.mapInArrow(run, CODES)

    def prepare(self) -> VectorIndex:
        """Keeps this generation's live rows in the executors' memory for the searches that follow."""
        self.release()
        self._live = self.manifest.generation, self.rows().persist()
        self._live[1].count()
        return self

    def release(self) -> None:
        if self._live:
            self._live[1].unpersist()
            self._live = None

    def register(self, name: str) -> None:
        """SQL access: the view ``name`` (id, scale, codes, planes), the one-row view ``name_info``, and ``name_score(scale, codes, query)``.

        ``SELECT id, name_score(scale, codes, '[..]') AS score FROM name WHERE id IN (..) ORDER BY score DESC, id LIMIT k OFFSET m`` is the search: its
        WHERE comes before the top-k, predicates on an outer query after it.
        """
        g, ids = self.geometry, self.rows()
        ship(self.spark)

        def score(scale: pd.Series, codes: pd.Series, query: pd.Series) -> pd.Series:
            out, values = np.zeros(len(scale)), query.to_numpy()
            for q in query.unique():
                mine = np.flatnonzero(values == q)
                x = g.levels()[quant.unpack([bytes(c) for c in codes.iloc[mine]], g)]
                out[mine] = (x @ quant.rotate(vectors.checked(q, g.dimensions)[None], g)[0]) * scale.iloc[mine].to_numpy(np.float64)
            return pd.Series(out)

        self.spark.udf.register(f"{name}_score", F.pandas_udf(score, "double"))
        ids.createOrReplaceTempView(name)
        info = self.info(verify=False)
        self.spark.createDataFrame([tuple(info.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in info.items())).createOrReplaceTempView(f"{name}_info")

    def ids(self) -> DataFrame:
        """Every live id; codes and scales aren't read."""
        base, ops = self._base().select("id"), self._ops()
        return base if ops is None else live_ids(base, ops)

    def lookup(self, id: int) -> DataFrame:
        """The id if it is live; a pushed-down filter."""
        return self.ids().where(F.col("id") == id)

    def count(self) -> int:
        """From the manifest."""
        return self.manifest.row_count

    def search(self, query, k: int | None = None, limit: int | None = None, offset: int = 0, filter=None, order: str | None = "score desc") -> DataFrame:
        """(id, score) under the compressed score. Plan label: knn, or knn with a semi join for an allowlist."""
        return self._search(self.rows(), self.count(), query, k, limit, offset, filter, order)

    def _search(self, rows: DataFrame, count: int, query, k, limit, offset, filter, order) -> DataFrame:
        n, offset = search.effective_k(k, limit, offset, count, order)
        q = self.spark.createDataFrame([(0, vectors.checked(query, self.geometry.dimensions).tolist())], "qid long, embedding array<float>")
        hits = search.knn_codes(rows, q, n, self.geometry, filter).select("id", "score").orderBy(F.desc("score"), "id")
        return hits.offset(offset) if offset else hits

    def search_batch(self, queries: DataFrame, k: int, filter=None, staged: bool | None = None) -> DataFrame:
        """(qid, id, score, rank) for (qid, embedding)."""
        staged = self.count() >= search.STAGED_ROWS if staged is None else staged
        return search.knn_codes(self.rows(), queries, k, self.geometry, filter, staged)

    def info(self, verify: bool = True) -> dict:
        """Eleven facts about the index; raises ``CorruptIndex`` if its files contradict them."""
        if verify:
            self.verified()
        m = self.manifest
        return {"table": self.path.rsplit("/", 1)[-1], "generation": m.generation, "count": m.row_count, "bit_width": m.bit_width, "dimensions": m.dimensions, "serialized_bytes": m.base_bytes + m.delta_bytes, "base_bytes": m.base_bytes, "delta_bytes": m.delta_bytes, "delta_operations": m.delta_operations, "format_version": m.format, "format_revision": m.revision}

    # -- integrity
    def check(self) -> list[str]:
        """["ok"], or what is wrong first: files, counts, checksums and duplicate ids against the manifest."""
        m, g = self.manifest, self.geometry
        try:
            if m.deltas != list(range(m.generation - len(m.deltas) + 1, m.generation + 1)):
                return ["delta generations are not contiguous"]
            base = self._base()
            got = _base_check(base, m.revision)
            if got != m.checks.get("base") or got[0] != m.base_rows:
                return ["the base differs from its checksum"]
            if base.where(_wrong(g, m.revision)).head(1):
                return ["a row of the base is damaged"]
            ops = 0
            for gen in m.deltas:
                one = self.spark.read.schema(OPS).parquet(f"{self.path}/delta/gen={gen}")
                if (check := _ops_check(one, m.revision)) != m.checks.get(str(gen)):
                    return [f"delta {gen} differs from its checksum"]
                if one.where(F.coalesce(~F.col("op").isin("insert", "delete"), F.lit(True)) | (F.col("op") == "insert") & (_wrong(g, m.revision) if m.revision > 1 else F.size("embedding") != g.dimensions)).head(1):
                    return [f"an operation of delta {gen} is damaged"]
                ops += check[0]
            if ops != m.delta_operations:
                return ["delta operations differ from the manifest"]
            n, distinct = self.ids().agg(F.count("id"), F.countDistinct("id")).first()
        except Exception as e:  # a missing or unreadable file
            return [f"a file can't be read: {type(e).__name__}"]
        if n != distinct:
            return ["an id occurs more than once"]
        return ["ok"] if n == m.row_count else [f"the index has {n} rows, the manifest says {m.row_count}"]

    def verified(self) -> VectorIndex:
        """Raises ``CorruptIndex`` unless :meth:`check` is clean."""
        if (why := self.check()) != ["ok"]:
            raise CorruptIndex(why[0])
        return self

    # -- writing
    def transaction(self) -> Transaction:
        return Transaction(self)

    def insert(self, df: DataFrame, on_conflict: str = "abort") -> int:
        t = self.transaction()
        try:
            n = t.insert(df, on_conflict)
        except DuplicateId:
            if not t.done:
                t.commit() if on_conflict == "fail" else t.rollback()  # rows before the duplicate survive
            raise
        except BaseException:
            if not t.done:
                t.rollback()
            raise
        t.commit()
        return n

    def delete(self, ids) -> int:
        with self.transaction() as t:
            return t.delete(ids)

    def update(self, *_, **__):
        raise NotImplementedError("rows can't be updated; delete and insert them")

    def reconcile(self, content: DataFrame) -> tuple[int, int]:
        """Makes the index hold exactly content's ids (id, embedding): (deleted, inserted)."""
        with self.transaction() as t:
            gone = t.delete(t.ids().join(content.select("id"), "id", "left_anti"))
            return gone, t.insert(content.join(t.ids(), "id", "left_anti"))


def live_ids(base: DataFrame, ops: DataFrame) -> DataFrame:
    last = ops.groupBy("id").agg(F.max_by("op", F.struct("gen", "seq")).alias("op"))
    return base.join(last.select("id"), "id", "left_anti").unionByName(last.where("op = 'insert'").select("id"))


def _wrong(g: quant.Geometry, revision: int) -> Column:
    """Whether a row of codes can't be one of this geometry."""
    bad = F.col("id").isNull() | (F.col("id") < 0) | F.coalesce((F.octet_length("codes") != g.code_bytes) | F.isnan("scale") | (F.col("scale") < 0), F.lit(True))
    return bad if revision == 1 else bad | F.coalesce(F.octet_length("planes") != g.padded // 4, F.lit(True))


def _base_check(df: DataFrame, revision: int = REVISION) -> list[int]:
    more = [F.col("scale").cast("string").cast("binary"), F.col("planes")] if revision > 1 else []
    n, s = df.agg(F.count(F.lit(1)), F.sum(F.crc32(F.concat(F.col("id").cast("string").cast("binary"), F.col("codes"), *more)))).first()
    return [n, s or 0]


def _ops_check(df: DataFrame, revision: int = REVISION) -> list[int]:
    names = ["seq", "op", "id", "embedding"] + (["scale", "codes", "planes"] if revision > 1 else [])
    n, s = df.agg(F.count(F.lit(1)), F.sum(F.crc32(F.to_json(F.struct(*names)).cast("binary")))).first()
    return [n, s or 0]


class Transaction:
    """Collects operations; reads inside see them. Leaving the block commits, an exception rolls back."""

    def __init__(self, index: VectorIndex):
        self.index, self.ops, self.marks, self.seq, self.done = index, [], [], 0, False
        self.sizes: list[tuple[int, int]] = []  # operations and inserts of each statement
        self.token = uuid.uuid4().hex
        index.refresh()
        self.start = index.manifest
        self._lock()

    def _lock(self) -> None:
        files, text = self.index.files, json.dumps({"token": self.token, "time": time.time()})
        try:
            files.create("writer.lock", text)
            return
        except Exception as e:
            if time.time() - self._holder()[1] < LOCK_SECONDS:
                raise TransactionError("another writer holds the index") from e
        files.replace("writer.lock", text)  # the last of several to take over holds it
        if self._holder()[0] != self.token:
            raise TransactionError("another writer holds the index")

    def _holder(self) -> tuple[str, float]:
        try:
            held = json.loads(self.index.files.read("writer.lock"))
            return held["token"], held["time"]
        except Exception:  # gone, or not written yet
            return "", time.time()

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.done:
            self.rollback() if kind else self.commit()

    def _open(self) -> None:
        if self.done:
            raise TransactionError("the transaction has ended")

    def _pending(self) -> DataFrame | None:
        out = None
        for op in self.ops:
            out = op if out is None else out.unionByName(op)
        return out

    def ids(self) -> DataFrame:
        base, pending = self.index.ids(), self._pending()
        return base if pending is None else live_ids(base, pending.withColumn("gen", F.lit(0)))

    def search_batch(self, queries: DataFrame, k: int, filter=None) -> DataFrame:
        return search.knn_codes(self.index.rows(self._pending()), queries, k, self.index.geometry, filter)

    def search(self, query, k: int | None = None, limit: int | None = None, offset: int = 0, filter=None, order: str | None = "score desc") -> DataFrame:
        """As :meth:`VectorIndex.search`, over what this transaction sees."""
        return self.index._search(self.index.rows(self._pending()), self.count(), query, k, limit, offset, filter, order)

    def count(self) -> int:
        return self.ids().count()

    def _stage(self, df: DataFrame) -> int:
        """Writes operations aside, so that they are evaluated once; numbers them by ``ord``."""
        staged = self._aside(df)
        n, most, inserts = staged.agg(F.count(F.lit(1)), F.max("ord"), F.sum((F.col("op") == "insert").cast("long"))).first()
        return self._add(staged, n, most, inserts)

    def _add(self, staged: DataFrame, n: int, most: int | None, inserts: int | None) -> int:
        if n:
            self.ops.append(staged.select((F.col("ord") + self.seq).alias("seq"), "op", "id", F.col("embedding").cast("array<float>").alias("embedding"), "scale", "codes", "planes"))
            self.sizes.append((n, inserts))
            self.seq += most + 1
        return n

    def insert(self, df: DataFrame, on_conflict: str = "abort") -> int:
        """Inserts (id, embedding, optional seq for the input order); returns how many rows went in.

        abort: a duplicate undoes the statement; ignore: the first row of an id goes in, existing ids stay; replace: the last
        row of an id wins; fail: rows before the first duplicate stay, then it raises; rollback: the transaction ends.
        """
        self._open()
        if on_conflict not in ("abort", "ignore", "replace", "fail", "rollback"):
            raise ValueError(f"unknown conflict policy {on_conflict}")
        order = F.col("seq").cast("long") if "seq" in df.columns else F.monotonically_increasing_id()
        rows = df.select(order.alias("o"), F.col("id").cast("long").alias("id"), F.col("embedding"))
        if dict(rows.dtypes)["embedding"] in ("string", "binary"):
            ship(self.index.spark)
            rows = rows.withColumn("embedding", vectors.f32_array("embedding"))
        rows = vectors.validate(rows.withColumn("embedding", F.col("embedding").cast("array<float>")), self.index.geometry.dimensions)
        rows = self._aside(self._quantized(rows))
        ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("o"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
        existing = self.ids().withColumn("there", F.lit(True))
        marked = ranked.join(existing, "id", "left").withColumn("bad", F.coalesce("there", F.lit(False)) | (F.col("r") > 1))
        if on_conflict == "ignore":
            good = marked.where("not bad")
        elif on_conflict == "replace":
            good = marked.where("r = n")
        else:
            first, n, most = marked.agg(F.min(F.when(F.col("bad"), F.col("o"))), F.count(F.lit(1)), F.max("o")).first()
            if first is None:
                return self._add(self._inserts(rows), n, most, n)  # as they were written aside
            good = marked.where(F.col("o") < first)
            if on_conflict != "fail":
                if on_conflict == "rollback":
                    self.rollback()
                raise DuplicateId("an inserted id exists already")
            self._stage(self._inserts(good))
            raise DuplicateId("an inserted id exists already; rows before it were kept")
        return self._stage(self._inserts(good))

    def _quantized(self, rows: DataFrame) -> DataFrame:
        """(o, id, embedding) with scale, codes and planes."""
        g = self.index.geometry

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    b = batch.slice(a, 4096)
                    scale, c = quant.quantize(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, g.dimensions), g)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scale), pa.array(quant.pack(c, g), pa.binary()), pa.array(quant.planes_of(c, g), pa.binary())], ["o", "id", "embedding", "scale", "codes", "planes"])

        ship(self.index.spark)
        return rows.select("o", "id", "embedding").mapInArrow(run, "o long, id long, embedding array<float>, scale float, codes binary, planes binary")

    def _aside(self, df: DataFrame) -> DataFrame:
        path = f"{self.index.path}/staged/{self.token}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.index.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _inserts(df: DataFrame) -> DataFrame:
        return df.select(F.col("o").alias("ord"), F.lit("insert").alias("op"), "id", "embedding", "scale", "codes", "planes")

    def delete(self, ids) -> int:
        """Deletes ids (a DataFrame's first column, or a list); absent ids don't count."""
        self._open()
        spark = self.index.spark
        if not isinstance(ids, DataFrame):
            ids = spark.createDataFrame([(int(i),) for i in ids], "id long")
        wanted = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
        gone = self.ids().join(wanted, "id", "left_semi")
        return self._stage(gone.select(F.monotonically_increasing_id().alias("ord"), F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("float").alias("scale"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("planes")))

    # -- savepoints
    def savepoint(self, name: str) -> None:
        self._open()
        self.marks.append((name, len(self.ops)))

    def _mark(self, name: str) -> int:
        self._open()
        for i in range(len(self.marks) - 1, -1, -1):
            if self.marks[i][0] == name:
                return i
        raise TransactionError(f"no savepoint {name}")

    def release(self, name: str) -> None:
        del self.marks[self._mark(name) :]

    def rollback_to(self, name: str) -> None:
        i = self._mark(name)
        del self.ops[self.marks[i][1] :], self.sizes[self.marks[i][1] :]
        del self.marks[i + 1 :]

    # -- end
    def rollback(self) -> None:
        self._open()
        self.ops = []
        self._end()

    def _end(self) -> None:
        self.done = True
        self.index.files.delete(f"staged/{self.token}")
        if self._holder()[0] == self.token:
            self.index.files.delete("writer.lock")

    def commit(self, batch: int | None = None) -> int:
        """Writes the delta, or a new base where the policy asks for it; returns the generation."""
        self._open()
        index, m = self.index, self.start
        pending = self._pending()
        try:
            if pending is None:
                if batch is not None:
                    index.files.replace("manifest.json", json.dumps(asdict(replace(m, last_batch=batch))))
                    index.refresh()
                return m.generation
            if self._holder()[0] != self.token:
                raise TransactionError("another writer has taken the index over")
            gen, ops, inserts = m.generation + 1, sum(n for n, _ in self.sizes), sum(n for _, n in self.sizes)
            rows = self.count()
            size = m.delta_bytes + delta_size(m.dimensions, ops, inserts)
            last = m.last_batch if batch is None else batch
            pending.coalesce(8).write.mode("overwrite").parquet(f"{index.path}/delta/gen={gen}")
            if m.revision < REVISION or must_compact(m.base_bytes, size, m.delta_operations + ops, rows):
                target = f"{index.path}/base/gen={gen}"
                index.rows(pending).repartitionByRange(F.col("id")).sortWithinPartitions("id").write.mode("overwrite").parquet(target)
                check = _base_check(index.spark.read.schema(CODES).parquet(target))
                new = Manifest(m.dimensions, m.bit_width, gen, gen, check[0], check[0], check[0] * (12 + index.geometry.code_bytes), checks={"base": check}, last_batch=last)
            else:
                check = _ops_check(index.spark.read.schema(OPS).parquet(f"{index.path}/delta/gen={gen}"))
                new = replace(m, generation=gen, row_count=rows, delta_bytes=size, delta_operations=m.delta_operations + ops, deltas=[*m.deltas, gen], checks=m.checks | {str(gen): check}, last_batch=last)
            index.files.replace("manifest.json", json.dumps(asdict(new)))
            index.manifest = new
            return gen
        finally:
            self._end()
