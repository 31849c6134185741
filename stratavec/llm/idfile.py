"""Token-id files: documents' ids in ascending key order, range-coded in checksummed blocks.

File format. A file is a Parquet container whose rows are segments in order; a segment holds whole documents:
``part``, ``part_start`` (ids of the same part before it), ``docs`` and ``lengths`` (keys and id counts), ``n_tokens``
and ``payload``. A payload is b"SVI1", the number of blocks, then for each block its id count, coded length and CRC-32
(little-endian unsigned 32-bit integers; the checksum is of the coded bytes, begun from the id count), then the coded
blocks. Blocks are coded on their own (see :mod:`coder`), so each can be read without its neighbours. A wrong magic,
length or checksum raises ``ValueError``.

Range partitioning by key gives each writing task a run of keys; the parts' totals, one number a part, give the global
starts. Defined results: null texts count as empty; equal keys stand by text; null keys come first; an empty table
gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.session import scratch_path, ship

from . import coder, tokens
from .packing import partition_bases

MAGIC = b"SVI1"
SEGMENT = 128 * coder.BLOCK
FILE = "part int, part_start long, n_tokens long, docs array<long>, lengths array<long>, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def payloads(runs: list[np.ndarray]) -> list[bytes]:
    """One payload for each run of ids."""
    blocks = [[r[i : i + coder.BLOCK] for i in range(0, len(r), coder.BLOCK)] for r in runs]
    coded = iter(coder.encode_blocks([b for bs in blocks for b in bs]))
    out = []
    for bs in blocks:
        done = [next(coded) for _ in bs]
        head = MAGIC + struct.pack("<I", len(bs)) + b"".join(struct.pack("<III", len(b), len(c), coder.checksum(c, len(b))) for b, c in zip(bs, done))
        out.append(head + b"".join(done))
    return out


def read_payloads(data: list[bytes]) -> list[np.ndarray]:
    """The ids of each payload, after checking it."""
    coded, sizes, counts = [], [], []
    for p in data:
        if p[:4] != MAGIC or len(p) < 8:
            raise ValueError("not a token-id payload")
        n = struct.unpack_from("<I", p, 4)[0]
        at = 8 + 12 * n
        if at > len(p):
            raise ValueError("the payload's block table is cut off")
        for k in range(n):
            count, size, crc = struct.unpack_from("<III", p, 8 + 12 * k)
            c = p[at : at + size]
            if len(c) != size or coder.checksum(c, count) != crc or not 0 < count <= coder.BLOCK:
                raise ValueError(f"block {k} of the payload is damaged")
            coded.append(c)
            sizes.append(count)
            at += size
        if at != len(p):
            raise ValueError("bytes follow the payload's last block")
        counts.append(n)
    ids = iter(coder.decode_blocks(coded, sizes))
    return [np.concatenate([next(ids) for _ in range(n)]) if n else np.zeros(0, np.int32) for n in counts]


def _flush(held: list[tuple[list, list[np.ndarray]]], part: int, at: int) -> pa.RecordBatch:
    runs = [np.concatenate(ids) for _, ids in held]
    n = np.array([len(r) for r in runs], np.int64)
    lengths = [[len(x) for x in ids] for _, ids in held]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), part, np.int32)), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array([d for d, _ in held], pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())), pa.array(payloads(runs), pa.binary())], schema=_ARROW)


def write(docs: DataFrame, target: str, path: str | None = None, end_id: int = 2, text: str = "text", key: str = "doc_id") -> None:
    """Encode every whole text, append ``end_id`` and write the files below ``target``."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, tokens.encoder(path)
        if enc.dtype.itemsize != 2:
            raise ValueError("the coder takes vocabularies of up to 65,536 ids")
        held, size, total = [([], [])], 0, 0
        for batch in batches:
            for a, b in tokens.byte_groups(batch.column(1), tokens.SLICE):
                flat, n = tokens.with_end(*enc.encode(batch.column(1).slice(a, b - a)), end_id)
                for k, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), np.split(flat, np.cumsum(n)[:-1])):
                    held[-1][0].append(k)
                    held[-1][1].append(ids)
                    size += len(ids)
                    if size >= SEGMENT:
                        total += size
                        held.append(([], []))
                        size = 0
                        if total >= coder.LANES * coder.BLOCK:
                            yield (out := _flush(held[:-1], part, at))
                            at += sum(out.column(2).to_pylist())
                            held, total = held[-1:], 0
        if not held[-1][0]:
            held.pop()
        if held:
            yield _flush(held, part, at)

    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FILE).write.parquet(target)


def read(spark: SparkSession, source: str) -> DataFrame:
    """Every document of the files below ``source``: doc_id, start, n_tokens and its ``ids`` (32-bit, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = coder.LANES * coder.BLOCK // SEGMENT
        for batch in batches:
            for i in range(0, batch.num_rows, per):
                rows = batch.slice(i, per).to_pylist()
                for row, ids in zip(rows, read_payloads([r["payload"] for r in rows])):
                    n = np.array(row["lengths"], np.int64)
                    if n.sum() != len(ids) or row["n_tokens"] != len(ids):
                        raise ValueError("a segment's documents don't add up to its ids")
                    ends = np.cumsum(n)
                    raw = ids.astype("<u4").tobytes()
                    cuts = [raw[4 * a : 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["part"], np.int32)), pa.array(row["docs"], pa.int64()), pa.array(row["part_start"] + ends - n), pa.array(n), pa.array(cuts, pa.binary())], ["part", "doc_id", "part_start", "n_tokens", "ids"])

    ship(spark)
    files = spark.read.schema(FILE).parquet(source)
    docs = files.mapInArrow(run, "part int, doc_id long, part_start long, n_tokens long, ids binary")
    return docs.join(F.broadcast(partition_bases(files)), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    target = scratch_path(docs.sparkSession, "idfile")
    write(docs, target, path, end_id)
    return read(docs.sparkSession, target)

