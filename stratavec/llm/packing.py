"""Concatenate and cut: pack tokenized documents into fixed windows without padding.

Pass one encodes every document once and writes the ids to a table in the shared folder, with the document's place in
its partition. The partitions' token totals then get running sums (one row a partition, so this is small at any size),
which turn places into global offsets. Pass two cuts every document at the window boundaries its offsets cross and
emits one boundary record a piece. Documents never move between tasks; only the totals are shuffled.

Defined results: a null text counts as empty; an empty text still has its end id; rows with the same document id, and those
without one, are packed one by one; a text longer than a window gets a piece in each window it crosses; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.session import materialize, ship

from . import tokens

TOKENS = "part int, doc_id long, part_start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
#: Bytes of ids cut at a time.
SLICE = 4_000_000


def tokenize(docs: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row's ids, in the order the partition holds them, with its start among the ids of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, tokens.encoder(path)
        for batch in batches:
            for a, b in tokens.byte_groups(batch.column(1), tokens.SLICE):
                flat, n = tokens.with_end(*enc.encode(batch.column(1).slice(a, b - a)), end_id)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), batch.column(0).slice(a, b - a), pa.array(starts), pa.array(n), tokens.binaries(flat, n)], ["part", "doc_id", "part_start", "n_tokens", "ids"])

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, TOKENS)


def partition_bases(tokenized: DataFrame) -> DataFrame:
    """(part, base): ids in all partitions before. One row a partition, which bounds what is broadcast later."""
    totals = tokenized.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")).alias("base"))


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = 2048) -> DataFrame:
    """One row a piece: which ids of which document stand where in which sequence, with the piece's ids (``ids``, 32-bit little-endian)."""
    path = path or tokens.default_path()
    done = materialize(tokenize(docs, path, end_id), "tokens")
    placed = done.join(F.broadcast(partition_bases(done)), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("at"), "ids")
    width = tokens.encoder(path).dtype.itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.byte_groups(batch.column(2), SLICE):
                doc, at, ids = (c.slice(a, b - a) for c in batch.columns)
                flat = np.frombuffer(b"".join(ids.to_pylist()), f"<u{width}").astype("<u4")
                at = at.to_numpy()
                n = pc.binary_length(ids).to_numpy().astype(np.int64) // width
                first = at // window
                pieces = (at + n - 1) // window - first + 1
                row = np.repeat(np.arange(len(n)), pieces)
                seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin, end = np.maximum(seq * window, at[row]), np.minimum((seq + 1) * window, (at + n)[row])
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(begin - at[row]), pa.array(end - begin), tokens.binaries(flat, end - begin), pa.array(n[row]), pa.array(seq), pa.array(begin - seq * window)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, PIECES)
