"""Structured Streaming into an index: every micro-batch is one generation, applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratavec.sources.index import OPS, VectorIndex


def apply_batch(index: VectorIndex, batch: DataFrame, batch_id: int) -> bool:
    """Upserts rows (id, embedding; a null embedding deletes) unless this batch was committed before."""
    index.refresh()
    if batch_id <= index.manifest.last_batch:
        return False
    t = index.transaction()
    try:
        gone = batch.where("embedding is null").select("id")
        t.delete(gone)
        t.insert(batch.where("embedding is not null"), "replace")
        t.commit(batch_id)
    except BaseException:
        if not t.done:
            t.rollback()
        raise
    return True


def write_stream(stream: DataFrame, index: VectorIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the sink; the batch id in the manifest makes replays harmless."""
    return stream.writeStream.foreachBatch(lambda df, n: apply_batch(index, df, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def change_feed(spark: SparkSession, path: str) -> DataFrame:
    """The index's operations as a stream (gen, seq, op, id, embedding).

    Every commit writes its operations below ``delta``, those that also write a new base too, so no generation is missing.
    """
    return spark.readStream.schema(OPS + ", gen long").parquet(f"{path}/delta").select("gen", "seq", "op", "id", "embedding")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Ingest rate by event type over tumbling windows, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
