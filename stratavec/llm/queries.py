"""The queries of this subpackage's operators (``QUERIES``) and, where SQL can express one, its oracle (``SQL``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idfile, jpeg, linechunks, mixing, packing, rpforest, sharding, simhash, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table: a labelled document's domain is its language and its quality label."""
    labels, docs = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return labels.join(docs, "doc_id").select("doc_id", F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("domain"))


@_query
def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, labelled_domains(spark, sf_dir), power=0.8)
    copies = F.floor(F.col("rate") + F.col("draw")).cast("int")
    return out.select("doc_id", "source", "n_tokens", "domain", "posterior", "rate", copies.alias("copies"))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    out = toxicity.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = idfile.round_trip(_table(spark, sf_dir, "documents"), end_id=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op4_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


@_query
def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", "source", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = sharding.interleave(narrow, 24)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linechunks.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines", "chunks", "removed_chunks", "removed_lines", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


SQL["op6_line_chunks"] = linechunks.SQL


@_query
def op7_bwt_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))



@_query
def op8_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.describe(jpeg.with_media(_table(spark, sf_dir, "documents")))


@_query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(_table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), end_id=1, window=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
