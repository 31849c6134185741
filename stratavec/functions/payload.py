"""Portable index payloads: one binary value holds a small index.

Layout: b"SVP1", revision byte 1, bit width byte, dimensions (uint32), rows (uint64), CRC-32 of the body (uint32), then the body:
ids (int64), scales (float32) and packed codes, row by row of each kind. Little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

import stratavec
from stratavec.errors import DuplicateId, PayloadFormatError, UnknownId
from stratavec.functions import quant, vectors

MAGIC, REVISION, _HEAD = b"SVP1", 1, struct.Struct("<4sBBIQI")


class Payload:
    """A decoded payload."""

    def __init__(self, g: quant.Geometry, ids=None, scales=None, packed=None):
        self.g = g
        self.ids = np.zeros(0, np.int64) if ids is None else ids
        self.scales = np.zeros(0, np.float32) if scales is None else scales
        self.packed: list[bytes] = packed or []

    def to_bytes(self) -> bytes:
        body = self.ids.astype("<i8").tobytes() + self.scales.astype("<f4").tobytes() + b"".join(self.packed)
        return _HEAD.pack(MAGIC, REVISION, self.g.bit_width, self.g.dimensions, len(self.ids), zlib.crc32(body)) + body

    @classmethod
    def header(cls, raw: bytes) -> tuple[quant.Geometry, int, int]:
        if raw is None or len(raw) < _HEAD.size:
            raise PayloadFormatError("the payload is shorter than its header")
        magic, revision, bits, dims, n, crc = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise PayloadFormatError("the value is no index payload")
        if revision != REVISION:
            raise PayloadFormatError(f"payload revision {revision} is not supported")
        try:
            return quant.Geometry(dims, bits), n, crc
        except ValueError as e:
            raise PayloadFormatError(str(e)) from e

    @classmethod
    def from_bytes(cls, raw: bytes) -> Payload:
        g, n, crc = cls.header(raw)
        body = raw[_HEAD.size :]
        if len(body) != n * (12 + g.code_bytes):
            raise PayloadFormatError("the payload's length contradicts its header")
        if zlib.crc32(body) != crc:
            raise PayloadFormatError("the payload's checksum is wrong")
        ids, scales = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<f4", n, 8 * n)
        return cls(g, ids, scales, [body[12 * n + i * g.code_bytes :][: g.code_bytes] for i in range(n)])

    def add(self, ids, values) -> Payload:
        ids = [int(i) for i in ids]
        if any(i < 0 for i in ids):
            raise ValueError("an id must not be negative")
        if len(set(ids)) != len(ids) or set(ids) & set(self.ids.tolist()):
            raise DuplicateId("an id exists already")
        if not ids:
            return self
        x = np.stack([vectors.checked(v, self.g.dimensions) for v in values])
        scale, codes = quant.quantize(x, self.g)
        return Payload(self.g, np.r_[self.ids, np.array(ids, np.int64)], np.r_[self.scales, scale], self.packed + quant.pack(codes, self.g))

    def remove(self, id: int) -> Payload:
        at = np.flatnonzero(self.ids == id)
        if not len(at):
            raise UnknownId(f"id {id} is not in the index")
        keep = np.flatnonzero(self.ids != id)
        return Payload(self.g, self.ids[keep], self.scales[keep], [self.packed[i] for i in keep.tolist()])

    def search(self, query, k: int) -> list[tuple[int, float]]:
        k, q = vectors.check_k(k), vectors.checked(query, self.g.dimensions)
        if not len(self.ids) or not k:
            return []
        s = quant.scores(self.scales, quant.unpack(self.packed, self.g), q[None], self.g)[:, 0]
        order = np.lexsort((self.ids, -s))[:k]
        return [(int(self.ids[i]), float(s[i])) for i in order]


def build(dims, bits, ids, values) -> bytes:
    """The aggregate's body: geometry must be constant, ids distinct, and there must be rows."""
    kinds = set(zip(dims, bits))
    if not kinds:
        raise ValueError("an index can't be built from no rows")
    if len(kinds) > 1:
        raise ValueError("dimensions and bit width must be constant")
    d, b = kinds.pop()
    return Payload(quant.Geometry(int(d), int(b))).add(ids, values).to_bytes()


@pandas_udf(BinaryType())
def build_agg(dims: pd.Series, bits: pd.Series, ids: pd.Series, v: pd.Series) -> bytes:
    """Grouped aggregate: the index payload of a group."""
    return build(dims.tolist(), bits.tolist(), ids.tolist(), v.tolist())


def build_groups(df: DataFrame, g: quant.Geometry, by: str | None = None, key: str = "id", column: str = "embedding") -> DataFrame:
    """(by, payload) for each group, or one payload of the whole table; no rows at all raise ``ValueError``."""
    agg = build_agg(F.lit(g.dimensions), F.lit(g.bit_width), F.col(key), F.col(column)).alias("payload")
    if not df.head(1):
        raise ValueError("an index can't be built from no rows")
    return df.groupBy(by).agg(agg) if by else df.agg(agg)


@pandas_udf(BinaryType())
def new(dims: pd.Series, bits: pd.Series) -> pd.Series:
    return pd.Series([Payload(quant.Geometry(int(d), int(b))).to_bytes() for d, b in zip(dims, bits)])


@pandas_udf(BinaryType())
def add(blob: pd.Series, ids: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([Payload.from_bytes(b).add([i], [x]).to_bytes() for b, i, x in zip(blob, ids, v)])


@pandas_udf(BinaryType())
def drop(blob: pd.Series, ids: pd.Series) -> pd.Series:
    return pd.Series([Payload.from_bytes(b).remove(int(i)).to_bytes() for b, i in zip(blob, ids)])


@pandas_udf(LongType())
def length(blob: pd.Series) -> pd.Series:
    """Rows, from the header alone."""
    return blob.map(lambda b: Payload.header(b)[1])


@pandas_udf(IntegerType())
def dimensions(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: Payload.header(b)[0].dimensions)


@pandas_udf(IntegerType())
def bit_width(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: Payload.header(b)[0].bit_width)


@udtf(returnType=StructType([StructField("id", LongType()), StructField("score", DoubleType())]))
class PayloadKnn:
    """knn(payload, query, k): the best rows of a payload, by score then id."""

    def eval(self, payload, query, k):
        if payload is None or query is None or k is None:
            raise TypeError("knn needs a payload, a query and k")
        yield from Payload.from_bytes(bytes(payload)).search(query, k)


def register(spark: SparkSession, prefix: str = "stratavec_") -> None:
    """Install the functions, the aggregate and the table function in a session."""
    from stratavec.session import ship

    ship(spark)
    for name, f in {"f32": vectors.f32, "new": new, "add": add, "remove": drop, "len": length, "dimensions": dimensions, "bit_width": bit_width, "build": build_agg}.items():
        spark.udf.register(prefix + name, f)
    version = stratavec.__version__
    spark.udf.register(prefix + "version", lambda: version, "string")
    spark.udtf.register(prefix + "knn", PayloadKnn)
