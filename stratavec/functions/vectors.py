"""Vector values: parsing, checks and the canonical little-endian float32 encoding."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from stratavec.errors import DimensionMismatch, VectorFormatError

#: Coordinates at or above this magnitude are refused.
LIMIT = 1e16


def parse(value: bytes | str | list | np.ndarray | None) -> np.ndarray:
    """The float32 vector of a BLOB (little-endian float32), a JSON array or a sequence of numbers."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        raw = bytes(value)
        if len(raw) % 4:
            raise VectorFormatError(f"vector blob length {len(raw)} is not divisible by 4")
        out = np.frombuffer(raw, "<f4")
    elif isinstance(value, str):
        try:
            items = json.loads(value, parse_constant=lambda c: _refuse(f"vector text holds {c}"))
        except json.JSONDecodeError as e:
            raise VectorFormatError(f"vector text is not a JSON array: {e}") from e
        if not isinstance(items, list) or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in items):
            raise VectorFormatError("vector text is not a JSON array of numbers")
        out = _floats(items)
    elif isinstance(value, (list, tuple, np.ndarray)):
        if any(x is None for x in value):
            raise VectorFormatError("a vector has no null coordinates")
        out = _floats(value)
    else:
        raise VectorFormatError("a vector is a blob of float32 or a JSON array")
    bad = np.flatnonzero(~(np.abs(out) < LIMIT))
    if len(bad):
        raise VectorFormatError(f"vector coordinate {bad[0]} is not finite or is too large")
    return out


def _refuse(why: str) -> None:
    raise VectorFormatError(why)


def _floats(items) -> np.ndarray:
    try:
        with np.errstate(over="ignore"):
            return np.asarray(items, np.float64).astype("<f4").reshape(len(items))
    except (OverflowError, ValueError, TypeError) as e:
        raise VectorFormatError(f"a coordinate is not a number: {e}") from e


def encode(value) -> bytes:
    """The canonical bytes of a vector."""
    return parse(value).astype("<f4").tobytes()


def checked(value, dimensions: int) -> np.ndarray:
    out = parse(value)
    if len(out) != dimensions:
        raise DimensionMismatch(f"vector has {len(out)} dimensions, the index has {dimensions}")
    return out


@pandas_udf(BinaryType())
def f32(v: pd.Series) -> pd.Series:
    """Canonical bytes of BLOB, JSON or array vectors; the first invalid value raises."""
    return v.map(encode)


@pandas_udf(ArrayType(FloatType()))
def f32_array(v: pd.Series) -> pd.Series:
    """Float arrays of BLOB, JSON or array vectors."""
    return v.map(lambda x: parse(x).tolist())


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_valid(v: Column, dimensions: int | None = None) -> Column:
    """Whether an array column holds a valid vector, as an expression."""
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    return F.coalesce(ok if dimensions is None else ok & (F.size(v) == dimensions), F.lit(False))


def validate(df: DataFrame, dimensions: int, column: str = "embedding", key: str = "id") -> DataFrame:
    """``df`` with checks that raise while it runs: ids not null and not negative, vectors valid and of the right length."""
    v = F.col(column)
    why = F.when(F.col(key).isNull(), "an id is required").when(F.col(key) < 0, F.concat(F.lit("id is negative: "), F.col(key).cast("string"))).when(v.isNull(), "a vector is required").when(F.size(v) != dimensions, F.concat(F.lit("vector has "), F.size(v).cast("string"), F.lit(f" dimensions, the index has {dimensions}"))).when(~is_valid(v), "a vector coordinate is not finite or is too large")
    return df.where(F.when(why.isNotNull(), F.raise_error(why).cast("boolean")).otherwise(F.lit(True)))


def check_k(k) -> int:
    if isinstance(k, bool) or not isinstance(k, (int, np.integer)):
        raise TypeError("k is an integer")
    if k < 0:
        raise ValueError("k must not be negative")
    return int(k)

