"""Session helpers: shipping the package to executors and shared scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable by the session's Python workers (once per context)."""
    sc = spark.sparkContext
    if getattr(sc, "_stratavec_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="stratavec-"), "stratavec.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(_ROOT.parent)))
    sc.addPyFile(target)
    sc._stratavec_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(sc, "_stratavec_tmp", None)
        if base is None:
            base = sc._stratavec_tmp = tempfile.mkdtemp(prefix="stratavec-shared-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below this application's own part of it."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stratavec/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder; results that haven't been read or written yet are lost."""
    _delete(spark, _scratch(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Hand a Python worker's unused memory back to the system: workers outlive their tasks and wait for more."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: With this setting Spark drops an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings (dots as two underscores) that hold inside; what was set before comes back."""
    keys = {k.replace("__", "."): str(v) for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, compression: str = "zstd", batch: int | None = None, size: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it reread: cuts lineage and survives lost executors.

    batch: rows handed to Python at a time, where they hold whole texts; size: their bytes, about. Shuffle files go when the table is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    more = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(batch)} if batch else {}
    if size:
        more["spark__sql__execution__arrow__maxBytesPerBatch"] = str(size)
    with settings(spark, **{_CLEANUP.replace(".", "__"): "true"}, **more):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stratavec/" in d:
            _delete(spark, d)
