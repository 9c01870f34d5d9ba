"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage like ``checkpoint()``, is computed once, and outlives
any executor.  The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


#: What a Python worker keeps from one task to the next, by operator.
_HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    """The store that a worker keeps for the tasks of ``owner`` until a task of another operator begins."""
    return _HELD.setdefault(owner, {})


def forget(keep: str | None = None) -> None:
    """Drop what the worker holds for operators other than ``keep``, and return freed memory to the system."""
    for owner in [k for k in _HELD if k != keep]:
        del _HELD[owner]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows``, so that what a task makes of one stays small; see ``forget``."""
    forget(keep)
    for batch in batches:
        for x in range(0, batch.num_rows, rows):
            yield batch.slice(x, rows)
    batch = None
    forget(keep)  # a worker that waits for its next task holds little


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new folder, on a local master only."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError(f"{_KEY} must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set(_KEY, own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _fs(spark, path)[0].deleteOnExit(_fs(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no table needs; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
