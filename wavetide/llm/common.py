"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and Spark runs on this
    machine alone (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='wavetide-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    The folder is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wavetide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that materialize has written and release hasn't removed.
_WRITTEN: list[str] = []


def release(spark: SparkSession, since: int) -> None:
    """Removes the tables that materialize has written since there were `since`, but for the last one; nothing may need them."""
    for path in _WRITTEN[since:-1]:
        _remove(spark, path)
    del _WRITTEN[since:-1]


def written() -> int:
    """How many tables of materialize there are."""
    return len(_WRITTEN)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder then stays for the cluster's own cleaning
        pass


_PER_TASK = []


def per_task(function):
    """The function with its last results kept until the task ends."""
    held = lru_cache(maxsize=2)(function)
    _PER_TASK.append(held)
    return held


def released(kernel):
    """The Arrow kernel, giving its worker's free memory back to the system when a task ends: workers stay for later tasks."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            for held in _PER_TASK:
                held.cache_clear()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
