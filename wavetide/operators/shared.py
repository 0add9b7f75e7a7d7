"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession

from wavetide.sources.wav import scratch


def written(df: DataFrame) -> DataFrame:
    """df, written below the shared folder and read back, so that it is computed once; it goes when the driver's Python ends."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder then stays for the cluster's own cleaning
        pass
