"""What tasks need: the package in Python workers, and work for every core."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch for Python, about: with the session's usual 64 MB a worker's memory follows the rows of its task.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """The session hands rows to Python workers in batches of about BATCH bytes, or of one row; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH:
        spark.conf.set(key, str(BATCH))


def prepare(spark: SparkSession) -> SparkSession:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, where its files give fewer splits than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
