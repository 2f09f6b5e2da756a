"""Cutting of lineage through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset, one in the warehouse, or a temporary one of a local session; that one is deleted at exit."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            where = tempfile.mkdtemp(prefix="driftloom-")
        sc.setCheckpointDir(where or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.scratch")
        atexit.register(_delete, spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, where: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone already
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the folder of `spark.checkpoint.dir`."""
    root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` written there as Parquet and read back: later readers read only the columns they need."""
    spark = df.sparkSession
    path = f"{root(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
