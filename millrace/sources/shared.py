"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where nothing is set
    and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="millrace-core-"))
    return "file://" + _own[0]


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a place, as Spark sees them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def goes_at_exit(spark: SparkSession, path: str) -> str:
    where, fs = file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written once and read back: whoever reads it again sees the same rows."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    goes_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
