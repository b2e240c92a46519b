"""Spark helpers of this subpackage: shared storage, bucket counts, global numbering."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_own: list[str] = []


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end at 2 MB, however long texts are: otherwise only rows are counted.
    A session that names its own bound keeps it."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "2m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only
    where nothing is set and driver and executors are one process, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="millrace-shared-"))
    return "file://" + _own[0]


@contextlib.contextmanager
def _releasing(spark: SparkSession):
    """While it holds, Spark drops the shuffle files of a query once the query has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, a lost executor
    costs no recomputation of what came before, and earlier shuffle files can go."""
    spark = df.sparkSession
    path = shared_path(spark)
    written(df.write.format("parquet"), spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def shared_path(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def written(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Write to a place that goes when the driver ends."""
    with _releasing(spark):
        writer.save(path)
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def settled_bytes(df: DataFrame) -> int:
    """Bytes of a settled table as it lies on disk."""
    where, fs = _file_system(df.sparkSession, df.settled_at)
    return int(fs.getContentSummary(where).getLength())


def drop(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more. What is not dropped goes when the
    driver ends."""
    for df in tables:
        if df is not None:
            where, fs = _file_system(df.sparkSession, df.settled_at)
            fs.delete(where, True)


def dealt_over(spark: SparkSession, size: int, of: int = 16 << 20) -> int:
    """Tasks for work on `size` bytes: one for each `of` bytes, and no fewer than the cluster
    deals a shuffle over, so that a task's share stays bounded as the input grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // of))


def buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Buckets for grouped work: some for each shuffle partition, which the cluster sizes
    to its input, so that the bytes of one bucket stay bounded as the input grows."""
    return max(32, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def range_bounds(df: DataFrame, col: str, n: int) -> list[int]:
    """At most n - 1 cut points that divide the values of an integer column into ranges of
    about equal row counts. A quantile sketch of fixed error: its size depends on n only."""
    # the sketch keeps its first and last entries exactly, so a few more probes cost nothing
    probes = [i / n for i in range(1, n)]
    if not probes:
        return []
    got = df.approxQuantile(col, probes, 1.0 / (4 * n))
    return sorted({int(np.floor(x)) for x in got})


def byte_bounds(df: DataFrame, col: str, size: Column, n: int) -> list[int]:
    """At most n - 1 cut points of an integer column between which the sums of `size` are about
    equal: rows are summed in four times as many ranges, and neighbouring ranges put together."""
    fine = range_bounds(df, col, 4 * n)
    sums = df.groupBy(range_bucket(F.col(col), fine).alias("_range")).agg(F.sum(size).alias("_size"))
    # one row for each range
    of = {r["_range"]: r["_size"] or 0 for r in sums.collect()}
    share, full, out = max(1, sum(of.values()) / n), 0, []
    for i, bound in enumerate(fine):
        full += of.get(i, 0)
        if full + of.get(i + 1, 0) / 2 >= share * (len(out) + 1):
            out.append(bound)
    return out


def range_bucket(col, bounds: list[int]):
    """Number of cut points below a value, found in two steps of about sqrt(n) comparisons;
    null values come before all others."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    lists = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    group = F.size(F.filter(heads, lambda x: x < col))
    inside = F.size(F.filter(F.element_at(lists, F.greatest(group, F.lit(1))), lambda x: x < col))
    return F.coalesce(F.greatest(group - 1, F.lit(0)) * step + inside, F.lit(0))


def number_rows(df: DataFrame, order: str, within: list[str], out: str, ties: list[str] | None = None) -> DataFrame:
    """Gapless numbers from 0 in the order of an integer column and of `ties`, separately for each value
    of `within`, without bringing such a group together: rows are numbered inside ranges of
    the order column, and each range starts where the ranges before it end."""
    n = buckets(df.sparkSession, 1)
    bounds = range_bounds(df, order, n)
    part = df.withColumn("_range", range_bucket(F.col(order), bounds))
    counts = part.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    starts = starts.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_range").alias("_w__range"), "_start")
    inner = Window.partitionBy(*within, "_range").orderBy(F.col(order).asc_nulls_first(), *(ties or []))
    numbered = part.withColumn("_in", F.row_number().over(inner) - 1)
    on = [numbered[c].eqNullSafe(starts[f"_w_{c}"]) for c in [*within, "_range"]]
    # the table of starts has one row per group and range: bounded by the bucket count
    joined = numbered.join(F.broadcast(starts), on)
    return joined.withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).select(*df.columns, out)
