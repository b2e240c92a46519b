"""A store on disk in buckets by key, of which a write rewrites only those that it touches.

The table is parquet, partitioned by the bucket of the key's hash; a store has one row for a key, so
buckets are even whatever the records. A write reads the buckets of its keys (partition pruning), merges
as a store in memory does, and replaces them by dynamic partition overwrite: files of other buckets are
neither read nor moved. Tasks write beside the table and Spark puts buckets in place once all have ended,
so a failed or repeated task, or a lost executor, leaves the table as it was; a driver that ends while it
moves them may leave some buckets old or missing (their files are still in the staging folder). There is one writer at a time; who reads asks for `store()` anew
after a write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import Semantics
from ..sources.shared import file_system, settle
from .stores import KEY, SEQ, Store

OF, BUCKET = "_of", "_bucket"


class BucketStore:
    """A store at `path`. The number of buckets is fixed by its first write: about the rows that are
    to come divided by those that one task should merge."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._found() or buckets

    def _found(self) -> int | None:
        where, fs = file_system(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return next((int(n.split("=")[1]) for n in names if n.startswith(f"{OF}=")), None)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, only: list[int] | None = None) -> DataFrame | None:
        if self._found() is None:
            return None
        df = self.spark.read.option("mergeSchema", True).parquet(self.path)
        df = df if only is None else df.filter(F.col(BUCKET).isin(only))
        return df.filter(F.col(KEY).isNotNull()).drop(OF, BUCKET)

    def store(self) -> Store:
        """All records, as a Store to read from."""
        return Store(self.path, self._read())

    def get(self, key) -> DataFrame:
        """K8: the record of a key; reads one bucket."""
        only = self.spark.range(1).select(self._bucket(F.lit(str(key)))).first()[0]
        return Store(self.path, self._read([only])).get(key)

    def set(self, df: DataFrame, key: Column | None = None, seq: Column | str | None = None, partial: bool | None = None) -> list[int]:
        """K1-K3: whole records by key, the last write of a key wins. Returns the buckets rewritten."""
        new = settle(Store(self.path)._incoming(df, key, seq, partial))
        return self._rewrite(new, lambda s: s.set(new, F.col(KEY), SEQ))

    def upsert(self, df: DataFrame, key: Column | None = None, seq: Column | str | None = None, partial: bool | None = None) -> list[int]:
        """K4: fields that a write has overwrite, the others stay; a new column is null in what is
        there. A column of another type than the table's raises before anything is written."""
        new = settle(Store(self.path)._incoming(df, key, seq, partial))
        return self._rewrite(new, lambda s: s.upsert(new, F.col(KEY), SEQ))

    def delete(self, keys: DataFrame, key: Column) -> list[int]:
        """K9: without the rows whose keys `keys` has; keys that aren't there change nothing."""
        gone = settle(keys.select(Semantics(keys).string(key, "undefined").alias(KEY)))
        if self._found() is None:
            return []
        return self._rewrite(gone, lambda s: s.delete(gone, F.col(KEY)))

    def _rewrite(self, changed: DataFrame, change: Callable[[Store], Store]) -> list[int]:
        # at most one number for each bucket
        touched = sorted(r[0] for r in changed.select(self._bucket(F.col(KEY))).distinct().collect())
        if not touched:
            return []
        old = self._read(touched)
        if old is not None:
            was = {f.name: f.dataType for f in old.schema}
            other = [f.name for f in changed.schema if was.get(f.name, f.dataType) != f.dataType]
            if other:
                raise TypeError(f"columns {other} have other types in {self.path}")
        rows = change(Store(self.path, old)).table.withColumn(BUCKET, self._bucket(F.col(KEY)))
        # a row without a key for each bucket: one that loses all its records is replaced too
        marks = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int")
        rows = rows.unionByName(marks, allowMissingColumns=True).withColumn(OF, F.lit(self.buckets))
        # all of a bucket goes to one task, which writes one file
        out = rows.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(OF, BUCKET).parquet(self.path)
        return touched
