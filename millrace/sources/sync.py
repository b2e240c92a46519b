"""Incremental scans (S9, T12): since formats and the watermark table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers below this are seconds, others milliseconds.
SECONDS_BELOW = 32503680000
SCHEMA = "key string, synced_at timestamp, record_count long, cursor string, mission string, execution_id string"


def format_since(ts: Column, fmt: str = "iso") -> Column:
    if fmt == "iso":
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if fmt == "unix":
        return F.unix_seconds(ts).cast("string")
    if fmt == "unix-ms":
        return F.unix_millis(ts).cast("string")
    if fmt == "date-only":
        return F.date_format(ts, "yyyy-MM-dd")
    raise ValueError(f"unknown since format: {fmt}")


def parse_since(s: Column) -> Column:
    """ISO text, seconds or milliseconds; NULL for anything else."""
    n = s.try_cast("long")
    unix = F.when(n < SECONDS_BELOW, F.timestamp_seconds(n)).otherwise(F.timestamp_millis(n))
    return F.when(n.isNotNull(), unix).otherwise(s.try_cast("timestamp"))


def checkpoint_key(source: str, endpoint: str) -> str:
    return f"{source}:{re.sub(r'[^A-Za-z0-9]+', '_', endpoint).strip('_')}"


class Watermarks:
    """One row per key: the point up to which a source has been read."""

    def __init__(self, spark: SparkSession, table: DataFrame | None = None):
        self.spark = spark
        self.table = table if table is not None else spark.createDataFrame([], SCHEMA)

    def last(self, key: str) -> str:
        """As text a filter can take; the epoch before the first read."""
        got = self.table.filter(F.col("key") == key).agg(F.max("synced_at").cast("string")).first()
        return got[0] or "1970-01-01 00:00:00"

    def since(self, df: DataFrame, key: str, column: str) -> DataFrame:
        """Rows later than the watermark; a literal, so that Spark pushes it to the scan."""
        return df.filter(F.col(column) > F.lit(self.last(key)).cast("timestamp"))

    def advance(self, key: str, df: DataFrame, column: str, mission: str = "") -> Watermarks:
        """With the latest row of df as the key's new watermark; an empty df moves nothing."""
        new = df.agg(F.max(column).alias("synced_at"), F.count(F.lit(1)).alias("record_count")).filter("synced_at is not null")
        new = new.select(F.lit(key).alias("key"), F.col("synced_at").cast("timestamp"), "record_count", F.lit(None).cast("string").alias("cursor"), F.lit(mission).alias("mission"), F.lit(None).cast("string").alias("execution_id"))
        both = self.table.unionByName(new)
        last = both.groupBy("key").agg(F.max_by(F.struct(*[c for c in both.columns if c != "key"]), "synced_at").alias("r")).select("key", "r.*")
        return Watermarks(self.spark, last)
