"""Sharding by jump consistent hashing: a key's shard is a function of the key and the
number of shards alone, without a table of the ring. One more shard takes from every old
one its fair part and moves no other row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as K
from .sparkit import number_rows


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of mixed 64-bit keys. Each key jumps ahead from bucket to bucket by its own
    pseudo-random sequence, in about ln(shards) steps; the last bucket in range is its."""
    state = keys.astype(np.uint64).copy()
    bucket = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        s = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        state[live] = s
        ahead = (bucket[live] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0))
        go = ahead < shards
        live = live[go]
        bucket[live] = ahead[go].astype(np.int64)
    return bucket


def _jumps(shards: int):
    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(jump(K.mix(key.to_numpy(np.int64).view(np.uint64)), shards).astype(np.int32))

    return of


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 1 (null: 1). The shard depends on the key and
    `shards` only; grown_shard is the one for a shard more. slot counts the rows of a shard
    from 0 in ascending key without a gap; rows of equal keys share a shard and take slots in
    the order of size, CRC and a hash of the text, so that only equal texts could swap. Keys
    are integers; a null key counts as key 0 and comes first. An empty table gives an empty
    result; columns not named are ignored.
    """
    d = docs.select(F.col(key).alias("_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("_crc"), F.xxhash64(text).alias("_tie"))
    k = F.coalesce(F.col("_id").cast("long"), F.lit(0).cast("long"))
    d = d.withColumn("_shard", _jumps(shards)(k)).withColumn("_grown", _jumps(shards + 1)(k)).withColumn("_ord", F.col("_id").cast("long"))
    d = number_rows(d, "_ord", ["_shard"], "_slot", ["_size", "_crc", "_tie"])
    return d.select(
        F.col("_id").alias(key),
        (F.col("_size") + 1).alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )
