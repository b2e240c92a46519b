"""A store in buckets: what a write touches, and what it leaves."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators.buckets import BucketStore
from millrace.operators.stores import Store


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def made(spark, tmp_path):
    path = str(tmp_path / "s")
    store = BucketStore(spark, path, 8)
    assert store.set(spark.range(400).selectExpr("id", "id * 2 AS v", "'old' AS w"), F.col("id")) == list(range(8))
    return path, store


def test_untouched_buckets_keep_their_files(spark, made):
    path, store = made
    before = files(path)
    touched = store.upsert(spark.createDataFrame([(7, 99)], "id long, v long"), F.col("id"))
    after = files(path)
    assert len(touched) == 1 and len(before) == len(after) == 8
    assert {f for f in before ^ after} == {f for f in before | after if f"_bucket={touched[0]}/" in f and not (f in before and f in after)}
    assert len(before & after) == 7
    assert store.get(7).collect() == [(7, 99, "old")] and store.get(8).collect() == [(8, 16, "old")]


def test_a_write_reads_its_buckets_only(spark, made):
    _, store = made
    plan = store._read([3])._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "_bucket" in plan and store._read([3]).select(F.input_file_name()).distinct().count() == 1


def test_equal_to_a_store_in_memory(spark, made):
    _, store = made
    base = Store("m").set(spark.range(400).selectExpr("id", "id * 2 AS v", "'old' AS w"), F.col("id"))
    new = spark.range(380, 430).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE -id END AS v", "id % 2 = 0 AS more").unionByName(spark.createDataFrame([(380, 5, None)], "id long, v long, more boolean"))
    new = new.withColumn("n", F.when(F.col("v") == 5, 9).otherwise(1))
    store.upsert(new, F.col("id"), "n")
    want = base.upsert(new, F.col("id"), "n").scan()
    assert sorted(map(repr, store.store().scan().select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_a_bucket_can_lose_all_its_records(spark, made):
    path, store = made
    mine = store.store().table.filter(store._bucket(F.col("_key")) == 2).select("id")
    ids = [r.id for r in mine.collect()]
    gone = spark.createDataFrame([(i,) for i in [*ids, 10_000]], "id long")
    store.delete(gone, F.col("id"))
    left = {r.id for r in store.store().scan().collect()}
    assert left == set(range(400)) - set(ids)
    assert BucketStore(spark, path, 99).buckets == 8


def test_what_fails_leaves_the_table(spark, made):
    path, store = made
    before = files(path)
    with pytest.raises(TypeError, match="'v'"):
        store.upsert(spark.createDataFrame([(7, "x")], "id long, v string"), F.col("id"))
    with pytest.raises(Exception, match="broken"):
        store._rewrite(spark.createDataFrame([("7",)], "_key string"), lambda s: Store("x", s.table.withColumn("v", F.when(F.col("id") >= 0, F.raise_error(F.lit("broken")).cast("long")))))
    assert files(path) == before and store.store().scan().count() == 400


def test_empty_writes(spark, made, tmp_path):
    path, store = made
    before = files(path)
    none = spark.createDataFrame([], "id long, v long")
    assert store.upsert(none, F.col("id")) == [] == store.set(none, F.col("id")) == store.delete(none, F.col("id"))
    assert files(path) == before
    assert BucketStore(spark, str(tmp_path / "none")).delete(none, F.col("id")) == []
