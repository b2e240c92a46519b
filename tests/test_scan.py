"""Running values over hot keys: equal to plain windows, and spread over tasks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import joins, scan
from millrace.streaming import breaker

ROWS = 20_000


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows under key 0, a third under null, the rest under many; ties, null times and null values."""
    key = "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN NULL ELSE id % 1000 + 1 END AS k"
    t = "CASE WHEN id % 41 = 0 THEN NULL ELSE timestamp_seconds(1700000000 + (id * 7919) % 5000) END AS t"
    return spark.range(ROWS).selectExpr("id", key, t, "CASE WHEN id % 5 = 0 THEN id * 31 % 977 END AS v", "id % 7 = 0 AS bad").repartition(5)


def test_equal_to_plain_windows(hot):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    want = hot.select("id", F.row_number().over(w).alias("n"), F.sum(v).over(w).alias("s"), F.max(v).over(w).alias("hi"), F.min(v).over(w).alias("lo"), F.last(v, True).over(w).alias("l"), F.count_if(v > 500).over(w).alias("c"))
    assert scan.cut_points(hot, ["k"], ["t", "id"], 8) is not None
    got = scan.running(hot, "k", ["t", "id"], parts=8, n=scan.number(), s=scan.total(v), hi=scan.greatest(v), lo=scan.least(v), l=scan.last(v), c=scan.count(v > 500))
    assert got.columns == [*hot.columns, "n", "s", "hi", "lo", "l", "c"]
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_peers_count_together(hot):
    w = Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    want = hot.select("id", F.count(F.lit(1)).over(w).alias("n"))
    got = scan.running(hot, "k", "t", peers=True, parts=8, n=scan.number()).select("id", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_slice_is_above_three_times_the_share(hot):
    points = scan.cut_points(hot, ["k"], ["t", "id"], 16)
    sizes = [r["count"] for r in scan._sliced(hot, ["k"], ["t", "id"], points).groupBy("k", "_slice").count().collect()]
    assert points.count() == 2 and max(sizes) <= 3 * ROWS / 16
    assert points.agg(F.sum(F.size("_cuts"))).first()[0] <= 16


def test_rows_equal_in_the_order_stay_together(spark):
    d = spark.range(5000).selectExpr("1 AS k", "7 AS t", "id")
    got = scan.running(d, "k", "t", parts=8, n=scan.number())
    assert sorted(r.n for r in got.collect()) == list(range(1, 5001))


def test_empty_tables_and_own_names(hot):
    assert scan.running(hot.limit(0), "k", "t", n=scan.number()).count() == 0
    with pytest.raises(ValueError, match="_slice"):
        scan.running(hot.withColumn("_slice", F.lit(1)), "k", "t", n=scan.number())


def test_as_of_over_a_hot_key(hot):
    left = hot.filter("id % 2 = 0").select("id", "k", "t")
    right = hot.filter("id % 2 = 1").groupBy("k", F.col("t").alias("rt")).agg(F.max("id").alias("rid"))
    plain = joins.as_of(left, right, "k", "t", "rt", ["rid"], parts=1)
    cut = joins.as_of(left, right, "k", "t", "rt", ["rid"], parts=8)
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, plain.collect()))
    assert cut.filter("(k IS NULL OR t IS NULL) AND asof_rid IS NOT NULL").count() == 0
    brute = {}
    for r in right.filter("k = 0 AND rt IS NOT NULL").collect():
        brute[r.rt] = r.rid
    for r in cut.filter("k = 0 AND t IS NOT NULL AND id % 300 = 0").collect():
        at = max((x for x in brute if x <= r.t), default=None)
        assert r.asof_rid == (None if at is None else brute[at])


def test_failures_over_a_hot_key(hot):
    plain = breaker.failures_in_window(hot, "k", "t", F.col("bad"), 600, parts=1)
    cut = breaker.failures_in_window(hot, "k", "t", F.col("bad"), 600, parts=8)
    assert cut.columns == plain.columns
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, plain.collect()))
