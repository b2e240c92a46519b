"""Interval joins, mergeable states, and pairs of streams against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.operators import intervals, sketches
from millrace.operators.stores import Catalog, Store
from millrace.streaming import pairs


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_overlapping_intervals_of_mixed_length(spark, keys):
    rnd = random.Random(5)

    def side(n):
        out = [(i, rnd.randrange(3), a := rnd.randrange(-500, 3000), a + rnd.choice([0, 1, 3, 40, 900, 2500])) for i in range(n)]
        return [*out, (n, 0, 5, 4), (n + 1, 1, None, 5), (n + 2, 1, 5, None)]

    a, b = side(150), side(120)
    left, right = spark.createDataFrame(a, "i long, k long, s long, e long"), spark.createDataFrame(b, "j long, k long, ps long, pe long")
    if not keys:
        right = right.drop("k")
    got = sorted((r.i, r.j) for r in intervals.overlapping(left, right, ("s", "e"), ("ps", "pe"), keys).collect())
    fine = lambda x: x[2] is not None and x[3] is not None and x[2] <= x[3]
    want = sorted((x[0], y[0]) for x in a for y in b if fine(x) and fine(y) and x[2] <= y[3] and y[2] <= x[3] and (not keys or x[1] == y[1]))
    assert got == want and len(got) > 100
    assert intervals.overlapping(left.limit(0), right, ("s", "e"), ("ps", "pe"), keys).count() == 0


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_totals_over_overlaps_join_equal_intervals_once(spark, monkeypatch, keys):
    rnd, joined, join = random.Random(6), [], intervals.overlapping

    def side(n):
        out = [(i, rnd.randrange(3), a := rnd.randrange(12), a + rnd.choice([0, 2, 40])) for i in range(n)]
        return [*out, (n, 0, 5, 4), (n + 1, 1, None, 5), (n + 2, 1, 5, None)]

    def seen(left, right, *rest):
        joined.extend((left.count(), right.count()))
        return join(left, right, *rest)

    monkeypatch.setattr(intervals, "overlapping", seen)
    a, b = side(900), side(700)
    left, right = spark.createDataFrame(a, "i long, k long, s long, e long"), spark.createDataFrame(b, "j long, k long, ps long, pe long")
    ends = ["ps", "pe"] if not keys else ["k", "ps", "pe"]
    got = right.join(intervals.overlap_totals(left, right, ("s", "e"), ("ps", "pe"), keys), ends)
    fine = lambda x: x[2] is not None and x[3] is not None and x[2] <= x[3]
    want = {}
    for y in filter(fine, b):
        met = [min(x[3], y[3]) - max(x[2], y[2]) + 1 for x in a if fine(x) and x[2] <= y[3] and y[2] <= x[3] and (not keys or x[1] == y[1])]
        if met:
            want[y[0]] = (len(met), sum(met))
    assert {r.j: (r.n, r.shared) for r in got.collect()} == want and len(want) > 500
    assert max(joined) <= 3 * 12 * 3 + 3


def test_the_overlap_query_joins_distinct_intervals(spark, tmp_path, monkeypatch):
    """Rows of few distinct intervals: 4e8 pairs as rows."""
    joined, join = [], intervals.overlapping

    def seen(left, right, *rest):
        joined.extend((left.count(), right.count()))
        return join(left, right, *rest)

    monkeypatch.setattr(intervals, "overlapping", seen)
    spark.range(20000).selectExpr("CAST(date_add(DATE'1990-01-01', CAST(id % 5 AS INT)) AS timestamp_ntz) AS l_shipdate", "CAST(1 AS double) AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(20000).selectExpr("id * 4000 AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = queries.interval_overlap(spark, str(tmp_path)).agg(F.count("p_partkey"), F.min("n"), F.max("n"), F.min("days"), F.max("days")).first()
    assert tuple(got) == (20000, 20000, 20000, 20000, 20000)
    assert joined == [5, 1]


def test_an_interval_makes_a_few_rows_whatever_its_length(spark):
    d = spark.createDataFrame([(0, 10**9), *[(i, i + 1) for i in range(200)]], "s long, e long")
    w = intervals.tile_widths((d, F.col("s"), F.col("e")))
    assert w[0] == 1 and w[-1] >= 10**9 and len(w) <= 12
    plan = intervals.overlapping(d, d.select(F.col("s").alias("a"), F.col("e").alias("b")), ("s", "e"), ("a", "b"))
    assert plan.count() == 201 * 201 - sum(abs(i - j) > 1 for i in range(200) for j in range(200))


def test_states_merge_over_loads(spark):
    rows = spark.range(20000).selectExpr("id % 3 AS g", "id % 10 AS day", "id % 4000 AS u", "CAST(id AS double) AS v")
    store = Store("s")
    for day in range(10):
        store = sketches.add_load(store, sketches.summarise(rows.filter(F.col("day") == day), ["g"], "u", "v"), ["g"])
    got = {r.g: r for r in sketches.estimates(store.scan(), ["g"], [0.1, 0.9]).collect()}
    assert set(got) == {0, 1, 2}
    for r in got.values():
        assert abs(r["items"] - 4000) < 4000 * sketches.distinct_error() and r["n"] in (6666, 6667)
        assert abs(r["q0"] - 2000) < 20000 * sketches.rank_error() and abs(r["q1"] - 18000) < 20000 * sketches.rank_error()
    sets = sketches.summarise(spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 'a' ELSE 'b' END AS g", "id % 1500 AS u", "1.0 AS v"), ["g"], "u", "v")
    assert abs(sketches.common(sets, "g", "a", "b").first()[0] - 1000) < 100


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_pairs_of_streams_equal_the_batch_and_forget(spark, tmp_path):
    """Hour by hour, a file each; what could meet nothing any more leaves the state."""
    schema = "id long, u long, ts timestamp"
    rows = spark.range(2400).selectExpr("id", "id * 7 % 5 AS u", "timestamp_seconds(1704067200 + id * 60) AS ts")
    clicks, buys = rows.filter("id % 2 = 0"), rows.filter("id % 3 = 0")
    for name, d in (("clicks", clicks), ("buys", buys)):
        for h in range(8):
            d.filter((F.col("id") >= h * 300) & (F.col("id") < h * 300 + 300)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    join = lambda a, b: pairs.followed_within(a, b, ["u"], "ts", "ts", "10 MINUTES", "5 minutes")
    want = sorted((r.id, r.then_id) for r in join(clicks, buys).collect())
    q = join(stream(spark, str(tmp_path / "clicks"), schema), stream(spark, str(tmp_path / "buys"), schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = sorted((r.id, r.then_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert got == want and len(got) > 1000
    assert kept and kept[-1] < 600  # of 2000 rows


def test_events_that_come_again(spark, tmp_path):
    schema = "id long, u long, ts timestamp"
    first = spark.range(100).selectExpr("id", "id % 10 AS u", "timestamp_seconds(1704067200 + id) AS ts")
    for _ in range(2):
        first.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    c = Catalog(spark)
    q = pairs.once(stream(spark, str(tmp_path / "in"), schema), "id", "ts", "1 hour").writeStream.foreachBatch(pairs.into_store(c, "seen", "u", "ts")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(p["numInputRows"] for p in q.recentProgress) == 200
    assert {r.u: r.id for r in c["seen"].scan().collect()} == {u: 90 + u for u in range(10)}
    assert sorted(r.id for r in pairs.once(first.unionByName(first), "u", "ts").collect()) == list(range(10))
