"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkit import drop, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long): the component is named
    by its least node. Loops, repeated edges and nulls are left out; no edges give no rows.

    Alternates two star steps until nothing changes, which takes about the logarithm of the
    longest path. With edges kept as (smaller, larger), the large star hands every edge (a, b)
    to the least smaller neighbour of a; the small star leaves each b with its least neighbour
    and hands its other smaller neighbours to that. Each edge makes one edge, so a table of
    edges never grows. The least neighbours are aggregated, which combines before the shuffle,
    and are written as a table of one row for each node: joins with it are broadcast under
    Spark's own limit and split by AQE at a node of very many edges beyond it.
    """

    def least(e: DataFrame) -> DataFrame:
        return settle(e.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m")))

    e = settle(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        h = F.xxhash64("a", "b")
        mark = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        m1 = least(e)
        up = settle(e.join(m1, e["a"] == m1["n"], "left").select(F.coalesce("m", "a").alias("a"), "b"))
        m2 = least(up)
        other = F.col("a") != F.col("m")
        low = up.join(m2, up["b"] == m2["n"]).select(F.col("m").alias("a"), F.when(other, F.col("a")).otherwise(F.col("b")).alias("b"))
        after = settle(low.distinct())
        drop(e, m1, up, m2)
        e = after
    # stars now: each node but a component's least has one edge, to that
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
