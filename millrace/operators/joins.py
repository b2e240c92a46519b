"""Nested loops and lookups as joins (J1-J12), and grouping.

A loop in a loop is a join; a lookup in a loop is a semi, anti or left join with a side
reduced to one row per key. No side is broadcast by hint: Spark does it by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def loop_join(outer: DataFrame, inner: DataFrame, on: list[tuple[str, str]] | None = None, theta: Column | None = None) -> DataFrame:
    """Inner join on pairs of columns and/or any predicate; cross without either.
    An equality lets Spark hash or sort-merge; the rest of the predicate is tested in it."""
    cond = theta
    for a, b in on or []:
        eq = outer[a].eqNullSafe(inner[b])
        cond = eq if cond is None else cond & eq
    return outer.crossJoin(inner) if cond is None else outer.join(inner, cond)


def band_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= point <= high, as an equi-join of bins of `width`: an interval is
    listed in each bin that it touches. Fits intervals of a few bins; Spark sorts and
    merges instead of comparing all with all."""
    l = left.withColumn("_bin", F.floor(F.col(point) / width))
    r = right.withColumn("_rbin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return l.join(r, (F.col("_bin") == F.col("_rbin")) & F.col(point).between(F.col(low), F.col(high))).drop("_bin", "_rbin")


def exists(df: DataFrame, other: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """J7."""
    return df.join(other, _equal(df, other, on), "left_semi")


def missing(df: DataFrame, other: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """J8, D4."""
    return df.join(other, _equal(df, other, on), "left_anti")


def _equal(a: DataFrame, b: DataFrame, on: list[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for x, y in on:
        cond = cond & (a[x] == b[y])
    return cond


def first_match(df: DataFrame, other: DataFrame, on: tuple[str, str], order: str, into: str) -> DataFrame:
    """The first partner of each row in `order`, as a struct; null where there is none.
    The other side is cut to one row per key before the join, by map-side combining."""
    one = other.groupBy(F.col(on[1]).alias("_fk")).agg(F.min_by(F.struct("*"), order).alias(into))
    return df.join(one, df[on[0]] == one["_fk"], "left").drop("_fk")


def group_join(df: DataFrame, other: DataFrame, on: tuple[str, str], **aggs: Column) -> DataFrame:
    """Aggregates over each row's partners, computed once per key, then joined."""
    g = other.groupBy(F.col(on[1]).alias("_gk")).agg(*[c.alias(k) for k, c in aggs.items()])
    return df.join(g, df[on[0]] == g["_gk"], "left").drop("_gk")


def merge_full(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All keys; where both sides have a field, b's value unless it is null."""
    r = b.select(F.col(key).alias("_rk"), *[F.col(c).alias(f"_r_{c}") for c in b.columns if c != key])
    j = a.join(r, a[key] == r["_rk"], "full_outer")
    cols = [F.coalesce(a[key], F.col("_rk")).alias(key)]
    for c in dict.fromkeys([*a.columns, *b.columns]):
        if c != key:
            cols.append((F.coalesce(F.col(f"_r_{c}"), a[c]) if c in a.columns and c in b.columns else a[c] if c in a.columns else F.col(f"_r_{c}")).alias(c))
    return j.select(*cols)


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, right_ts: str, take: list[str], parts: int | None = None) -> DataFrame:
    """For each left row the last right row of the same key not later than it: one sort
    of both sides together, no pairs. A null key or time has no partner. A frequent key is cut
    into slices (`scan.running`)."""
    kind = right.select(F.struct(*take).alias("v")).schema[0].dataType
    a = left.withColumn("_t", F.col(ts)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(kind))
    b = right.filter(F.col(by).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(by), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*take).alias("_v"))
    u = a.unionByName(b, allowMissingColumns=True)
    out = scan.running(u, by, ["_t", "_side"], parts=parts, _m=scan.last(F.col("_v"))).filter("_side = 1")
    return out.select(*left.columns, *[F.col(f"_m.{c}").alias(f"asof_{c}") for c in take])


# --- grouping --------------------------------------------------------------------------------


def group_listed(df: DataFrame, key: str, keys: list, **aggs: Column) -> DataFrame:
    """One row for each listed key, also those without rows. Grouped first, so that the
    join is between groups."""
    spark = df.sparkSession
    listed = spark.createDataFrame([(k,) for k in keys], [key])
    g = df.filter(F.col(key).isin(keys)).groupBy(F.col(key).alias("_gk")).agg(*[c.alias(k) for k, c in aggs.items()])
    return listed.join(g, listed[key] == g["_gk"], "left").drop("_gk")


def group_by(df: DataFrame, key: str | list[str], **aggs: Column) -> DataFrame:
    """A8."""
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg(*[c.alias(k) for k, c in aggs.items()])


def count_by_value(df: DataFrame, col: str, values: list, prefix: str = "n_") -> DataFrame:
    """One row with a count for each value, 0 where there is none."""
    return df.agg(*[F.count_if(F.col(col) == v).alias(f"{prefix}{v}") for v in values])


def union_all(*dfs: DataFrame) -> DataFrame:
    """By name; missing columns are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def period_change(df: DataFrame, key: str, day: str, value: str, days: int = 7) -> DataFrame:
    """The value of `days` earlier, the change in percent and its trend."""
    old = df.select(F.col(key).alias("_pk"), F.date_add(F.col(day), days).alias("_pd"), F.col(value).alias("previous"))
    j = df.join(old, (df[key] == old["_pk"]) & (df[day] == old["_pd"]), "left").drop("_pk", "_pd")
    change = F.try_divide((F.col(value) - F.col("previous")) * 100.0, F.col("previous"))
    return j.withColumn("change_pct", change).withColumn("trend", F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat").otherwise("new"))
