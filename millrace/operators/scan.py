"""Running values over keys of which one may hold a third of all rows.

A window gathers a key's rows in one task. Here a frequent key is cut into slices along its order, of
about an even share of the table each; a value is run inside each slice, and what the slices before it
come to, a row for each slice, is added. Cut points come from a sample of SAMPLE rows a slice: they
change the balance of the tasks, never a result. Keys of no more than a share are left whole."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import settle

#: Sampled rows for each slice.
SAMPLE = 64


@dataclass
class Running:
    """A value that can be run piece by piece: its aggregate over a slice (given the order), over
    a frame, and what two neighbouring pieces come to together (before, here)."""

    total: Callable[[Column], Column]
    over: Callable[[WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


def _plain(aggregate: Callable[[], Column], again: Callable[[Column], Column], joined: Callable[[Column, Column], Column]) -> tuple[Running, Callable]:
    return Running(lambda order: aggregate(), lambda w: aggregate().over(w), joined), again


def number() -> tuple[Running, Callable]:
    """The row's place among its key's rows, from 1."""
    return count(F.lit(True))


def count(condition: Column) -> tuple[Running, Callable]:
    return _plain(lambda: F.count_if(condition), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b)


def total(value: Column) -> tuple[Running, Callable]:
    """Null while there is no value. Of doubles, equal to a plain running sum but for rounding."""
    return _plain(lambda: F.sum(value), F.sum, lambda a, b: F.coalesce(a + b, a, b))


def greatest(value: Column) -> tuple[Running, Callable]:
    return _plain(lambda: F.max(value), F.max, lambda a, b: F.greatest(a, b))


def least(value: Column) -> tuple[Running, Callable]:
    return _plain(lambda: F.min(value), F.min, lambda a, b: F.least(a, b))


def last(value: Column) -> tuple[Running, Callable]:
    """The last value that isn't null."""
    whole = lambda order: F.max_by(value, F.when(value.isNotNull(), order))
    return Running(whole, lambda w: F.last(value, ignorenulls=True).over(w), lambda a, b: F.coalesce(b, a)), lambda c: F.last(c, ignorenulls=True)


def cut_points(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame | None:
    """(_k0.., _cuts): for each key of at least two shares of the rows (a share: all rows / parts),
    where its slices begin, ascending; None where there is no such key. It has at most parts / 2
    rows and `parts` cut points in all, whatever the table's size. Rows that are equal in the whole
    order stay in one slice: give an order that tells rows apart."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.count()
    if rows <= SAMPLE * parts:
        return None
    keys = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(by)]
    some = df.select(*keys, _point(order).alias("_o")).filter(F.rand(11) < SAMPLE * parts / rows)
    sampled = some.groupBy(*[f"_k{i}" for i in range(len(by))]).agg(F.array_sort(F.collect_list("_o")).alias("_s")).filter(F.size("_s") >= 2 * SAMPLE)
    every = F.transform(F.sequence(F.lit(SAMPLE), F.size("_s") - 1, F.lit(SAMPLE)), lambda i: F.get("_s", i))
    points = settle(sampled.select(*[f"_k{i}" for i in range(len(by))], F.array_distinct(every).alias("_cuts")))
    return None if points.isEmpty() else points


def _point(order: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])


def _sliced(df: DataFrame, by: list[str], order: list[str], points: DataFrame) -> DataFrame:
    """df with `_slice`: how many of its key's cut points a row has reached; null for other keys.
    Found among every m-th cut point and then among m of them."""
    m = max(2, math.isqrt(points.agg(F.max(F.size("_cuts"))).first()[0]))
    coarse = F.transform(F.sequence(F.lit(0), F.floor(F.size("_cuts") / m).cast("int")), lambda j: F.get("_cuts", j * m + (m - 1)))
    points = points.withColumn("_coarse", F.array_compact(coarse))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    d = df.join(F.broadcast(points), same, "left").withColumn("_o", _point(order))
    d = d.withColumn("_block", F.size(F.filter("_coarse", lambda c: c <= F.col("_o"))) * m)
    fine = F.size(F.filter(F.slice("_cuts", F.col("_block") + 1, F.lit(m)), lambda c: c <= F.col("_o")))
    d = d.withColumn("_slice", F.when(F.col("_cuts").isNotNull(), F.col("_block") + fine))
    return d.drop("_cuts", "_coarse", "_o", "_block", *[f"_k{i}" for i in range(len(by))])


def running(df: DataFrame, by: str | list[str], order: str | list[str], peers: bool = False, points: DataFrame | None = None, parts: int | None = None, **values: tuple[Running, Callable]) -> DataFrame:
    """df with a column for each of `values`, run over each key's rows in ascending order, nulls
    first; with `peers` rows equal in the order count together. A null key is a key. `points` are
    cut points made before. An empty table gives an empty one; df is read again for the totals of
    frequent keys, so it must give the same rows each time. Names that begin with `_k`, `_cuts`,
    `_coarse`, `_o`, `_block`, `_slice` or `_before` are this function's own and refused."""
    by, order = ([x] if isinstance(x, str) else list(x) for x in (by, order))
    own = [c for c in df.columns if c in ("_cuts", "_coarse", "_o", "_block", "_slice") or c.startswith("_before_") or (c.startswith("_k") and c[2:].isdigit())]
    if own:
        raise ValueError(f"columns {own} have names that running() uses")
    points = cut_points(df, by, order, parts) if points is None else points
    keys = [F.col(f"`{k}`") for k in by]

    def frame(*partition: Column) -> WindowSpec:
        w = Window.partitionBy(*partition).orderBy(*[F.col(f"`{c}`") for c in order])
        return (w.rangeBetween if peers else w.rowsBetween)(Window.unboundedPreceding, Window.currentRow)

    if points is None:
        return df.withColumns({name: v.over(frame(*keys)) for name, (v, _) in values.items()})
    d = _sliced(df, by, order, points)
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    sums = d.filter("_slice is not null").groupBy(*named, "_slice").agg(*[v.total(_point(order)).alias(f"_before_{name}") for name, (v, _) in values.items()])
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[f"_k{i}" for i in range(len(by))], F.col("_slice").alias("_k_slice"), *[again(F.col(f"_before_{name}")).over(earlier).alias(f"_before_{name}") for name, (_, again) in values.items()])
    # a row for each slice of a frequent key: at most 1.5 x parts
    inside = d.withColumns({name: v.over(frame(*keys, F.col("_slice"))) for name, (v, _) in values.items()})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    out = inside.join(F.broadcast(before), [*same, F.col("_slice") == F.col("_k_slice")], "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[v.joined(F.col(f"_before_{name}"), F.col(f"`{name}`")).alias(name) for name, (v, _) in values.items()])
