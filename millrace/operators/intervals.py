"""Joins of intervals whose lengths differ widely (J2), without a width that is given.

Time is tiled at several widths, each `STEP` times the one before, from about the median length to
the greatest; an interval's own level is the finest whose tiles are at least as long as it is, so it
lies in two tiles at most. A pair meets at the coarser of its two levels: an interval is put into its
tiles at its own level and, to meet longer ones, at all coarser levels: a few rows whatever its length.
A pair that shares two tiles is kept in the one where the later of the two begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle

#: How much wider the tiles of a level are than those of the level below.
STEP = 8


def tile_widths(*sides: tuple[DataFrame, Column, Column]) -> list[int]:
    """Widths of the levels, from a sketch of the lengths: one row for each side."""
    least, most = None, 1
    for df, start, end in sides:
        length = (end - start).cast("long")
        mid, top = df.agg(F.percentile_approx(length, 0.5, 1000), F.max(length)).first()
        if top is not None:
            least = max(1, mid if least is None else min(least, mid))
            most = max(most, top)
    out = [least or 1]
    while out[-1] < most:
        out.append(out[-1] * STEP)
    return out


def overlapping(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], keys: list[str] | None = None, widths: list[int] | None = None) -> DataFrame:
    """Pairs of rows whose intervals [start, end] of whole numbers share a point and whose `keys`
    are equal. Ends belong to the interval; one that ends before it begins, or has a null end, is in
    no pair. Columns of both sides stay; their names differ, but for the keys."""
    (ls, le), (rs, re) = left_ends, right_ends
    l_, r_ = left.filter(F.col(ls) <= F.col(le)), right.filter(F.col(rs) <= F.col(re))
    w = widths or tile_widths((l_, F.col(ls), F.col(le)), (r_, F.col(rs), F.col(re)))
    width = F.array(*[F.lit(x).cast("long") for x in w])

    def tiled(df: DataFrame, s: str, e: str, levels: str) -> DataFrame:
        own = F.size(F.filter(F.slice(width, 1, len(w) - 1), lambda x: x < F.col(e) - F.col(s))) if len(w) > 1 else F.lit(0)
        first = own if levels != "above" else own + 1
        last = own if levels == "own" else F.lit(len(w) - 1)
        d = df.withColumn("_level", F.explode(F.when(first <= last, F.sequence(first, last))))
        wide = F.element_at(width, F.col("_level") + 1)
        return d.withColumn("_tile", F.explode(F.sequence(F.floor(F.col(s) / wide), F.floor(F.col(e) / wide))))

    # one side of each join is at its own level only: wide tiles hold no pairs of short intervals
    wide, out = F.element_at(width, F.col("_level") + 1), []
    for of_left, of_right in (("own", "from"), ("above", "own")):
        both = tiled(l_, ls, le, of_left).join(tiled(r_, rs, re, of_right), [*(keys or []), "_level", "_tile"])
        begins = F.floor(F.greatest(ls, rs) / wide) == F.col("_tile")
        out.append(both.filter(begins & (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le))).drop("_level", "_tile"))
    return out[0].unionByName(out[1])


def overlap_totals(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], keys: list[str] | None = None) -> DataFrame:
    """For each distinct interval of `right` (and its keys) that shares a point with rows of `left`: how
    many rows (`n`) and how many points they share in all (`shared`). Equal intervals of a side are one
    row of the join, those of `left` with their number, so its pairs grow with the distinct intervals
    and not with the product of the rows."""
    on = [*(keys or []), *right_ends]
    many = settle(left.groupBy(*(keys or []), *left_ends).agg(F.count(F.lit(1)).alias("_times")))
    pairs = overlapping(many, settle(right.select(*on).distinct()), left_ends, right_ends, keys)
    points = F.least(left_ends[1], right_ends[1]) - F.greatest(left_ends[0], right_ends[0]) + 1
    return pairs.groupBy(*on).agg(F.sum("_times").alias("n"), F.sum(points * F.col("_times")).cast("long").alias("shared"))
