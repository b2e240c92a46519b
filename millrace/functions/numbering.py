"""Gapless numbers for the rows of a table in the order of a column, without a global window."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, order: str, out: str = "n", ranges: int | None = None) -> DataFrame:
    """df with `out`, from 0, in ascending order of a numeric column; nulls come first, equal
    values in no fixed order. Rows are numbered inside ranges of the column, which start where
    the ranges before them end. Their cut points come from a quantile sketch and their sizes
    from one aggregation: what is broadcast has a row for each range."""
    n = ranges or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    cuts = [c for c in cuts if not math.isnan(c)]
    if not cuts:
        place = F.lit(0)
    else:
        place = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order).cast("double"))), F.lit(0))
    d = df.withColumn("_range", place)
    sizes = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first())) - 1
    d = d.withColumn("_in", inside).join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    return d.withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop("_range", "_in", "_r", "_start")
