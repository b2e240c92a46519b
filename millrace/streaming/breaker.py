"""The breaker and its window as operators over a table of outcomes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scan
from ..sources.resilience import Breaker


def failures_in_window(events: DataFrame, by: str, ts: str, failed: Column, seconds: int, parts: int | None = None) -> DataFrame:
    """At each event, the failures of its source in the `seconds` up to it; events without
    a time count among themselves. A frequent source is cut into slices: each failure then
    counts one from its time on and one less from when it leaves the window."""
    e = events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    span = seconds * 1_000_000
    points = scan.cut_points(e, [by], ["_at"], parts)
    if points is None:
        w = Window.partitionBy(by).orderBy("_at").rangeBetween(-span, 0)
        return e.withColumn("failures", F.count_if(failed).over(w)).drop("_at")
    there = e.withColumn("_by", F.when(failed, 1).otherwise(0).cast("long")).withColumn("_event", F.lit(True))
    gone = e.filter(failed & F.col("_at").isNotNull()).select(F.col(by), (F.col("_at") + span + 1).alias("_at"), F.lit(-1).cast("long").alias("_by"), F.lit(False).alias("_event"))
    both = there.unionByName(gone, allowMissingColumns=True).withColumn("_dated", F.col("_at").isNotNull())
    # rows without a time come first in a key's order: what they count stays among them
    undated = F.when(~F.col("_dated"), F.col("_by"))
    run = scan.running(both, by, "_at", peers=True, points=points, _all=scan.total(F.col("_by")), _undated=scan.total(undated))
    n = F.col("_all") - F.when(F.col("_dated"), F.coalesce("_undated", F.lit(0))).otherwise(0)
    return run.filter("_event").select(*[F.col(f"`{c}`") for c in events.columns], n.alias("failures"))


def states(events: DataFrame, by: str, ts: str, failed: str, breaker: Callable[[], Breaker] = Breaker) -> DataFrame:
    """H4: the breaker's state after each outcome, source by source in time order."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        b, out = breaker(), []
        f = f.sort_values([ts])
        for t, bad in zip(f[ts], f[failed], strict=True):
            now = pd.Timestamp(t).timestamp()
            if b.allow(now):
                (b.failure if bad else b.success)(now)
                out.append(b.state)
            else:
                out.append("refused")
        return pd.DataFrame({by: f[by], ts: f[ts], "state": out})

    kinds = {c.name: c.dataType.simpleString() for c in events.schema}
    return events.select(by, ts, failed).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {ts} {kinds[ts]}, state string")


def backoff_schedule(spark: SparkSession, initial: int, most: int, attempts: int, kind: str = "exponential") -> DataFrame:
    """H2 as a table: (attempt, delay_ms) without jitter."""
    n = F.col("id")
    raw = {"exponential": initial * F.pow(F.lit(2.0), n - 1), "linear": initial * n.cast("double"), "constant": F.lit(float(initial))}[kind]
    return spark.range(1, attempts + 1).select(n.alias("attempt"), F.least(raw, F.lit(float(most))).cast("long").alias("delay_ms"))
