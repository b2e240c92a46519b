"""Mixing sources to target weights by Poisson replication.

A source's rate is how often its documents should be repeated on average so that the
sources stand in the target proportions. Each document draws its number of copies from the
Poisson distribution with that mean: a uniform number hashed from seed and document is
looked up in the inverted distribution function. So the draw is the same in every run and
on every cluster, and adding documents changes no other document's draw. Copies are then
exploded and dealt out in the global order of another hash."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparkit import settle

#: Copies of a document that are made in one go where a source's rate is larger.
RUN = 1024


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts, joined by '|'."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _distribution(rate: pd.Series) -> pd.DataFrame:
    """Of the Poisson distribution of each mean, the least count that 52 bits of a uniform
    number can ask for, and the values of the distribution function from it on, as far as
    they can ask. Terms are multiples of the one at the mode, so no mean makes them vanish,
    and the places are about 24 roots of the mean."""
    low, cdf = [], []
    for x in rate:
        reach, mode = 12 * math.sqrt(x) + 24, math.floor(x)
        first, last = max(0, math.floor(x - reach)), math.ceil(x + reach)
        up = np.cumprod(x / np.arange(mode + 1, last + 1))
        down = np.cumprod(np.arange(mode, first, -1) / x) if mode else np.empty(0)
        c = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
        low.append(first)
        cdf.append(c / c[-1])
    return pd.DataFrame({"low": low, "cdf": cdf})


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None, power: float, ceiling: float | None) -> DataFrame:
    """(source, rate, distribution) of every source. Target shares are `weights` (sources without one get
    0), else each source's share of rows raised to `power` and normalised."""
    n = docs.groupBy(F.col(source).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        w = F.pow(F.col("_n").cast("double"), F.lit(power))
    else:
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col("_s").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(w)
    n = n.withColumn("_w", w)
    total = n.agg(F.sum("_n").alias("_all"), F.sum("_w").alias("_ws"))
    rate = F.when(F.col("_ws") > 0, F.col("_w") / F.col("_ws") * F.col("_all") / F.col("_n")).otherwise(0.0)
    # one row of totals: a product with it multiplies nothing
    n = n.crossJoin(F.broadcast(total)).select("_s", (rate if ceiling is None else F.least(rate, F.lit(ceiling))).alias("_rate"))
    poisson = F.pandas_udf(_distribution, "low long, cdf array<double>")
    return n.withColumn("_poisson", poisson("_rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = 7, key: str = "doc_id", source: str = "source", ceiling: float | None = None, deal: bool = True) -> DataFrame:
    """All columns of docs, once for each copy, with mix_rate, mix_copies, mix_copy (from
    0) and mix_order; documents with no copy are left out. Rows come in the order of
    mix_order, dealt out in ranges of it, unless `deal` is false.

    A null source is a source of its own. A null key draws as the empty string. Rows with
    equal keys draw alike and are each replicated. No rate is cut, unless a `ceiling` is given:
    sources that it cuts miss their weights. An empty table gives
    an empty result. A column of docs that has one of the names given here is replaced by it;
    columns whose names differ from it are kept, clashing or not.
    """
    names = ["mix_rate", "mix_copies", "mix_copy", "mix_order"]
    own = [c for c in docs.columns if c not in names]
    # one row for each source, as a table whose size Spark knows when it plans: it is
    # broadcast under Spark's own limit, and then no source's rows are gathered for the join
    r = settle(rates(docs, source, weights, power, ceiling))
    # the columns of docs in one, so that no name of theirs meets one of those used here
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in own]).alias("_own"), F.col(source).alias("_src"), F.col(key).alias("_key"))
    d = d.join(r, d["_src"].eqNullSafe(r["_s"])).drop("_s", "_src")
    k = F.coalesce(F.col("_key").cast("string"), F.lit(""))
    # inversion: how many values of the source's distribution the document's number reaches
    u = _uniform(F.lit(seed), k)
    reached = F.size(F.filter("_poisson.cdf", lambda c: c <= F.col("_u")))
    d = d.withColumn("_u", u).withColumn("mix_copies", (F.col("_poisson.low") + reached).cast("int")).drop("_poisson", "_u")
    first, end = F.lit(0), F.col("mix_copies")
    if not r.filter(F.col("_rate") > RUN).isEmpty():
        # many copies of a document are made in runs, and those by different tasks
        runs = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(0), F.floor((F.col("mix_copies") - 1) / RUN).cast("int")))
        d = d.withColumn("_run", F.explode(runs)).repartition(k, "_run")
        first = F.col("_run") * RUN
        end = F.least(first + RUN, end)
    copies = F.when(end > first, F.sequence(first, end - 1))
    d = d.withColumn("mix_copy", F.explode(copies))
    d = d.withColumn("mix_order", _uniform(F.lit(f"{seed}:order"), k, F.col("mix_copy"))).withColumnRenamed("_rate", "mix_rate")
    d = d.orderBy("mix_order", "_key", "mix_copy") if deal else d
    return d.select("_own.*", *names)
