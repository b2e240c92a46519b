"""Mergeable summaries (A10, A17): states of distinct counts, sets and quantiles that are kept in a
store by group, and put together over loads and groups without reading the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import Store

#: log2 of the registers of a distinct count: its relative standard error is 1.04 / 2^(LG / 2).
LG = 12
#: Accuracy of the quantiles: the error of a rank is about 2.3 / K.
K = 400


def distinct_error(deviations: float = 4.0) -> float:
    return deviations * 1.04 / 2 ** (LG / 2)


def rank_error(deviations: float = 2.0) -> float:
    return deviations * 2.3 / K


def summarise(df: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """One row for each group: rows, and the states of the distinct `item`s (as a count and as a
    set) and of the quantiles of `value`. Nulls enter neither; partial states combine before the shuffle."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(F.col(item), F.lit(LG)).alias("distinct_state"),
        F.theta_sketch_agg(F.col(item), F.lit(LG)).alias("set_state"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("quantile_state"),
    )


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """States of coarser groups, from those of finer ones or of several loads."""
    return states.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct_state").alias("distinct_state"),
        F.theta_union_agg("set_state").alias("set_state"),
        F.kll_merge_agg_double("quantile_state").alias("quantile_state"),
    )


def add_load(store: Store, load: DataFrame, by: list[str]) -> Store:
    """A store of states with those of one more load merged in; its records are one for each group."""
    new = load if store.table is None else store.scan().unionByName(load)
    got = merged(new, by)
    return Store(store.name).set(got, F.concat_ws("|", *by))


def estimates(states: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """What the states say: n, items (distinct), and q0, q1, ... of `quantiles`."""
    q = [F.kll_sketch_get_quantile_double("quantile_state", F.lit(p)).alias(f"q{i}") for i, p in enumerate(quantiles)]
    return states.select(*by, "n", F.hll_sketch_estimate("distinct_state").alias("items"), *q)


def common(states: DataFrame, by: str, one: str, other: str) -> DataFrame:
    """How many items two groups have in common: one row."""
    s = states.filter(F.col(by).isin(one, other)).groupBy().agg(F.theta_intersection_agg("set_state").alias("_s"))
    return s.select(F.theta_sketch_estimate("_s").alias("items"))
