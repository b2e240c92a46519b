"""The steps of an action as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import Semantics
from .schema import WILDCARD, Schema

Predicate = Callable[[Semantics], Column] | Column


def _cond(df: DataFrame, p: Predicate) -> Column:
    s = Semantics(df)
    return s.truthy(p(s) if callable(p) else p)


def where(df: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows whose predicate is truthy. Comparisons of numbers reach the scan."""
    s = Semantics(df)
    return df.filter(s.holds(predicate(s) if callable(predicate) else predicate))


def project(df: DataFrame, spread: bool = False, **fields: Column | Callable[[Semantics], Column]) -> DataFrame:
    """A new record from the given fields alone; with `spread` on top of the old."""
    s = Semantics(df)
    cols = {k: v(s) if callable(v) else v for k, v in fields.items()}
    if spread:
        return df.withColumns(cols)
    return df.select(*[c.alias(k) for k, c in cols.items()])


def unnest(df: DataFrame, array: Column | str, name: str, strict: bool = True) -> DataFrame:
    """One row for each element. A null array raises (strict) or has no rows."""
    a = F.col(array) if isinstance(array, str) else array
    if not isinstance(Semantics(df).type_of(a), T.ArrayType):
        raise TypeError(f"{name}: not a collection")
    if strict:
        a = F.when(a.isNull(), F.raise_error(F.lit(f"{name}: not a collection"))).otherwise(a)
    return df.withColumn(name, F.explode(a))


def first_array_field(df: DataFrame) -> str | None:
    """The field of a page that holds its rows."""
    return next((f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)), None)


@dataclass
class Variant:
    """One way of a transform: rows that fit schema and guard become these fields."""

    fields: dict[str, Column]
    schema: Schema = field(default_factory=lambda: WILDCARD)
    guard: Predicate | None = None


def apply_transform(df: DataFrame, variants: list[Variant], name: str = "transform", strict: bool = True) -> DataFrame:
    """Each row by the first variant that fits it. No fit raises, or (not strict)
    drops the row. All variants make the same fields."""
    if not variants or any(list(v.fields) != list(variants[0].fields) for v in variants):
        raise ValueError("a transform has variants, all with the same fields")
    out = None
    for v in variants:
        hit = v.schema.matches(df)
        if v.guard is not None:
            hit = hit & _cond(df, v.guard)
        s = F.struct(*[c.alias(k) for k, c in v.fields.items()])
        out = F.when(hit, s) if out is None else out.when(hit, s)
    if strict:
        out = out.otherwise(F.raise_error(F.lit(f"{name}: no variant fits")))
    return df.select(out.alias("_t")).filter(F.col("_t").isNotNull()).select("_t.*")


@dataclass
class Constraint:
    name: str
    predicate: Predicate
    severity: str = "error"


def check(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Df unchanged; running it raises at a row that fails a constraint of severity
    error."""
    ok = None
    for c in constraints:
        if c.severity == "error":
            step = F.when(~_cond(df, c.predicate), F.raise_error(F.concat(F.lit("constraint failed: "), F.lit(c.name))).cast("boolean"))
            ok = step if ok is None else F.coalesce(ok, step)
    return df if ok is None else df.filter(F.coalesce(ok, F.lit(True)))


def split_valid(df: DataFrame, constraints: list[Constraint]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all constraints of severity error, and the others with the
    name of the first that they fail."""
    failed = first_failed(df, constraints)
    marked = df.withColumn("_failed", failed)
    return marked.filter("_failed is null").drop("_failed"), marked.filter("_failed is not null")


def first_failed(df: DataFrame, constraints: list[Constraint]) -> Column:
    tests = [F.when(~_cond(df, c.predicate), F.lit(c.name)) for c in constraints if c.severity == "error"]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def count_failures(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """(constraint, severity, failures) for all constraints, in one pass."""
    one = df.agg(*[F.count_if(~_cond(df, c.predicate)).alias(f"c{i}") for i, c in enumerate(constraints)])
    rows = F.array(*[F.struct(F.lit(c.name).alias("constraint"), F.lit(c.severity).alias("severity"), F.col(f"c{i}").alias("failures")) for i, c in enumerate(constraints)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@dataclass
class Arm:
    """One arm of a match: a label, what rows it takes, and what becomes of them: continue,
    skip (drop), abort (raise), queue (reject table), retry or jump (for the caller)."""

    label: str
    schema: Schema = field(default_factory=lambda: WILDCARD)
    guard: Predicate | None = None
    directive: str = "continue"
    message: str = "aborted"


def route(df: DataFrame, arms: list[Arm], strict: bool = True, into: str = "_arm") -> DataFrame:
    """The label of the first arm that takes each row. No arm raises (strict), or is
    NULL. Rows of an abort arm raise when run."""
    out = None
    for a in arms:
        hit = a.schema.matches(df)
        if a.guard is not None:
            hit = hit & _cond(df, a.guard)
        label = F.lit(a.label) if a.directive != "abort" else F.raise_error(F.lit(a.message)).cast("string")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    if strict:
        out = out.otherwise(F.raise_error(F.lit("no arm matches")).cast("string"))
    return df.withColumn(into, out)


def flow(df: DataFrame, arms: list[Arm], strict: bool = True) -> dict[str, DataFrame]:
    """The rows that go on, and for each other directive its rows, all with _arm."""
    routed = route(df, arms, strict)
    out = {}
    for d in ("continue", "skip", "queue", "retry", "jump"):
        labels = [a.label for a in arms if a.directive == d]
        out[d] = routed.filter(F.col("_arm").isin(labels)) if labels else routed.limit(0)
    return out


def dead_letters(queued: DataFrame, reason: str, key: Column, attempts: DataFrame | None = None) -> DataFrame:
    """Reject records (key, reason, item, attempts): one for each key, counting on
    from what an earlier table of rejects has."""
    item = F.to_json(F.struct(*[F.col(c) for c in queued.columns if not c.startswith("_")]))
    new = queued.groupBy(key.cast("string").alias("key")).agg(F.lit(reason).alias("reason"), F.max(item).alias("item"), F.count(F.lit(1)).alias("attempts"))
    if attempts is None:
        return new
    both = new.unionByName(attempts)
    return both.groupBy("key").agg(F.max("reason").alias("reason"), F.max("item").alias("item"), F.sum("attempts").cast("long").alias("attempts"))
