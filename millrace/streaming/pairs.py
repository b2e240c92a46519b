"""Joins of two event streams within a time (T13), and events that come more than once (T5).

The same functions take tables and streams. Over streams Spark keeps an event only as long as
another could still meet it: both sides have watermarks, and the condition bounds the time between
them, so state is evicted on both sides and late events are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stores import Store
from ..sources.shared import settle


def followed_within(first: DataFrame, then: DataFrame, keys: list[str], first_ts: str, then_ts: str, within: str, late: str | None = None, how: str = "inner") -> DataFrame:
    """Pairs of an event and one of equal keys that follows it, not earlier and at most `within`
    later. Columns of both sides stay; those of `then` are named with `then_`, but for keys.
    With `late`, events that come later than that behind the newest of their stream may be dropped."""
    t = then.select(*keys, *[F.col(c).alias(f"then_{c}") for c in then.columns if c not in keys])
    a, b = first.alias("a"), t.alias("b")
    if late:
        a, b = first.withWatermark(first_ts, late).alias("a"), t.withWatermark(f"then_{then_ts}", late).alias("b")
    on = F.col(f"b.then_{then_ts}").between(F.col(f"a.{first_ts}"), F.col(f"a.{first_ts}") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    got = a.join(b, on, how)
    return got.select("a.*", *[f"b.then_{c}" for c in then.columns if c not in keys])


def once(events: DataFrame, key: str, ts: str, late: str | None = None) -> DataFrame:
    """Each key's first event (of a table: the earliest). Over a stream a key is remembered until
    the watermark has passed its event by `late`."""
    if events.isStreaming:
        return events.withWatermark(ts, late or "0 seconds").dropDuplicatesWithinWatermark([key])
    rest = [c for c in events.columns if c != key]
    first = events.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col(ts), F.to_json(F.struct(*rest)))).alias("_e"))
    return first.select(key, "_e.*").select(*events.columns)


def into_store(catalog, name: str, key: str, ts: str):
    """For foreachBatch: puts a batch's events into a keyed store. A batch that comes again after
    a failure writes the same records under the same keys."""

    def put(batch: DataFrame, _: int) -> None:
        # the batch is read once, and no later plan reaches back into it
        after = catalog[name].set(settle(batch), F.col(key), F.unix_micros(F.col(ts).cast("timestamp")))
        catalog.stores[name] = Store(name, settle(after.table))

    return put
