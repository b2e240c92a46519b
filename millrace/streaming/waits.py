"""Waiting for events (T1-T7) and windows over them (T13), in batch and in streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def collect_n(events: DataFrame, by: str, ts: str, tie: str, expected: int, timeout_ms: int | None = None, start: Column | None = None) -> DataFrame:
    """T1-T3 in batch: of each registration the first `expected` events, those later than
    start + timeout left out (start: its first event, unless given), with their number
    `nth` and `complete`, whether there were enough. Ranks past what is asked for are
    dropped before the shuffle, so a registration of very many events costs no more."""
    if timeout_ms is not None:
        first = events.groupBy(F.col(by).alias("_b")).agg(F.min(ts).alias("_s"))
        events = events.join(first, events[by] == first["_b"]).drop("_b")
        begin = F.col("_s") if start is None else start
        events = events.filter(F.col(ts) <= begin + F.make_dt_interval(secs=F.lit(timeout_ms / 1000))).drop("_s")
    w = Window.partitionBy(by).orderBy(ts, tie)
    ranked = events.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= expected)
    total = Window.partitionBy(by)
    return ranked.withColumn("complete", F.count(F.lit(1)).over(total) >= expected)


def event_filter(events: DataFrame, predicate: Column) -> DataFrame:
    """T4: an event for which the predicate has no value is kept."""
    return events.filter(F.coalesce(predicate, F.lit(True)))


def decode_body(raw: Column, content_type: Column) -> Column:
    """JSON and forms as VARIANT, anything else and what can't be parsed as text."""
    form = F.try_parse_json(F.to_json(F.str_to_map(raw, F.lit("&"), F.lit("="))))
    text = F.parse_json(F.concat(F.lit('"'), F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.coalesce(F.when(content_type.contains("json"), F.try_parse_json(raw)).when(content_type.contains("form-urlencoded"), form), text)


def sweep(events: DataFrame, registrations: DataFrame, now: Column) -> DataFrame:
    """Events whose registration has not expired."""
    live = registrations.filter(F.col("expires_at") > now).select(F.col("id").alias("_rid"))
    return events.join(live, events["registration_id"] == live["_rid"], "left_semi")


def windowed(events: DataFrame, ts: str, width: str, slide: str | None = None, late: str | None = None, by: list[str] | None = None, **aggs: Column) -> DataFrame:
    """Tumbling or sliding windows; with a watermark where `late` is given."""
    df = events.withWatermark(ts, late) if late else events
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(win, *(by or [])).agg(*[c.alias(k) for k, c in aggs.items()])


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None, **aggs: Column) -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.session_window(ts, gap), *by).agg(*[c.alias(k) for k, c in aggs.items()])


class _Collector(StatefulProcessor):
    """State of one registration: the events so far, until there are enough or time is up."""

    def __init__(self, expected: int, timeout_ms: int):
        self.expected, self.timeout = expected, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "body string")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return  # T3: what comes late is dropped
        have = [x[0] for x in self.seen.get()] if self.seen.exists() else []
        fresh = not have
        for f in rows:
            have += f["body"].tolist()
        if len(have) >= self.expected:
            self.seen.clear()
            self.done.update((True,))
            yield self._out(key, have[: self.expected], True)
            return
        self.seen.put([(x,) for x in have])
        if fresh and have:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.done.exists():
            have = [x[0] for x in self.seen.get()] if self.seen.exists() else []
            self.seen.clear()
            self.done.update((True,))
            yield self._out(key, have, False)

    def close(self) -> None:
        pass

    @staticmethod
    def _out(key, have: list[str], complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"registration": [str(key[0])], "n": [len(have)], "bodies": [have], "complete": [complete]})


def collect_stream(events: DataFrame, by: str, body: str, expected: int, timeout_ms: int = 300_000) -> DataFrame:
    """T1-T3 on a stream: one row for each registration when `expected` events are there, or
    at the timeout with what is there. Needs the RocksDB state store."""
    slim = events.select(F.col(by).cast("string").alias("registration"), F.col(body).cast("string").alias("body"))
    return slim.groupBy("registration").transformWithStateInPandas(_Collector(expected, timeout_ms), "registration string, n long, bodies array<string>, complete boolean", "append", "processingTime")


def store_stream(events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """T5: each micro-batch to a keyed write; the checkpoint makes it start where it left."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
