"""Schedules (T8-T11): intervals, cron lines, one-shot times, and the loop that runs them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds of the interval units, and the bounds of cron's five fields.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def seconds(n: int, unit: str) -> int:
    return n * UNITS[unit.rstrip("s")]


def cron_field(text: str, low: int, high: int) -> frozenset[int]:
    """`*`, a, a-b, a,b, */n and a-b/n."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = high if step else a
        if not (low <= a <= b <= high) or (step and int(step) < 1):
            raise ValueError(f"bad cron field: {text}")
        out.update(range(a, b + 1, int(step) if step else 1))
    return frozenset(out)


@dataclass(frozen=True)
class Cron:
    """Minute, hour, day, month and weekday (0 is Sunday); day and weekday must both fit."""

    fields: tuple[frozenset[int], ...]

    @classmethod
    def parse(cls, line: str) -> Cron:
        parts = line.split()
        if len(parts) != 5:
            raise ValueError("a cron line has five fields")
        return cls(tuple(cron_field(p, *b) for p, b in zip(parts, BOUNDS, strict=True)))

    def fits(self, t: datetime) -> bool:
        now = (t.minute, t.hour, t.day, t.month, t.isoweekday() % 7)
        return all(x in f for x, f in zip(now, self.fields, strict=True))

    def next_after(self, t: datetime, days: int = 366 * 5) -> datetime | None:
        """The next fitting minute, by skipping days and hours that don't fit."""
        m, h, d, mo, wd = self.fields
        day = t.replace(second=0, microsecond=0) + timedelta(minutes=1)
        for _ in range(days):
            if day.day in d and day.month in mo and day.isoweekday() % 7 in wd:
                for hour in sorted(x for x in h if x >= day.hour):
                    for minute in sorted(m):
                        if hour > day.hour or minute >= day.minute:
                            return day.replace(hour=hour, minute=minute)
            day = day.replace(hour=0, minute=0) + timedelta(days=1)
        return None

    def column(self, ts: Column) -> Column:
        """Whether a timestamp's minute fits."""
        parts = (F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1)
        out = F.lit(True)
        for c, f, (low, high) in zip(parts, self.fields, BOUNDS, strict=True):
            if len(f) < high - low + 1:
                out = out & c.isin(sorted(f))
        return out


def cron_runs(spark: SparkSession, line: str, start: str, end: str) -> DataFrame:
    """All runs in [start, end): minutes by a range, filtered; no list on the driver."""
    epoch = lambda s: int(datetime.fromisoformat(s).replace(tzinfo=UTC).timestamp())
    minutes = spark.range(-(-epoch(start) // 60), -(-epoch(end) // 60))
    return minutes.select(F.timestamp_seconds(F.col("id") * 60).alias("run_at")).filter(Cron.parse(line).column(F.col("run_at")))


def interval_runs(df: DataFrame, ts: str, every: int) -> DataFrame:
    """T8 over a table of ticks: the first tick of each interval, which is when it is due."""
    slot = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / every)
    return df.groupBy(slot.alias("slot")).agg(F.min(ts).alias("run_at"), F.count(F.lit(1)).alias("ticks"))


@dataclass
class Job:
    name: str
    run: Callable[[], None]
    every: int | None = None
    cron: Cron | None = None
    at: datetime | None = None
    retries: int = 0
    pause: float = 0.0
    last: datetime | None = None
    running: bool = False
    runs: int = 0
    errors: list[str] = field(default_factory=list)

    def due(self, now: datetime) -> bool:
        if self.running:
            return False
        if self.every is not None:
            return self.last is None or (now - self.last).total_seconds() >= self.every
        if self.cron is not None:
            # without a run before it, the current minute decides
            nxt = self.cron.next_after(self.last) if self.last else now if self.cron.fits(now) else None
            return nxt is not None and nxt <= now
        return self.at is not None and self.last is None and now >= self.at


class Scheduler:
    """A tick runs what is due; a job that fails is tried again."""

    def __init__(self, jobs: list[Job], clock: Callable[[], datetime] = lambda: datetime.now(UTC), sleep: Callable[[float], None] = time.sleep):
        self.jobs, self.clock, self.sleep = jobs, clock, sleep

    def tick(self) -> list[str]:
        ran = []
        for j in self.jobs:
            now = self.clock()
            if j.due(now):
                j.running, j.last = True, now
                for n in range(j.retries + 1):
                    try:
                        j.run()
                        break
                    except Exception as e:  # a job's failure must not end the loop
                        j.errors.append(str(e))
                        if n < j.retries:
                            self.sleep(j.pause)
                j.running, j.runs = False, j.runs + 1
                ran.append(j.name)
        return ran

    def loop(self, ticks: int | None = None, every: float = 1.0) -> None:
        n = 0
        while ticks is None or n < ticks:
            self.tick()
            self.sleep(every)
            n += 1
