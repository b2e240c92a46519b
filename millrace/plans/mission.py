"""Missions (P1-P13): actions that build DataFrames, run as stages on the driver.

An action is a function of a context; what it returns is its response. Stages run in order;
the actions of a parallel stage run on threads, so that Spark schedules their jobs together.
What they write to stores is applied in the order in which they are declared."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stores import Catalog
from ..sources.resilience import Backoff
from .executions import Executions

STATE = "execution_id string, mission string, stage int, name string, status string, started double, ended double, error string"


class Skip(Exception):
    """P5: leave the rest of the action."""


class Abort(Exception):
    """The mission fails."""


class Retry(Exception):
    """Run the action again, after a pause."""


class Jump(Exception):
    """Run another action first, then go on or run this one again."""

    def __init__(self, action: str, then: str = "continue"):
        super().__init__(action)
        self.action, self.then = action, then


@dataclass
class Write:
    store: str
    df: DataFrame
    key: Column | None = None
    seq: str | None = None
    upsert: bool = False
    partial: bool | None = None


class Context:
    """What an action sees: stores, variables bound by it or before it, the response."""

    def __init__(self, mission: Mission, variables: dict | None = None):
        self.spark, self.stores, self.dry_run = mission.spark, mission.stores, mission.dry_run
        self.variables = dict(variables or {})
        self.response: DataFrame | None = None
        self.writes: list[Write] = []

    def let(self, name: str, value) -> None:
        self.variables[name] = value

    def store(self, name: str, df: DataFrame, key: Column | None = None, seq: str | None = None, upsert: bool = False, partial: bool | None = None) -> None:
        self.writes.append(Write(name, df, key, seq, upsert, partial))

    def read(self, name: str) -> DataFrame:
        return self.stores[name].scan()


@dataclass
class Action:
    name: str
    run: Callable[[Context], DataFrame | None]
    mock: Callable[[Context], DataFrame] | None = None
    backoff: Backoff = field(default_factory=Backoff)


@dataclass
class Stage:
    """One action or, in parallel, several; run if `when` is true or missing."""

    actions: list[str]
    when: Callable[[Mission], bool] | None = None
    fail_fast: bool = False


class Mission:
    def __init__(self, name: str, spark: SparkSession, actions: list[Action], stages: list[Stage], stores: Catalog | None = None, dry_run: bool = False, on_event: Callable[[str, dict], None] | None = None, concurrency: int = 8):
        self.name, self.spark, self.stages = name, spark, stages
        self.actions = {a.name: a for a in actions}
        self.stores = stores or Catalog(spark)
        self.dry_run, self.emit, self.concurrency = dry_run, on_event or (lambda kind, info: None), concurrency
        self.state: list[dict] = []
        self.execution_id = uuid.uuid4().hex
        self.executions: Executions | None = None
        self.marks = None  # the checkpoints of requests, once it has run
        self.validate(len(actions))

    def validate(self, n: int) -> None:
        """Names are unique and exist."""
        if len(self.actions) != n:
            raise ValueError("two actions have one name")
        unknown = [a for s in self.stages for a in s.actions if a not in self.actions]
        if unknown:
            raise ValueError(f"unknown actions: {unknown}")

    def resume_point(self) -> int:
        """P10: the first stage that is neither completed nor skipped; -1 if there is none."""
        done = {r["stage"] for r in self.state if r["status"] in ("completed", "skipped")}
        return next((k for k in range(len(self.stages)) if k not in done), -1)

    def run(self, resume: list[dict] | None = None, executions: Executions | None = None) -> Mission:
        """`resume` has the states of stages to go on from; `executions` keeps states and stores
        stage by stage, but not those of a dry run."""
        self.state = list(resume or [])
        self.executions = None if self.dry_run else executions
        start = self.resume_point() if resume else 0
        self.emit("mission.start", {"name": self.name})
        for k in range(start if start >= 0 else len(self.stages), len(self.stages)):
            stage = self.stages[k]
            began = time.time()
            before = dict(self.stores.stores)
            saved: dict[str, str] = {}
            label = ", ".join(stage.actions)
            if stage.when and not stage.when(self):
                self._note(k, label, "skipped", began)
                continue
            try:
                self._stage(stage)
                if self.executions is not None:
                    saved = self.executions.save(self, before)
            except Exception as e:
                self._note(k, label, "failed", began, str(e))
                raise
            self._note(k, label, "completed", began, saved=saved)
        self.emit("mission.end", {"name": self.name})
        return self

    def _note(self, stage: int, name: str, status: str, began: float, error: str | None = None, saved: dict[str, str] | None = None) -> None:
        row = {"execution_id": self.execution_id, "mission": self.name, "stage": stage, "name": name, "status": status, "started": began, "ended": time.time(), "error": error}
        if self.executions is not None:
            self.executions.add(self, row, saved or {})
        self.state = [r for r in self.state if r["stage"] != stage] + [row]
        self.emit(f"stage.{status}", row)

    def _stage(self, stage: Stage) -> None:
        if len(stage.actions) == 1:
            self._apply(self._action(stage.actions[0]))
            return
        # All run even if one fails, unless told to fail fast
        with ThreadPoolExecutor(self.concurrency) as pool:
            jobs = [pool.submit(self._action, a) for a in stage.actions]
            errors = []
            for name, job in zip(stage.actions, jobs, strict=True):
                if error := job.exception():
                    errors.append(f"{name}: {error}")
                    if stage.fail_fast:
                        for j in jobs:
                            j.cancel()
                        break
        if errors:
            raise Abort("; ".join(errors))
        for job in jobs:
            self._apply(job.result())

    def _action(self, name: str, depth: int = 0) -> Context:
        action = self.actions[name]
        for n in range(1, action.backoff.attempts + 2):
            ctx = Context(self)
            run = action.mock if self.dry_run else action.run
            if run is None:  # P13: a dry run does nothing that it has no mock for
                self.emit("action.planned", {"name": name})
                return ctx
            try:
                ctx.response = run(ctx)
            except Skip:
                pass
            except Retry:
                if n > action.backoff.attempts:
                    raise
                time.sleep(action.backoff.delay(n) / 1000)
                continue
            except Jump as j:
                if depth > 10:
                    raise
                self._apply(self._action(j.action, depth + 1))
                if j.then == "retry":
                    continue
            return ctx
        raise Abort(f"{name}: tried too often")

    def _apply(self, ctx: Context) -> None:
        for w in ctx.writes:
            if self.dry_run:
                self.emit("store.planned", {"store": w.store})
                continue
            self.stores.write(w.store, w.df, w.key, w.seq, w.upsert, w.partial)

    def audit(self) -> DataFrame:
        """The stages' states as a table."""
        return self.spark.createDataFrame([tuple(r[c.split()[0]] for c in STATE.split(", ")) for r in sorted(self.state, key=lambda r: r["stage"])], STATE)


def progress(states: DataFrame) -> DataFrame:
    """Per mission, stages by status and the share that is done."""
    done = F.count_if(F.col("status").isin("completed", "skipped"))
    return states.groupBy("mission").agg(
        F.count(F.lit(1)).alias("stages"),
        done.alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.floor(done * 100 / F.count(F.lit(1))).cast("long").alias("percent"),
    )


def latest(states: DataFrame, by: str, order: str) -> DataFrame:
    """The newest row of each group, by map-side combining."""
    rest = [c for c in states.columns if c != by]
    return states.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(by, "_r.*")


def newest(states: DataFrame, order: str, limit: int = 50) -> DataFrame:
    """W3."""
    return states.orderBy(F.col(order).desc()).limit(limit)
