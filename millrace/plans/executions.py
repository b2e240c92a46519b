"""Executions of missions that outlast their driver.

A table of stage states, in a folder for each execution, and beside it the stores that each stage wrote.
Stores are written before the state that names them, so a completed stage has its stores whole; what a
failed or interrupted stage wrote is named by no state and is not read. Every state is a row of its own:
the newest of a stage counts. After a stage its stores read what was written, so that a later stage, or
a lost executor, doesn't run the stages before it again."""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stores import Store
from ..sources.shared import file_system

if TYPE_CHECKING:
    from .mission import Mission

ROW = "mission string, of int, stage int, name string, status string, started double, ended double, error string, stores map<string,string>"


class Executions:
    """Kept under `path`, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- writing ------------------------------------------------------------------------
    def save(self, mission: Mission, before: dict[str, Store]) -> dict[str, str]:
        """Writes the stores that a stage changed: here its plans run, and here they fail. All
        are written before one of them is read from where it was written."""
        saved = {}
        for name, s in mission.stores.stores.items():
            if s is not before.get(name) and s.table is not None:
                saved[name] = f"{self.path}/stores/{mission.execution_id}/{uuid.uuid4().hex}"
                s.table.write.parquet(saved[name])
        for name, path in saved.items():
            mission.stores.load(name, path)
        return saved

    def add(self, mission: Mission, row: dict, saved: dict[str, str]) -> None:
        """The state of a stage, with where the stores are that it changed."""
        state = (row["mission"], len(mission.stages), row["stage"], row["name"], row["status"], row["started"], row["ended"], row["error"], saved)
        self.spark.createDataFrame([state], ROW).coalesce(1).write.mode("append").parquet(self._states(mission.execution_id))

    def delete(self, execution_id: str) -> None:
        for path in (self._states(execution_id), f"{self.path}/stores/{execution_id}"):
            where, fs = file_system(self.spark, path)
            fs.delete(where, True)

    def _states(self, execution_id: str) -> str:
        return f"{self.path}/states/execution_id={execution_id}"

    # --- reading ------------------------------------------------------------------------
    def states(self) -> DataFrame:
        """The newest state of each stage of each execution."""
        where, fs = file_system(self.spark, f"{self.path}/states")
        if not fs.exists(where):
            return self.spark.createDataFrame([], f"{ROW}, execution_id string")
        every = self.spark.read.schema(f"{ROW}, execution_id string").parquet(f"{self.path}/states")
        rest = [c for c in every.columns if c not in ("execution_id", "stage")]
        return every.groupBy("execution_id", "stage").agg(F.max_by(F.struct(*rest), "ended").alias("_s")).select("execution_id", "stage", "_s.*")

    def executions(self) -> DataFrame:
        """One row for each execution: its mission, stages and those done, when it began and was
        last heard of, and its status: completed, failed, or running (or ended with its driver)."""
        done = F.count_if(F.col("status").isin("completed", "skipped"))
        status = F.when(F.count_if(F.col("status") == "failed") > 0, "failed").when(done >= F.max("of"), "completed").otherwise("running")
        return self.states().groupBy("execution_id", "mission").agg(F.max("of").alias("stages"), done.alias("done"), F.min("started").alias("started"), F.max("ended").alias("ended"), status.alias("status"))

    def recent(self, mission: str | None = None, limit: int = 50) -> DataFrame:
        """The newest executions, of one mission or of all."""
        e = self.executions()
        return (e if mission is None else e.filter(F.col("mission") == mission)).orderBy(F.col("started").desc(), "execution_id").limit(limit)

    def resumable(self, mission: str) -> DataFrame:
        """Those of a mission that did not complete, newest first."""
        return self.executions().filter((F.col("mission") == mission) & (F.col("status") != "completed")).orderBy(F.col("started").desc(), "execution_id")

    def reopen(self, mission: Mission, execution_id: str | None = None) -> list[dict]:
        """Makes `mission` go on with an execution (the newest that did not complete, unless
        named): with its id and its stores. Gives the states to resume with, none if there is
        no such execution. An execution of other stages is refused."""
        if execution_id is None:
            found = self.resumable(mission.name).first()
            if found is None:
                return []
            execution_id = found.execution_id
        rows = sorted(self.states().filter(F.col("execution_id") == execution_id).collect(), key=lambda r: r.ended)  # a row a stage
        if not rows:
            raise LookupError(f"no execution {execution_id}")
        labels = [", ".join(s.actions) for s in mission.stages]
        if any(r.mission != mission.name or r.of != len(labels) or r["name"] != labels[r.stage] for r in rows):
            raise ValueError(f"execution {execution_id} is not of the stages of {mission.name}")
        for r in rows:
            for name, path in (r.stores or {}).items():
                mission.stores.load(name, path)
        mission.execution_id = execution_id
        keep = ("execution_id", "mission", "stage", "name", "status", "started", "ended", "error")
        return [{k: r[k] for k in keep} for r in rows]
