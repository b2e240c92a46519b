"""Requests that are asked once (S1, J6), whatever reads their answers and however often.

A request has a key, the hash of all that makes it up. Equal requests of many rows are put
together by a shuffle; those that the log doesn't hold yet are dealt over tasks and asked, and
their answers are a table before anything reads them. The rows then take their answers by a
join on the key. So two stores that are filled from one request, a condition on its answer and the
checkpoint that is taken from it all see one answer, and a plan that Spark runs twice asks nothing.

While a task asks, each answer is put down at once beside the log, as a line of the task's own file,
which is closed after each; where a storage can't append, as a file of its own. A task that runs in place
of a lost one reads those lines alongside its rows, as both come in the order of the keys. What a run
that failed has put down goes into the table before the next one asks, all else once the answers are in
the table. Two attempts of one task that run at the same time can still ask the same; a request that was
sent and whose answer never came is asked again.
"""

from __future__ import annotations

import heapq
import io
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, goes_at_exit, settle, shared_dir

#: Columns that a request adds to its rows.
KEY, PATH, PARAMS, BODY, HEADERS = REQUEST = ("_request", "_request_path", "_request_params", "_request_body", "_request_headers")
ANSWER = "_answer"
#: Bytes of answers that a task holds before it passes them on.
HELD = 4 << 20
_SCHEMA = "_request string, _answer string"

Ask = Callable[[str, str | None, str | None, str | None], str | None]


def request_key(*parts: Column) -> Column:
    """The hash of what makes up a request; a part that is null differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])), 256)


class RequestLog:
    """Answers by request key, in a folder of the shared storage. Without a path of its own a
    log goes when the driver ends; with one it serves a later run too, which then asks only what
    this one didn't get to."""

    def __init__(self, spark: SparkSession, path: str | None = None, tasks: int | None = None):
        self.spark, self.tasks = spark, tasks
        self.path = path.rstrip("/") if path else f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
        self.table, self.journal = f"{self.path}/answers", f"{self.path}/journal"
        self._lock, self._running = threading.Lock(), set()
        where, fs = file_system(spark, self.table)
        if not fs.exists(where):
            spark.createDataFrame([], _SCHEMA).write.parquet(self.table)
            if not path:
                goes_at_exit(spark, self.path)
        try:
            afs.FileSystem.from_uri(self.journal)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
            # a storage that only Spark can write to: what a lost task asked is asked again
            self.journal = None

    def answers(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.table)

    def ask(self, rows: DataFrame, ask: Ask) -> DataFrame:
        """`rows`, which have the columns REQUEST, with each one's answer as ANSWER (JSON; null
        where the answer was empty) instead of them. `ask` takes path, params, body, headers."""
        run = uuid.uuid4().hex
        with self._lock:
            self._take_over()
            self._running.add(run)
        try:
            rows = settle(rows, f"{self.path}/rows-{uuid.uuid4().hex}")
            wanted = rows.select(*REQUEST).dropDuplicates([KEY])
            new = wanted.join(self.answers(), KEY, "left_anti")
            tasks = self.tasks or max(self.spark.sparkContext.defaultParallelism, 1)
            # dealt by key, so that no task has a hot one: each key is there once
            dealt = new.repartition(tasks, KEY).sortWithinPartitions(KEY)
            asked = dealt.mapInPandas(_asking(ask, self.journal and f"{self.journal}/{run}"), _SCHEMA)
            asked.write.mode("append").parquet(self.table)
            self._forget(run)
        finally:
            with self._lock:
                self._running.discard(run)
        return rows.join(self.answers(), KEY, "left").drop(*REQUEST)

    def _take_over(self) -> None:
        """Puts into the table what runs that failed have put down."""
        left = [r for r in self._runs() if r not in self._running]
        if left:
            lines = self.spark.read.option("recursiveFileLookup", True).text([f"{self.journal}/{r}" for r in left])
            told = lines.mapInPandas(_read, _SCHEMA).dropDuplicates([KEY])
            told.join(self.answers(), KEY, "left_anti").write.mode("append").parquet(self.table)
            for r in left:
                self._delete(f"{self.journal}/{r}")

    def _forget(self, run: str) -> None:
        """What a run has put down, all of which the table holds."""
        with self._lock:
            if run in self._runs():
                self._delete(f"{self.journal}/{run}")
            if self._running == {run} and self.journal and not self._runs():
                self._delete(self.journal)

    def _runs(self) -> list[str]:
        where, fs = file_system(self.spark, self.journal) if self.journal else (None, None)
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs and fs.exists(where) else []

    def _delete(self, path: str) -> None:
        where, fs = file_system(self.spark, path)
        fs.delete(where, True)


def _asking(ask: Ask, journal: str | None) -> Callable:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put_down = _Journal(journal) if journal else None
        keys, got, held = [], [], 0
        for f in frames:
            for key, *request in f[list(REQUEST)].itertuples(index=False):
                one = lambda r=request: ask(*(None if pd.isna(x) else x for x in r))
                keys.append(key)
                got.append(put_down.once(key, one) if put_down else one())
                held += len(got[-1] or "")
                if held > HELD:
                    yield pd.DataFrame({KEY: keys, ANSWER: got}, dtype=object)
                    keys, got, held = [], [], 0
        if keys:
            yield pd.DataFrame({KEY: keys, ANSWER: got}, dtype=object)

    return rows


class _Journal:
    """The answers of one task. Its keys come in order."""

    def __init__(self, run: str):
        where = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.fs, self.base = afs.FileSystem.from_uri(f"{run}/{where}")
        self.fs.create_dir(self.base, recursive=True)
        files = [i.path for i in self.fs.get_file_info(afs.FileSelector(self.base)) if i.path.endswith(".lines")]
        self.before = heapq.merge(*[_lines(self.fs, p) for p in files], key=itemgetter(0))
        self.next = next(self.before, None)
        self.own = f"{self.base}/{uuid.uuid4().hex}.lines"
        self.fs.open_output_stream(self.own).close()
        try:
            self.fs.open_append_stream(self.own).close()
            self.appends = True
        except (pa.ArrowNotImplementedError, OSError):
            self.appends = False

    def once(self, key: str, ask: Callable[[], str | None]) -> str | None:
        """An answer that an attempt before has put down, else asked for and put down."""
        while self.next and self.next[0] < key:
            self.next = next(self.before, None)
        if self.next and self.next[0] == key:
            return self.next[1]
        place = f"{self.base}/{key}"
        if not self.appends and self.fs.get_file_info(place).type == afs.FileType.File:
            return next(_lines(self.fs, place))[1]
        got = ask()
        line = json.dumps([key, got]).encode() + b"\n"
        if self.appends:
            with self.fs.open_append_stream(self.own) as f:
                f.write(line)
        else:
            part = f"{place}.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(part) as f:
                f.write(line)
            self.fs.move(part, place)
        return got


def _lines(fs: afs.FileSystem, path: str) -> Iterator[list]:
    with fs.open_input_stream(path) as f:
        for line in io.BufferedReader(f):
            yield from _whole(line)


def _whole(line: str | bytes) -> list[list]:
    """[key, answer] of a line, or nothing of one that was cut off: no part of an array is JSON."""
    try:
        return [json.loads(line)]
    except ValueError:
        return []


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame([x for line in f["value"] for x in _whole(line)], columns=[KEY, ANSWER], dtype=object)
