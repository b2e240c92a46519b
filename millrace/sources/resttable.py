"""Tables behind a REST interface of rows (S13, K14), as a Spark data source.

    register(spark)
    spark.read.format("resttable").schema("id long, name string").option("url", u).option("table", "users").load()
    df.write.format("resttable").option("url", u).option("table", "users").mode("append").save()
    spark.readStream.format("resttable").option("follow", "seq")...

Reading: comparisons of Spark's filters travel as `column=operator.value`, only the columns of the
schema are asked for, and the rows come in parts of about `rows` each: key ranges whose ends the
source finds by asking for every `rows`-th key, so that a part costs no more the farther back it is.

Writing: tasks send their rows to a table beside the real one, marked with the write's number; when
all have ended, one call merges them by key, and if any failed, they are deleted. A task's rows
bear its attempt's number, and only attempts that Spark counts are merged, so a lost executor's
rows and those of a task that ran twice are never seen.

Streaming: offsets are values of a growing column. A batch is all rows beyond the last offset up
to the greatest value seen when it is planned; Spark keeps the offsets in its checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from decimal import Decimal
from urllib.parse import quote, urlencode

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .resilience import Client

#: Option that makes Spark hand its filters to a Python source.
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Rows that one request carries.
BATCH = 500

# Filters as the interface names them.
_COMPARED = {D.EqualTo: "eq", D.GreaterThan: "gt", D.GreaterThanOrEqual: "gte", D.LessThan: "lt", D.LessThanOrEqual: "lte"}
_PATTERNS = {D.StringStartsWith: "{}*", D.StringEndsWith: "*{}", D.StringContains: "*{}*"}


def register(spark: SparkSession) -> None:
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(RestTable)


def _plain(v: object) -> object:
    """A value as JSON and addresses have it."""
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, Decimal):
        return str(v)
    return v.asDict(recursive=True) if isinstance(v, T.Row) else v


def _word(v: object) -> str:
    v = _plain(v)
    return str(v).lower() if isinstance(v, bool) else str(v)


def condition(f: D.Filter) -> tuple[str, str] | None:
    """A filter of one top-level column as (column, `operator.value`), or None if the interface
    has none that means the same."""
    if isinstance(f, D.Not):
        inner = condition(f.child) if isinstance(f.child, (D.EqualTo, D.In, D.IsNull)) else None
        return None if inner is None else (inner[0], f"not.{inner[1]}")
    if not hasattr(f, "attribute") or len(f.attribute) != 1:
        return None
    name = f.attribute[0]
    if type(f) in _COMPARED:
        return name, f"{_COMPARED[type(f)]}.{_word(f.value)}"
    if isinstance(f, D.In):
        return name, "in.(" + ",".join('"' + _word(v).replace("\\", "\\\\").replace('"', '\\"') + '"' for v in f.value) + ")"
    if isinstance(f, (D.IsNull, D.IsNotNull)):
        return name, "is.null" if isinstance(f, D.IsNull) else "not.is.null"
    if type(f) in _PATTERNS and not set(f.value) & set("*%_\\"):
        return name, f"like.{_PATTERNS[type(f)].format(f.value)}"
    return None


class _Table:
    """Requests to one table. Options: url, table, key (id), apiKey, profile, rows."""

    def __init__(self, options: dict) -> None:
        o = {k.lower(): v for k, v in dict(options).items()}
        self.url, self.table, self.key = o["url"].rstrip("/"), o["table"], o.get("key", "id")
        self.rows, self.follow = int(o.get("rows", 10_000)), o.get("follow")
        self.stage, self.merge = o.get("stage", f"{self.table}_stage"), o.get("merge", f"rpc/merge_{self.table}")
        self.headers = {}
        if "apikey" in o:
            self.headers |= {"apikey": o["apikey"], "Authorization": f"Bearer {o['apikey']}"}
        if "profile" in o:
            self.headers |= {"Accept-Profile": o["profile"], "Content-Profile": o["profile"]}

    def ask(self, verb: str, path: str, query: list[tuple[str, str]] | None = None, body: object = None, prefer: str | None = None) -> object:
        client = Client(self.url, {**self.headers, **({"Prefer": prefer} if prefer else {})})
        place = f"/{quote(path)}" + (f"?{urlencode(query)}" if query else "")
        got = client.request(verb, place, body=body)
        if isinstance(got, dict) and ("message" in got or "code" in got):
            raise OSError(f"{verb} {path}: {got.get('message') or got}")
        return got


class _Range(D.InputPartition):
    """Rows with low <= column < high; an end that is None is open."""

    def __init__(self, column: str, low: object, high: object, after: object = None, upto: object = None):
        self.column, self.low, self.high, self.after, self.upto = column, low, high, after, upto

    def query(self) -> list[tuple[str, str]]:
        ends = (("gte", self.low), ("lt", self.high), ("gt", self.after), ("lte", self.upto))
        return [(self.column, f"{op}.{_word(v)}") for op, v in ends if v is not None]


class RestTable(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "resttable"

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> D.DataSourceStreamReader:
        return _StreamReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> D.DataSourceWriter:
        return _Writer(schema, self.options, overwrite)


def _read(table: _Table, schema: T.StructType, query: list[tuple[str, str]], part: _Range) -> Iterator[tuple]:
    """The rows of a part, in requests of at most BATCH rows, each beyond the last key of the one
    before it. Rows of an equal key that a request cuts are asked for once more by offset."""
    names = schema.fieldNames()
    wanted = ",".join(dict.fromkeys([*names, part.column]))
    at: list[tuple[str, str]] = []
    same, last = 0, None
    while True:
        q = [("select", wanted), *query, *part.query(), *at, ("order", part.column), ("limit", str(BATCH)), *([("offset", str(same))] if same else [])]
        got = table.ask("get", table.table, q) or []
        yield from (tuple(_typed(r.get(n), f.dataType) for n, f in zip(names, schema.fields, strict=True)) for r in got)
        if len(got) < BATCH:
            return
        keys = [r.get(part.column) for r in got]
        same = (same if keys[-1] == last else 0) + sum(k == keys[-1] for k in keys)
        last = keys[-1]
        at = [(part.column, f"gte.{_word(last)}")]


def _typed(v: object, t: T.DataType) -> object:
    if v is None:
        return None
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return datetime.fromisoformat(str(v))
    if isinstance(t, T.DateType):
        return date.fromisoformat(str(v)[:10])
    if isinstance(t, T.DecimalType):
        return Decimal(str(v))
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(t, T.StringType) and not isinstance(v, str):
        return json.dumps(v)
    return v


def _ranges(table: _Table, column: str, query: list[tuple[str, str]], after: object = None, upto: object = None) -> list[_Range]:
    """Parts of about `rows` rows, cut at values of a column."""
    cuts, at = [], []
    while True:
        q = [("select", column), *query, *_Range(column, None, None, after, upto).query(), *at, ("order", column), ("limit", "1"), ("offset", str(table.rows))]
        got = table.ask("get", table.table, q) or []
        if not got or (cuts and got[0][column] == cuts[-1]):
            break
        cuts.append(got[0][column])
        at = [(column, f"gte.{_word(cuts[-1])}")]
    ends = [None, *cuts, None]
    return [_Range(column, a, b, after, upto) for a, b in zip(ends, ends[1:], strict=False)]


class _Reader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.table, self.query = schema, _Table(options), []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            got = condition(f)
            if got is None:
                yield f
            else:
                self.query.append(got)

    def partitions(self) -> list[_Range]:
        return _ranges(self.table, self.table.key, self.query)

    def read(self, part: _Range) -> Iterator[tuple]:
        return _read(self.table, self.schema, self.query, part)


class _StreamReader(D.DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.table = schema, _Table(options)
        if not self.table.follow:
            raise ValueError("a stream of a table says which growing column to follow")

    def initialOffset(self) -> dict:
        return {"at": None}

    def latestOffset(self) -> dict:
        c = self.table.follow
        got = self.table.ask("get", self.table.table, [("select", c), (c, "not.is.null"), ("order", f"{c}.desc"), ("limit", "1")])
        return {"at": got[0][c] if got else None}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        if end["at"] is None or start["at"] == end["at"]:
            return []
        return _ranges(self.table, self.table.follow, [], start["at"], end["at"])

    def read(self, part: _Range) -> Iterator[tuple]:
        return _read(self.table, self.schema, [], part)

    def commit(self, end: dict) -> None:
        pass  # Spark's checkpoint has the offset; the table keeps its rows


class _Sent(D.WriterCommitMessage):
    def __init__(self, attempt: str, n: int):
        self.attempt, self.n = attempt, n


class _Writer(D.DataSourceWriter):
    """Upserts by key (mode append), or replaces the table (mode overwrite)."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names, self.table, self.overwrite = schema.fieldNames(), _Table(options), overwrite
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator[T.Row]) -> _Sent:
        attempt, n, batch = uuid.uuid4().hex, 0, []

        def send() -> None:
            if batch:
                self.table.ask("post", self.table.stage, body=list(batch), prefer="return=minimal")
                batch.clear()

        for r in rows:
            batch.append({**{k: _plain(r[k]) for k in self.names}, "_run": self.run, "_attempt": attempt})
            n += 1
            if len(batch) == BATCH:
                send()
        send()
        return _Sent(attempt, n)

    def commit(self, messages: list[_Sent | None]) -> None:
        sent = [m for m in messages if m is not None and m.n]
        done = {"run": self.run, "attempts": [m.attempt for m in sent], "rows": sum(m.n for m in sent), "key": self.table.key, "replace": self.overwrite}
        self.table.ask("post", self.table.merge, body=done)
        self._clear()

    def abort(self, messages: list[_Sent | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        self.table.ask("delete", self.table.stage, [("_run", f"eq.{self.run}")])
