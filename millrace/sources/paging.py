"""Paginated scans (S1-S8) as a Python data source, and their semantics over DataFrames.

Offset and page pagination are planned as one partition per page range when the number of
pages is known; a cursor's pages follow one another and are one partition."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StructType

from ..functions.numbering import number_rows
from .auth import headers
from .openapi import Operation, spark_type
from .requests import Ask
from .resilience import Backoff

#: Pages that one scan reads at most, unless it says otherwise; more are an error, never lost.
MAX_PAGES = 100


class TooManyPages(RuntimeError):
    """A scan has more pages than it may read."""


Fetch = Callable[[dict], object]


def rows_of(page: object) -> list:
    """The first array among a page's properties; a bare array has no properties."""
    if not isinstance(page, dict):
        return []
    return next((v for v in page.values() if isinstance(v, list)), [])


@dataclass
class Endpoint:
    """A source that is asked over HTTP: how, and the DDL type of what it answers. `record` is
    the type of one row (`a long, b string`) for paginated answers, or of a whole answer.
    `sample` gives dry runs their answer instead. `operations` are those of the source's
    description by name (S2, S18); without a `record` it also gives the types. A paginated answer of
    more than `most` pages raises."""

    client: object
    record: str | None = None
    sample: dict | None = None
    operations: dict[str, Operation] = field(default_factory=dict)
    most: int = MAX_PAGES

    def with_retry(self, backoff: Backoff | None) -> Endpoint:
        """Asked with another backoff, if the client has one."""
        return self if backoff is None or not hasattr(self.client, "backoff") else replace(self, client=replace(self.client, backoff=backoff))

    def with_auth(self, given: dict | Callable[[bool], str] | None) -> Endpoint:
        """H5: with a token's provider, or static credentials as `auth.headers` takes them."""
        if given is None:
            return self
        if callable(given):
            return replace(self, client=replace(self.client, token=given))
        kind, rest = given["type"], {k: v for k, v in given.items() if k != "type"}
        return replace(self, client=replace(self.client, headers={**self.client.headers, **headers(kind, **rest)}))

    def operation(self, name: str) -> Operation:
        if name not in self.operations:
            raise LookupError(f"no operation {name}; there are {', '.join(sorted(self.operations)[:5]) or 'none'}")
        return self.operations[name]

    def answer_type(self, operation: Operation | None, paginated: bool) -> str:
        """The DDL type of an answer, or of all rows of a paginated one."""
        if self.record is not None or operation is None:
            if self.record is None:
                raise LookupError("neither a record type nor an operation says what is answered")
            return f"array<struct<{self.record}>>" if paginated else f"struct<{self.record}>"
        kind = spark_type(operation.response or {"type": "object"})
        if paginated and isinstance(kind, StructType):
            kind = next((f.dataType for f in kind.fields if isinstance(f.dataType, ArrayType)), None)
            if kind is None:
                raise LookupError(f"{operation.path} answers no array to be paginated")
        return kind.simpleString()

    def ask(self, verb: str, paging: Offset | Page | Cursor | None, until: Callable[[object], bool] | None = None, timeout: float | None = None) -> Ask:
        """JSON of the answer to (path, and as JSON: params, body, headers); of a paginated one
        all rows, up to the page for which `until` holds."""

        def one(path: str, params: str | None, body: str | None = None, more: str | None = None) -> str | None:
            given, client = json.loads(params) if params else {}, self.client
            if more or timeout is not None:
                client = replace(client, headers={**client.headers, **json.loads(more or "{}")}, timeout=client.timeout if timeout is None else timeout)
            send = {} if body is None else {"body": json.loads(body)["body"]}
            if paging is None:
                got = client.request(verb, path, given, **send)
            else:
                got = list(read_pages(lambda q: client.request(verb, path, q, **send), paging, until, params=given, most=self.most))
            return None if got is None else json.dumps(got)

        return one


@dataclass
class Offset:
    """param = page number * size; another page follows a full one."""

    param: str
    size: int

    def query(self, page: int, _: str | None) -> dict:
        return {self.param: page * self.size}

    def more(self, page: object, rows: list) -> tuple[bool, str | None]:
        return len(rows) >= self.size, None


@dataclass
class Page:
    """param = page number from 1."""

    param: str
    size: int

    def query(self, page: int, _: str | None) -> dict:
        return {self.param: page + 1}

    def more(self, page: object, rows: list) -> tuple[bool, str | None]:
        return len(rows) >= self.size, None


@dataclass
class Cursor:
    """The first page without param, the next by what the page says at `path`."""

    param: str
    size: int
    path: str

    def query(self, page: int, cursor: str | None) -> dict:
        return {} if cursor is None else {self.param: cursor}

    def more(self, page: object, rows: list) -> tuple[bool, str | None]:
        v = page
        for p in self.path.split("."):
            v = v.get(p) if isinstance(v, dict) else None
        return bool(v), None if not v else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def read_pages(fetch: Fetch, paging: Offset | Page | Cursor, until: Callable[[object], bool] | None = None, params: dict | None = None, first: int = 0, most: int = MAX_PAGES, last: bool = True) -> Iterator[object]:
    """All rows, page by page. `until` is asked before a page's rows are taken. If a page
    says that there is more after `most` pages, that raises, unless `last` is false: then
    another partition reads what follows."""
    cursor, more = None, False
    for n in range(first, first + most):
        page = fetch({**(params or {}), **paging.query(n, cursor)})
        if until and until(page):
            return
        rows = rows_of(page)
        yield from rows
        more, cursor = paging.more(page, rows)
        if not more:
            return
    if more and last:
        raise TooManyPages(f"more than {most} pages")


class _Range(InputPartition):
    def __init__(self, first: int, most: int, last: bool = True):
        self.first, self.most, self.last = first, most, last


class PagedSource(DataSource):
    """spark.read.format("paged") with the options base, path, paging (offset, page or
    cursor), param, size, cursorPath, params (JSON), and pages (how many there are at most
    for each of `splits` partitions, for offset and page). Rows are read as `schema`."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[InputPartition]:
        splits = int(self.options.get("splits", 1))
        pages = int(self.options.get("pages", MAX_PAGES))
        if self.options.get("paging", "page") == "cursor":
            return [_Range(0, pages)]
        each = -(-pages // splits)
        return [_Range(a, min(each, pages - a), a + each >= pages) for a in range(0, pages, each)]

    def read(self, part: _Range) -> Iterator[tuple]:
        from .resilience import Client

        o = self.options
        client = Client(o.get("base", ""))
        size, param = int(o.get("size", 100)), o.get("param", "page")
        paging = {"offset": lambda: Offset(param, size), "page": lambda: Page(param, size), "cursor": lambda: Cursor(param, size, o.get("cursorpath", o.get("cursorPath", "next")))}[o.get("paging", "page")]()
        names = self.schema.fieldNames()
        fetch = lambda q: client.request("get", o.get("path", "/"), q)
        for row in read_pages(fetch, paging, params=json.loads(o.get("params", "{}")), first=part.first, most=part.most, last=part.last):
            yield (json.dumps(row),) if names == ["value"] else tuple(row.get(n) if isinstance(row, dict) else None for n in names)


# --- over DataFrames -------------------------------------------------------------------------


def number_pages(df: DataFrame, order: str, size: int) -> DataFrame:
    """S4, S5 over a table in the order of a numeric column, gaps or not: the page of each
    row, without a global window."""
    return number_rows(df, order, "_number").withColumn("page", F.floor(F.col("_number") / size).cast("long")).drop("_number")


def stop_before(df: DataFrame, until: Column) -> DataFrame:
    """S8 over rows with `page`: pages before the first for which `until`, an aggregate over
    a page's rows, holds; its own rows are dropped."""
    stop = df.groupBy("page").agg(until.alias("_u")).filter("_u").agg(F.min("page").alias("_stop"))
    return df.crossJoin(F.broadcast(stop)).filter(F.col("page") < F.coalesce("_stop", F.lit(1 << 62))).drop("_stop")


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """S6 over a table: the rows after a cursor, in key order. The filter reaches the scan."""
    d = df if after is None else df.filter(F.col(key) > after)
    return d.orderBy(key).limit(size)


def inline(spark: SparkSession, values: list, name: str = "value") -> DataFrame:
    """S15."""
    if not values:
        raise ValueError("an inline array has elements")
    return spark.createDataFrame([(v,) for v in values], [name])
