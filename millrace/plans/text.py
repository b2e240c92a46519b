"""Pipelines as text: reads a mission and compiles it to DataFrames.

    mission M {
      store raw: memory("raw")
      store out: memory("out")
      action Process {
        for item in raw where .amount > 10 {
          map item -> Item { id: .id, size: match .kind { "A" => "big", _ => "small" } }
          store response -> out { key: .id }
        }
      }
      run Process
    }

A loop is not run row by row. What is bound in it (the loop's variables, `let` names, the
response) is a struct column each; an inner loop over a store is a join whose predicate Spark
turns into an equi-join, one over a field is an explode. A match runs each arm on its rows."""

from __future__ import annotations

import itertools
import json
import operator
import re
import threading
from collections.abc import Callable
from dataclasses import dataclass, field, is_dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import Semantics, catalog
from ..operators.schema import Field, Schema
from ..operators.stores import KEY, Catalog, Store
from ..sources.openapi import mock_rows, mock_value
from ..sources.paging import Cursor, Endpoint, Offset, Page
from ..sources.requests import ANSWER, BODY, HEADERS, PARAMS, PATH, RequestLog, request_key
from ..sources.requests import KEY as KEY_
from ..sources.resilience import Backoff
from ..sources.shared import settle
from ..sources.sync import Watermarks, checkpoint_key, format_since, parse_since
from . import mission as M
from . import schedule as S

_TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<op>->|=>|==|!=|<=|>=|\?\?|\.\.\.|\.\.|[{}\[\](),:.<>=+\-*/%?|^])""", re.S)


class SyntaxFault(ValueError):
    """The text is not a mission; says where."""


@dataclass
class Token:
    kind: str
    text: str
    line: int


def tokens(text: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"line {line}: unexpected {text[at]!r}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return [*out, Token("end", "", line)]


@dataclass
class Program:
    name: str
    sources: dict[str, dict] = field(default_factory=dict)
    stores: dict[str, tuple[str, str]] = field(default_factory=dict)
    schemas: dict[str, Schema] = field(default_factory=dict)
    transforms: dict[str, list[tuple]] = field(default_factory=dict)
    actions: dict[str, list[tuple]] = field(default_factory=dict)
    stages: list[tuple[list[str], Any]] = field(default_factory=list)
    lets: list[tuple] = field(default_factory=list)
    schedule: tuple | None = None


# Binding powers: how tightly an operator holds what stands left and right of it.
_BINDS = {"|": 1, "?": 1, "or": 2, "??": 2, "and": 3, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "is": 5, "in": 5, "contains": 5, "startsWith": 5, "endsWith": 5, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "..": 6, "[": 10}
# Functions over a collection whose second argument is asked of each element.
_EACH = ("filter", "map", "find", "findIndex", "sortBy", "sum", "count", "some", "every")
# Functions that want a literal after the first argument as it is.
_PLAIN = ("join", "split", "substring", "round", "pick", "omit", "formatDate", "parseDate", "parseDecimal", "weighted_sum")
# Functions over a store or a part of one.
_OVER = ("count", "length", "sum", "min", "max", "avg", "some", "exists")
# A store's record as a whole, among its fields.
_RECORD = "_record"
# Columns that hold the places of the loops' elements.
_PLACE = "_place"
_VERBS = ("get", "post", "put", "patch", "delete", "GET", "POST", "PUT", "PATCH", "DELETE")


class Reader:
    """Recursive descent for statements, operator precedence for expressions. An expression
    is a tuple whose first entry names its kind."""

    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    # --- tokens -------------------------------------------------------------------------
    @property
    def now(self) -> Token:
        return self.t[self.i]

    def at(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind != "str"

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, what: str) -> str:
        tok = self.now
        ok = tok.kind == what if what in ("name", "str", "num") else self.at(what)
        if not ok:
            raise SyntaxFault(f"line {tok.line}: expected {what}, found {tok.text or 'the end'!r}")
        self.i += 1
        return tok.text

    def string(self) -> str:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), self.need("str")[1:-1])

    def items(self, one: Callable[[], Any], end: str) -> list:
        out = []
        while not self.take(end):
            out.append(one())
            self.take(",")
        return out

    # --- declarations -------------------------------------------------------------------
    def mission(self) -> Program:
        self.need("mission")
        p = Program(self.need("name"))
        self.need("{")
        while not self.take("}"):
            word = self.need("name")
            if word == "source":
                name = self.need("name")
                spec = self.string() if self.take("from") else None
                p.sources[name] = {"spec": spec, **(self.options() if self.at("{") else {})}
            elif word == "store":
                name = self.need("name")
                self.need(":")
                kind = self.need("name")
                self.need("(")
                p.stores[name] = (kind, self.string())
                self.need(")")
            elif word == "schema":
                s = self.schema()
                p.schemas[s.name] = s
            elif word == "transform":
                name, variants = self.transform()
                p.transforms[name] = variants
            elif word == "action":
                name = self.need("name")
                if name in p.actions:
                    raise SyntaxFault(f"line {self.now.line}: two actions named {name}")
                p.actions[name] = self.block()
            elif word == "let":
                # A name for an expression of constants, seen by all actions
                name = self.need("name")
                self.need("=")
                p.lets.append(("let", name, self.expression()))
            elif word == "run":
                p.stages = [self.stage()]
                while self.take("then"):
                    p.stages.append(self.stage())
            elif word == "schedule":
                self.need(":")
                p.schedule = self.when()
            else:
                raise SyntaxFault(f"line {self.now.line}: unexpected {word} in a mission")
            self.take(",")
        if not p.stages:
            raise SyntaxFault("a mission has a run line")
        return p

    def when(self) -> tuple:
        if self.take("every"):
            n = int(self.need("num"))
            return ("every", S.seconds(n, self.need("name")))
        if self.take("cron"):
            return ("cron", self.string())
        self.need("at")
        return ("at", self.string())

    def stage(self) -> tuple[list[str], Any]:
        names = self.items(lambda: self.need("name"), "]") if self.take("[") else [self.need("name")]
        return names, self.expression() if self.take("if") else None

    def schema(self) -> Schema:
        s = Schema(self.need("name"))
        self.need("{")

        def one():
            name = self.need("name")
            self.need(":")
            kind = self.need("name")
            s.fields.append(Field(name, kind, self.take("?")))

        self.items(one, "}")
        return s

    def transform(self) -> tuple[str, list[tuple]]:
        name = self.need("name")
        if self.take("{"):
            def one():
                self.need("(")
                schema = self.need("name")
                self.need(")")
                guard = self.expression() if self.take("where") else None
                self.need("->")
                self.need("name")
                return schema, guard, self.fields()

            return name, self.items(one, "}")
        schema = self.need("name") if self.take(":") else "_"
        self.need("->")
        self.need("name")
        return name, [(schema, None, self.fields())]

    def fields(self) -> dict[str, tuple]:
        self.need("{")
        out: dict[str, tuple] = {}

        def one():
            if self.take("..."):
                out["..."] = self.expression()
                return
            key = self.string() if self.now.kind == "str" else self.need("name")
            self.need(":")
            out[key] = self.expression()

        self.items(one, "}")
        return out

    def options(self) -> dict[str, Any]:
        self.need("{")
        out: dict[str, Any] = {}

        def one():
            key = self.string() if self.now.kind == "str" else self.need("name")
            self.take(":")
            if self.at("{") and key != "body":
                out[key] = self.options()
            elif key == "since":
                out[key] = self.since()
            else:
                out[key] = self.expression()

        self.items(one, "}")
        return out

    def since(self) -> tuple:
        """lastSync, lastSync("key") { param, format, updateFrom }, or an expression."""
        if not self.take("lastSync"):
            return "value", self.expression()
        key = None
        if self.take("("):
            key = self.string()
            self.need(")")
        return "last", key, self.options() if self.at("{") else {}

    # --- steps --------------------------------------------------------------------------
    def block(self) -> list[tuple]:
        self.need("{")
        return self.items(self.step, "}")

    def step(self) -> tuple:
        word = self.need("name")
        if word == "delete" and self.now.kind == "name" and self.t[self.i + 1].text == "[":
            name = self.need("name")
            self.need("[")
            key = self.expression()
            self.need("]")
            return "remove", name, key
        if word in _VERBS or word == "call":
            if word == "call":
                target = self.need("name")
                self.need(".")
                target += "." + self.need("name")
                return "fetch", word.lower(), target, self.options() if self.at("{") else {}
            # a name before the path is the source's
            source = {"source": ("name", self.need("name"))} if self.now.kind == "name" and self.t[self.i + 1].kind == "str" else {}
            target = self.expression()
            return "fetch", word.lower(), target, source | (self.options() if self.at("{") else {})
        if word == "for":
            var = self.need("name")
            self.need("in")
            source = self.expression()
            cond = self.expression() if self.take("where") else None
            return "for", var, *_narrowed(source, cond, var), self.block()
        if word == "map":
            source = self.expression()
            self.need("->")
            self.need("name")
            return "map", source, self.fields()
        if word == "apply":
            name = self.need("name")
            self.need("to")
            return "apply", name, self.expression(), self.need("name") if self.take("as") else None
        if word == "validate":
            source = self.expression()
            self.need("{")

            def one():
                self.need("assume")
                return self.expression()

            rules = self.items(one, "}")
            return "validate", source, rules, self.block() if self.take("or") else None
        if word == "clear":
            return "clear", self.need("name")
        if word == "store":
            self.take("each")
            source = self.expression()
            self.need("->")
            return "store", source, self.need("name"), self.options() if self.at("{") else {}
        if word == "let":
            name = self.need("name")
            self.need("=")
            return "let", name, self.argument()
        if word == "match":
            source = None if self.at("{") else self.expression()
            self.need("{")
            if source is None:
                return "match", ("lit", True), self.items(lambda: self.arm(True), "}")
            return "match", source, self.items(self.arm, "}")
        if word == "wait":
            return "wait", self.options()
        raise SyntaxFault(f"line {self.now.line}: unknown step {word}")

    def pattern(self) -> Any:
        """A schema's name, `_`, a name to bind, `[]`, `[Schema]`, or fields with
        a literal, a name to bind or a pattern each."""
        if self.take("["):
            if self.take("]"):
                return ("empty",)
            each = self.need("name")
            self.need("]")
            return "each", each
        if not self.take("{"):
            return self.need("name")

        def one():
            name = self.need("name")
            self.need(":")
            if self.at("{", "[") or self.now.kind == "name" and not self.at("true", "false", "null"):
                return name, self.pattern()
            return name, self.expression()

        return "fields", self.items(one, "}")

    def arm(self, bare: bool = False) -> tuple:
        """An arm of a match; of one without a subject (D11, `bare`) a condition or `_`."""
        if bare:
            schema, guard = "_", None if self.take("_") else self.expression()
        else:
            schema = self.pattern()
            guard = self.expression() if self.take("where") else None
        self.need("->")
        if self.take("run"):
            return schema, guard, ("run", self.need("name"))
        for word in ("continue", "skip"):
            if self.take(word):
                return schema, guard, (word,)
        if self.take("abort"):
            return schema, guard, ("abort", self.string() if self.now.kind == "str" else "aborted")
        if self.take("queue"):
            return schema, guard, ("queue", self.need("name") if self.now.kind == "name" else "dead_letters")
        if self.take("retry"):
            return schema, guard, ("retry", self.options() if self.at("{") else {})
        if self.take("jump"):
            target = self.need("name")
            then = self.need("name") if self.take("then") else "continue"
            return schema, guard, ("jump", target, then)
        return schema, guard, ("steps", self.block() if self.at("{") else [self.step()])

    # --- expressions --------------------------------------------------------------------
    def expression(self, least: int = 0) -> tuple:
        left = self.prefix()
        while True:
            op = self.now.text
            power = _BINDS.get(op, 0) if self.now.kind in ("op", "name") else 0
            if not power or power <= least:
                return left
            self.i += 1
            if op == "[":
                left = ("at", left, self.expression())
                self.need("]")
                if self.at(".") and self.t[self.i + 1].kind == "name":
                    self.i += 1
                    left = ("field", left, self.path(self.need("name"))[1])
            elif op == "|":
                # What stands on the left is the first argument of what stands on the right
                name = self.need("name")
                left = ("call", name, [left, *(self.items(self.argument, ")") if self.take("(") else [])])
            elif op == "..":
                left = ("range", left, self.expression(power))
            elif op == "?":
                yes = self.expression()
                self.need(":")
                left = ("if", left, yes, self.expression())
            elif op == "is":
                left = ("is", left, self.now.text)
                self.i += 1
            else:
                left = ("op", op, left, self.expression(power))

    def prefix(self) -> tuple:
        if self.take("not"):
            return "not", self.expression(4)
        if self.take("-"):
            return "negate", self.expression(9)
        if self.take("+"):
            return "number", self.expression(9)
        tok = self.now
        if tok.kind == "num":
            self.i += 1
            return "lit", float(tok.text)
        if tok.kind == "str":
            return "lit", self.string()
        if self.take("("):
            e = self.expression()
            if self.take("where"):  # R17
                e = ("filter", e, self.expression())
            self.need(")")
            return e
        if self.take("^"):
            # A name of the scope around this one
            self.take(".")
            return "outer", self.path(self.need("name"))
        if self.take("["):
            return "array", self.items(self.expression, "]")
        if self.take("if"):
            cond = self.expression()
            self.need("then")
            yes = self.expression()
            self.need("else")
            return "if", cond, yes, self.expression()
        if self.at("{"):
            return "object", self.fields()
        if self.take("."):
            return self.path(self.need("name"))
        name = self.need("name")
        if name in ("true", "false", "null"):
            return "lit", {"true": True, "false": False, "null": None}[name]
        if name == "match":
            subject = None if self.at("{") else self.prefix()
            self.need("{")

            def one():
                pattern = self.expression()
                self.need("=>")
                return pattern, self.expression()

            return "match", subject, self.items(one, "}")
        if name == "any" and self.take("of"):
            source = self.prefix()
            return "any", source, self.expression() if self.take("where") else None
        if self.take("("):
            return "call", name, self.items(self.argument, ")")
        return self.path(name)

    def argument(self) -> tuple:
        """A collection may be narrowed where it is handed on; E26: `x => e`, `(a, x) => e`."""
        if self.now.kind == "name" and self.t[self.i + 1].text == "=>":
            name = self.need("name")
            self.need("=>")
            return "lambda", [name], self.expression()
        if [x.text if x.kind == "op" else x.kind for x in self.t[self.i : self.i + 6]] == ["(", "name", ",", "name", ")", "=>"]:
            names = [self.t[self.i + 1].text, self.t[self.i + 3].text]
            self.i += 6
            return "lambda", names, self.expression()
        e = self.expression()
        return ("filter", e, self.expression()) if self.take("where") else e

    def path(self, name: str) -> tuple:
        while self.at(".") and self.t[self.i + 1].kind == "name":
            self.i += 1
            name += "." + self.need("name")
        return "name", name


def _renamed(e: Any, name: str, to: str) -> Any:
    """An expression with one variable's name replaced."""
    if isinstance(e, tuple) and e[:1] == ("name",):
        head, *rest = e[1].split(".")
        return "name", ".".join([to, *rest]) if head == name else e[1]
    if isinstance(e, (tuple, list)):
        return type(e)(_renamed(x, name, to) for x in e)
    return {k: _renamed(v, name, to) for k, v in e.items()} if isinstance(e, dict) else e


def _narrowed(source: tuple, cond: tuple | None, var: str) -> tuple[tuple, tuple | None]:
    """Of a loop over `(s where p)` or `s | filter(p)` the collection and all conditions."""
    while source[0] == "filter" or source[:2] == ("call", "filter"):
        _, inner, p = source if source[0] == "filter" else ("filter", *source[2])
        if p[0] == "lambda":
            p = _renamed(p[2], p[1][0], var)
        source, cond = inner, p if cond is None else ("op", "and", p, cond)
    return source, cond


def parse(text: str) -> Program:
    r = Reader(text)
    p = r.mission()
    check_names(p)
    return p


def check_names(p: Program) -> None:
    """Stores, sources, transforms and actions that are used exist."""

    def steps(block: list[tuple], action: str) -> None:
        for s in block:
            if s[0] == "for":
                steps(s[4], action)
            elif s[0] == "store" and s[2] not in p.stores:
                raise SyntaxFault(f"{action}: unknown store {s[2]}")
            elif s[0] in ("clear", "remove") and s[1] not in p.stores:
                raise SyntaxFault(f"{action}: unknown store {s[1]}")
            elif s[0] == "validate" and s[3]:
                steps(s[3], action)
            elif s[0] == "fetch":
                named = s[3]["source"][1] if "source" in s[3] else s[2].split(".")[0] if s[1] == "call" else None
                if named is not None and named not in p.sources:
                    raise SyntaxFault(f"{action}: unknown source {named}")
            elif s[0] == "apply" and s[1] not in p.transforms:
                raise SyntaxFault(f"{action}: unknown transform {s[1]}")
            elif s[0] == "match":
                for _, _, what in s[2]:
                    if what[0] == "steps":
                        steps(what[1], action)
                    elif what[0] in ("jump", "run") and what[1] not in p.actions:
                        raise SyntaxFault(f"{action}: unknown action {what[1]}")

    for name, block in p.actions.items():
        steps(block, name)
    for names, _ in p.stages:
        for n in names:
            if n not in p.actions:
                raise SyntaxFault(f"unknown action {n}")


Fetch = Callable[[SparkSession, dict], DataFrame]


@dataclass
class _Var:
    """A variable of a lambda: as Spark has it inside, and a stand-in outside that has its type.
    Without a name it is the element whose fields a predicate names."""

    name: str | None
    inner: Column
    outer: Column
    shown: bool = False  # whether the stand-in is meant

    @property
    def column(self) -> Column:
        return self.outer if self.shown else self.inner


class _Within(Semantics):
    """Rules inside a lambda. What Spark can't resolve there has the type of its stand-in, and
    what would raise is NULL."""

    def __init__(self, df: DataFrame, known: dict[int, tuple[Column, T.DataType]]):
        super().__init__(df, lenient=True)
        self.known = known

    def type_of(self, c) -> T.DataType:
        return self.known[id(c)][1] if id(c) in self.known else super().type_of(c)


class Compiler:
    """Runs a program's actions as DataFrame builders. `sources` are functions that give a
    request's rows; the last response of an action is a column of its frame."""

    def __init__(self, program: Program, spark: SparkSession, stores: Catalog | None = None, sources: dict[str, Fetch] | None = None, events: Callable[[SparkSession, str], DataFrame] | None = None, marks: Watermarks | None = None, log: RequestLog | None = None, auth: dict[str, Any] | None = None):
        self.p, self.spark, self.sources, self.events, self.dry_run = program, spark, sources or {}, events, False
        self._log, self.auth, self._steps, self._joined = log, auth or {}, itertools.count(), itertools.count()
        self._lock = threading.Lock()
        self._here = threading.local()  # what the actions of a parallel stage don't share
        self.stores = stores or Catalog(spark)
        self.marks = marks or Watermarks(spark)
        self.known: dict[int, tuple[Column, T.DataType]] = {}

    def _mine(self, name: str, start: Callable[[], Any]) -> Any:
        if not hasattr(self._here, name):
            setattr(self._here, name, start())
        return getattr(self._here, name)

    @property
    def scope(self) -> list[_Var]:
        """Variables of the lambdas around an expression."""
        return self._mine("scope", list)

    @property
    def around(self) -> list[str | None]:
        """What loops have as their current element, from the outermost on."""
        return self._mine("around", list)

    @property
    def views(self) -> dict[str, tuple]:
        """Names that `let` gave to a store or a part of one."""
        return self._mine("views", dict)

    @property
    def log(self) -> RequestLog:
        with self._lock:
            if self._log is None:
                self._log = RequestLog(self.spark)
            return self._log

    def build(self, **kw) -> M.Mission:
        self.dry_run = kw.get("dry_run", False)
        if self.dry_run:  # what a dry run writes is seen by its later steps and by nobody else
            given = self.stores
            self.stores = Catalog(self.spark)
            self.stores.stores = dict(given.stores)
        start = lambda b: lambda ctx: self._started(b, ctx)
        actions = [M.Action(n, start(b), mock=start(b)) for n, b in self.p.actions.items()]
        stages = [M.Stage(names, None if cond is None else (lambda m, c=cond: self.constant(c))) for names, cond in self.p.stages]
        return M.Mission(self.p.name, self.spark, actions, stages, self.stores, **kw)

    def _started(self, block: list[tuple], ctx: M.Context) -> DataFrame:
        self.views.clear()
        return self.run([*self.p.lets, *block], ctx, self.spark.range(1).drop("id"), None)

    def constant(self, e: tuple) -> bool:
        one = self.spark.range(1)
        e, one, _ = self.decorrelated(e, one, None)
        return bool(one.select(Semantics(one).truthy(self.expr(e, one, None))).first()[0])

    # --- expressions --------------------------------------------------------------------
    def name(self, path: str, df: DataFrame, current: str | None) -> Column | None:
        head, *rest = path.split(".")

        def walk(t: T.DataType, c: Column, parts: list[str]) -> Column | None:
            for p in parts:
                if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and p in t.elementType.fieldNames():
                    t, c = T.ArrayType(t.elementType[p].dataType), c[p]  # R18: a field of all elements
                    continue
                if not isinstance(t, T.StructType) or p not in t.fieldNames():
                    return None
                t, c = t[p].dataType, c[p]
            return c

        tries = []
        for v in reversed(self.scope):
            if v.name in (None, head):
                tries.append((Semantics(df).type_of(v.outer), v.column, rest if v.name else [head, *rest]))
        if current and current in df.columns:
            tries.append((df.schema[current].dataType, F.col(current), [head, *rest]))
        if head in df.columns:
            tries.append((df.schema[head].dataType, F.col(head), rest))
        if "response" in df.columns:
            tries.append((df.schema["response"].dataType, F.col("response"), [head, *rest]))
        return next((c for c in (walk(*t) for t in tries) if c is not None), None)

    def expr(self, e: tuple, df: DataFrame, current: str | None) -> Column:
        within = any(not v.shown for v in self.scope)
        s = _Within(df, self.known) if within else Semantics(df)

        def go(x):
            c = self.expr(x, df, current)
            if within:
                self.known[id(c)] = (c, self._type(x, df, current))
            return c

        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "name":
            c = self.name(e[1], df, current)
            if c is None and not self._mine("lenient", int):
                raise SyntaxFault(f"nothing is named {e[1]}")
            return F.lit(None) if c is None else c
        if kind == "column":
            return F.col(e[1])
        if kind == "field":
            c = go(e[1])
            for p in e[2].split("."):
                t = s.type_of(c)
                if not isinstance(t, T.VariantType) and p not in getattr(t, "names", ()):
                    raise SyntaxFault(f"nothing is named {e[2]}")
                c = c[p]
            return c
        if kind == "outer":
            held = [self.scope.pop()] if self.scope else []
            try:
                c = self.name(e[1][1], df, current if held else self.around[-1] if self.around else None)
            finally:
                self.scope.extend(held)
            if c is None:
                raise SyntaxFault(f"nothing around is named {e[1][1]}")
            return c
        if kind == "op":
            op, a, b = e[1], go(e[2]), go(e[3])
            simple = {"+": s.add, "-": s.subtract, "*": s.multiply, "/": s.divide, "%": s.modulo, "and": s.both, "or": s.either, "??": s.default, "==": s.equal}
            if op in simple:
                return simple[op](a, b)
            if op == "!=":
                return ~s.equal(a, b)
            if op == "in":
                return F.array_contains(b, a)
            if op in ("contains", "startsWith", "endsWith"):
                return catalog.call(op, a, b)
            return s.compare(a, op, b)
        if kind == "not":
            return s.negation(go(e[1]))
        if kind in ("negate", "number"):
            return s.negate(go(e[1])) if kind == "negate" else s.number(go(e[1]))
        if kind == "if":
            return s.choose(go(e[1]), go(e[2]), go(e[3]))
        if kind == "is":
            return s.is_type(go(e[1]), e[2])
        if kind == "array":
            return F.array(*[go(x) for x in e[1]])
        if kind == "object":
            return self.record(e[1], df, current)
        if kind == "match":
            other = next((go(r) for p, r in e[2] if p == ("name", "_")), None)
            arms = [(go(p), go(r)) for p, r in e[2] if p != ("name", "_")]
            return s.cases(arms, other) if e[1] is None else s.match(go(e[1]), arms, other)
        if kind == "at":
            a, i = go(e[1]), go(e[2])
            if isinstance(s.type_of(a), T.ArrayType):
                return F.get(a, s.number(i).cast("int"))
            return a[e[2][1]]
        if kind == "range":
            return F.sequence(*[s.number(go(x)).cast("long") for x in e[1:]])
        if kind == "filter":
            return F.filter(go(e[1]), self._lambda(e[2], e[1], df, current, truth=True))
        if kind == "any":
            return s.any_of(go(e[1]), None if e[2] is None else self._lambda(e[2], e[1], df, current, truth=True))
        if kind == "call" and e[1] in _EACH and len(e[2]) == 2:
            name, (source, body) = e[1], e[2]
            a, f = go(source), self._lambda(body, source, df, current, truth=e[1] not in ("map", "sortBy", "sum"))
            special = {"sum": lambda: catalog.call("sum", F.transform(a, f)), "count": lambda: catalog.call("count", F.filter(a, f)), "some": lambda: F.exists(a, f), "every": lambda: F.forall(a, f)}
            return special[name]() if name in special else catalog.call(name, a, f)
        if kind == "call" and e[1] == "reduce":
            # (collection, start, (so far, element) => next)
            a, zero = go(e[2][0]), go(e[2][1])
            return F.aggregate(a, zero, lambda acc, x: self._body(e[2][2], [acc, x], [self._shown(e[2][1], df, current), self._shown(e[2][0], df, current)[0]], df, current))
        if kind == "call":
            args = [go(x) for x in e[2]]
            if e[1] == "length":
                return catalog.CORE["length"](args[0], isinstance(s.type_of(args[0]), T.ArrayType))
            if e[1] == "env":
                return catalog.CORE["env"](e[2][0][1])
            if e[1] in _PLAIN:
                plain = [x[1] if x[0] == "lit" else None for x in e[2]]
                whole = [int(v) if isinstance(v, float) and v.is_integer() else v for v in plain]
                args = [args[0], *[c if v is None else v for c, v in zip(args[1:], whole[1:], strict=True)]]
            return catalog.call(e[1], *args)
        raise SyntaxFault(f"cannot compile {kind}")

    def _shown(self, e: tuple, df: DataFrame, current: str | None) -> Column:
        """An expression over the stand-ins of all variables, which Spark can resolve."""
        were = [v.shown for v in self.scope]
        for v in self.scope:
            v.shown = True
        try:
            return self.expr(e, df, current)
        finally:
            for v, was in zip(self.scope, were, strict=True):
                v.shown = was

    def _type(self, e: tuple, df: DataFrame, current: str | None) -> T.DataType:
        return Semantics(df).type_of(self._shown(e, df, current))

    def _lambda(self, e: tuple, source: tuple, df: DataFrame, current: str | None, truth: bool) -> Callable[[Column], Column]:
        """What is asked of each element of `source`: a lambda, or an expression that names the
        element's fields. As a condition (`truth`) it is never NULL."""
        return lambda x: self._body(e, [x], [self._shown(source, df, current)[0]], df, current, truth)

    def _body(self, e: tuple, inner: list[Column], outer: list[Column], df: DataFrame, current: str | None, truth: bool = False) -> Column:
        names, body = (e[1], e[2]) if e[0] == "lambda" else ([None], e)
        if len(names) != len(inner):
            raise SyntaxFault(f"a function of {len(inner)} values is wanted")
        n = len(self.scope)
        self.scope.extend(_Var(*v) for v in zip(names, inner, outer, strict=True))
        try:
            c = self.expr(body, df, current)
            if truth:
                self.known[id(c)] = (c, self._type(body, df, current))
                c = _Within(df, self.known).truthy(c)
            return c
        finally:
            del self.scope[n:]

    def record(self, fields: dict[str, tuple], df: DataFrame, current: str | None) -> Column:
        base = fields.get("...")
        cols = {k: self.expr(v, df, current) for k, v in fields.items() if k != "..."}
        if base is not None:
            return catalog.call("spread", self.expr(base, df, current), **cols)
        return F.struct(*[c.alias(k) for k, c in cols.items()])

    # --- steps --------------------------------------------------------------------------
    def run(self, block: list[tuple], ctx: M.Context, df: DataFrame, current: str | None) -> DataFrame:
        for step in block:
            df = getattr(self, f"_{step[0]}")(step, ctx, df, current)
        return df

    def _bind(self, df: DataFrame, source: tuple, current: str | None, into: str) -> DataFrame:
        """df with a struct column of what `source` names."""
        if source == ("name", into) and into in df.columns:
            return df
        e, d, extra = self.decorrelated(source, df, current)
        return d.withColumn(into, self.expr(e, d, current)).drop(*extra)

    def _let(self, step, ctx, df, current):
        if self._collection(step[2], df, current):
            self.views[step[1]] = self._seen(step[2])
            return df
        self.views.pop(step[1], None)
        e, d, extra = self.decorrelated(step[2], df, current)
        return d.withColumn(step[1], self.expr(e, d, current)).drop(*extra)

    def _map(self, step, ctx, df, current):
        d = self._bind(df, step[1], current, "_source")
        e, d, extra = self.decorrelated(("object", step[2]), d, "_source")
        return d.withColumn("response", self.record(e[1], d, "_source")).drop("_source", *extra)

    def _apply(self, step, ctx, df, current):
        _, name, source, into = step
        d = self._bind(df, source, current, "_source")
        out = None
        # a variant may name what records of another schema don't have
        self._here.lenient = self._mine("lenient", int) + 1
        for schema, guard, fields in self.p.transforms[name]:
            hit = F.lit(True) if schema == "_" else self.p.schemas[schema].matches(d, "_source") if schema in self.p.schemas else F.lit(False)
            if guard is not None:
                hit = hit & Semantics(d).truthy(self.expr(guard, d, "_source"))
            r = self.record(fields, d, "_source")
            out = F.when(hit, r) if out is None else out.when(hit, r)
        self._here.lenient -= 1
        out = out.otherwise(F.raise_error(F.lit(f"{name}: no variant fits")))
        return d.withColumn(into or "response", out).drop("_source")

    def _validate(self, step, ctx, df, current):
        d = self._bind(df, step[1], current, "_source")
        (_, rules), d, extra = self.decorrelated(("array", step[2]), d, "_source")
        if step[3] is not None:
            # Rows that fail go through the other steps and no further
            good = F.lit(True)
            for e in rules:
                good = good & Semantics(d).truthy(self.expr(e, d, "_source"))
            self.run(step[3], ctx, d.filter(~good).drop("_source", *extra), current)
            return d.filter(good).drop("_source", *extra)
        ok = F.lit(True)
        for k, e in enumerate(rules):
            good = Semantics(d).truthy(self.expr(e, d, "_source"))
            ok = ok & F.when(good, True).otherwise(F.raise_error(F.lit(f"constraint {k + 1} failed")).cast("boolean"))
        return d.filter(ok).drop("_source", *extra)

    def _store(self, step, ctx, df, current):
        _, source, name, opts = step
        d = self._bind(df, source, current, "_source")
        if isinstance(d.schema["_source"].dataType, T.ArrayType):
            d = d.withColumn("_source", F.explode("_source"))
        if not isinstance(d.schema["_source"].dataType, T.StructType):
            d = d.withColumn("_source", F.struct(F.col("_source").alias("value")))
        key = None
        if "key" in opts:
            e, d, _ = self.decorrelated(opts["key"], d, "_source")
            key = self.expr(e, d, "_source")
        flags = {k: opts[k][1] for k in ("partial", "upsert") if k in opts}
        self._put(name, d, key, **flags)
        return df

    def _clear(self, step, ctx, df, current):
        self.stores.stores[step[1]] = self.stores[step[1]].clear()
        return df

    def _remove(self, step, ctx, df, current):
        e, d, _ = self.decorrelated(step[2], df, current)
        keys = d.select(self.expr(e, d, current).alias("_gone"))
        self.stores.stores[step[1]] = self.stores[step[1]].delete(keys, F.col("_gone"))
        return df

    def _put(self, name: str, d: DataFrame, key: Column | None, partial: bool | None = None, upsert: bool = False) -> None:
        """Writes the records in _source; later steps see them."""
        given = [] if key is None else [key.alias("_given")]
        places = [] if upsert or not given else [c for c in d.columns if c.startswith(_PLACE)]
        rows = d.select("_source.*", F.monotonically_increasing_id().alias("_order"), *given, *places)
        store: Store = self.stores[name]
        k = F.col("_given") if given else None
        got = store.upsert(rows, k, "_order", partial) if upsert else store.set(rows, k, "_order", partial, places)
        self.stores.stores[name] = Store(name, got.table.drop("_given", "_order"))

    def _for(self, step, ctx, df, current):
        _, var, source, cond, body = step
        source, cond = _narrowed(self._seen(source), cond, var)
        # where an element stands in its collection: of writes to one key the last loop's last stays
        place = f"{_PLACE}{sum(c.startswith(_PLACE) for c in df.columns)}"
        if self._is_store(source, df, current):
            rows = self.stores[source[1]].numbered(place)
            rows = rows.select(place, F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != place]).alias("_item"))
            d = df.drop("response").crossJoin(rows) if df.columns else rows
        else:
            e, d, extra = self.decorrelated(source, df, current)
            a = self.expr(e, d, current)
            if not isinstance(Semantics(d).type_of(a), T.ArrayType):
                raise TypeError(f"for {var}: not a collection")
            d = d.select("*", F.posexplode(a).alias(place, "_item")).drop("response", *extra)
        d = d.drop(var).withColumnRenamed("_item", var)
        self.around.append(current)
        try:
            for c in _conjuncts(cond) if cond is not None else []:
                d = self._kept(c, d, var)
            self.run(body, ctx, d, var)
        finally:
            self.around.pop()
        return df

    def _kept(self, c: tuple, d: DataFrame, current: str | None) -> DataFrame:
        """Rows for which a condition holds; whether a store has a key is asked by a join
        that keeps or drops the row."""
        wanted, e = (True, c) if c[0] != "not" else (False, c[1])
        if e[:2] == ("call", "exists") and e[2][0][0] == "at" and self._is_store(self._seen(e[2][0][1]), d, current):
            store, key = self._seen(e[2][0][1]), e[2][0][2]
            key, d, extra = self.decorrelated(key, d, current)
            t = self.stores[store[1]]._some().select(F.col(KEY).alias("_there"))
            d = d.withColumn("_asked", Semantics(d).string(self.expr(key, d, current), "undefined"))
            return d.join(t, F.col("_asked") == F.col("_there"), "left_semi" if wanted else "left_anti").drop("_asked", *extra)
        e, d, extra = self.decorrelated(c, d, current)
        return d.filter(Semantics(d).holds(self.expr(e, d, current))).drop(*extra)

    # --- stores inside expressions --------------------------------------------------------
    def _seen(self, e: tuple) -> tuple:
        """An expression with the names that `let` gave to parts of stores replaced by those."""
        if e[0] == "name" and e[1] in self.views:
            return self.views[e[1]]
        return e

    def _is_store(self, e: tuple, df: DataFrame, current: str | None) -> bool:
        """Whether a name is a store's, and not shadowed by a variable or a field."""
        return e[0] == "name" and (e[1] in self.p.stores or e[1] in self.stores.stores) and self.name(e[1], df, current) is None

    def _collection(self, e: tuple, df: DataFrame, current: str | None) -> tuple[str, list[tuple]] | None:
        """The store and the conditions, if e is a store, narrowed or not. Conditions
        name the record's fields; a lambda's variable stands before them."""
        e, conds = self._seen(e), []
        while e[0] == "filter" or e[:2] == ("call", "filter") and len(e[2]) == 2:
            _, e, p = e if e[0] == "filter" else ("filter", *e[2])
            e = self._seen(e)
            conds += _conjuncts(p[2] if p[0] == "lambda" else p) if p[0] != "lambda" else _conjuncts(_renamed(p[2], p[1][0], _RECORD))
        return (e[1], conds) if self._is_store(e, df, current) else None

    def decorrelated(self, e: Any, df: DataFrame, current: str | None) -> tuple[Any, DataFrame, list[str]]:
        """e with each use of a store replaced by a column, df with those columns, and their
        names. A lookup by key is a left join on the key. A count, sum or the like of a part of a
        store is one table, grouped by what the part's conditions equate with the row, and a left join
        with it; other conditions over the row are asked once for each distinct set of its values."""
        if not isinstance(e, (tuple, list, dict)):
            return e, df, []
        if isinstance(e, tuple) and e[:1] == ("name",):
            if e[1] in self.views or self._is_store(e, df, current):
                raise SyntaxFault(f"{e[1]} is a store: loop over it, look a key up, or count, sum, min, max, avg, any or exists of it")
            return e, df, []
        if isinstance(e, tuple) and e[:1] in (("lit",), ("column",), ("outer",)):
            return e, df, []
        made: list[str] = []
        if isinstance(e, tuple) and e[:1] == ("at",) and self._is_store(self._seen(e[1]), df, current):
            key, df, made = self.decorrelated(e[2], df, current)
            into = f"_looked{next(self._joined)}"
            df = self.stores[self._seen(e[1])[1]].lookup(df, self.expr(key, df, current), into)
            return ("column", into), df, [*made, into]
        if isinstance(e, tuple) and (e[:1] == ("any",) or e[:1] == ("call",) and e[1] in _OVER and e[2]):
            source, rest = (e[1], [e[2]] if e[2] is not None else []) if e[0] == "any" else (e[2][0], e[2][1:])
            how = "any" if e[0] == "any" else e[1]
            if (part := self._collection(source if how not in ("any", "some", "count") or not rest else ("filter", source, rest[0]), df, current)) is not None:
                return self._aggregated(how, part, None if how in ("any", "some", "count") or not rest else rest[0], df, current)
        out = []
        for x in e.values() if isinstance(e, dict) else e:
            x, df, more = self.decorrelated(x, df, current)
            out.append(x)
            made += more
        return (dict(zip(e, out, strict=True)) if isinstance(e, dict) else type(e)(out)), df, made

    def _side(self, e: Any, inner: list[str], df: DataFrame, current: str | None) -> set[str]:
        """Whether an expression names fields of the record (in), of what is around it (out), or both."""
        if isinstance(e, tuple) and e[:1] == ("outer",):
            return {"out"}
        if isinstance(e, tuple) and e[:1] == ("name",):
            head = e[1].split(".")[0]
            if head in inner or head == _RECORD:
                return {"in"}
            if self.name(e[1], df, current) is None:
                raise SyntaxFault(f"nothing is named {e[1]}")
            return {"out"}
        if isinstance(e, (tuple, list, dict)):
            return {x for v in (e.values() if isinstance(e, dict) else e) for x in self._side(v, inner, df, current)}
        return set()

    def _aggregated(self, how: str, part: tuple[str, list[tuple]], of: tuple | None, df: DataFrame, current: str | None) -> tuple[tuple, DataFrame, list[str]]:
        store, conds = part
        n = next(self._joined)
        t = self.stores[store].scan()
        fields = t.columns
        t = t.select(*[F.col(f"`{c}`").alias(c) for c in fields], F.struct(*[F.col(f"`{c}`") for c in fields]).alias(_RECORD))
        equal, mixed = [], []
        for c in conds:
            sides = self._side(c, fields, df, current)
            if "out" not in sides:
                t = t.filter(Semantics(t).holds(self.expr(c, t, None)))
                continue
            pair = [(self._side(x, fields, df, current), x) for x in c[2:4]] if c[:2] == ("op", "==") else []
            pair.sort(key=lambda p: sorted(p[0]))
            if [s for s, _ in pair] == [{"in"}, {"out"}]:
                equal.append((pair[0][1], pair[1][1]))
            else:
                mixed.append(c)
        value = self._value(how, of, t)
        # what the row gives: the sides of equations, and whatever else conditions name
        d, given = df, []

        def give(e: tuple) -> tuple:
            nonlocal d
            e, d, _ = self.decorrelated(e, d, current)
            if e[0] == "outer":
                e = e[1]
            name = f"_given{n}_{len(given)}"
            d = d.withColumn(name, self.expr(e, d, current))
            given.append(name)
            return "column", name

        def outside(e: Any) -> Any:
            if isinstance(e, tuple) and e and isinstance(e[0], str) and e[0] in ("name", "outer"):
                return give(e) if self._side(e, fields, df, current) == {"out"} else e
            return type(e)(outside(x) for x in e) if isinstance(e, (tuple, list)) else e

        into, keys = f"_of{n}", []
        # equations with the row's values group the store once, and one join finds each row's group
        pairs = [(self.expr(i, t, None), give(o)[1]) for i, o in equal]
        if mixed:
            mixed = [outside(c) for c in mixed]
            # one comparison for each distinct set of values, not for each row
            seen = d.select(*given).distinct()
            both = seen.crossJoin(t)
            for inner, name in pairs:
                both = both.filter(Semantics(both).equal(inner, F.col(name)))
            for c in mixed:
                both = both.filter(Semantics(both).holds(self.expr(c, both, None)))
            keys = [f"_key{n}_{i}" for i in range(len(given))]
            g = both.groupBy(*[F.col(x).alias(k) for x, k in zip(given, keys, strict=True)]).agg(value.alias(into))
            on = [F.col(x).eqNullSafe(F.col(k)) for x, k in zip(given, keys, strict=True)]
        else:
            keys = [f"_key{n}_{i}" for i in range(len(pairs))]
            g = t.groupBy(*[c.alias(k) for (c, _), k in zip(pairs, keys, strict=True)]).agg(value.alias(into))
            shown = d.select(*[x for _, x in pairs]).limit(0).crossJoin(g.limit(0)) if pairs else None
            on = [Semantics(shown).equal(F.col(k), F.col(x)) for (_, x), k in zip(pairs, keys, strict=True)]
        if on:
            cond = on[0]
            for c in on[1:]:
                cond = cond & c
            d = d.join(g, cond, "left")
        else:
            # the same for every row: one row of totals
            d = d.crossJoin(F.broadcast(g)) if d.columns else g
        empty = {"count": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "sum": F.lit(0.0)}
        if how in ("any", "some", "exists"):
            d = d.withColumn(into, F.coalesce(F.col(into) > 0, F.lit(False)))
        elif how in empty:
            d = d.withColumn(into, F.coalesce(into, empty[how]))
        d = d.drop(*keys)
        return ("column", into), d, [*given, into]

    def _value(self, how: str, of: tuple | None, t: DataFrame) -> Column:
        """An aggregate over a store's records, of what `of` names in each."""
        if how in ("count", "length", "any", "some", "exists"):
            return F.count(F.lit(1))
        if of is None:
            raise SyntaxFault(f"{how} of a store says of what")
        of = _renamed(of[2], of[1][0], _RECORD) if of[0] == "lambda" else of
        s = Semantics(t)
        x = s.number(self.expr(of, t, None))
        return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[how](x.cast("double"))

    def _takes(self, pattern, t: T.DataType, c: Column, s: Semantics, bound: dict[str, Column]) -> Column:
        """Whether a value of type t fits a pattern; names it binds go to `bound`.
        A name is a schema's, or if it begins with a small letter one to bind."""
        if pattern == "_":
            return F.lit(True)
        if isinstance(pattern, str):
            if pattern in self.p.schemas:
                return self.p.schemas[pattern].fits(c, t)
            if pattern[0].islower():
                bound[pattern] = c
                return F.lit(True)
            return F.lit(False)
        if pattern[0] == "fields":
            ok = c.isNotNull()
            for name, sub in pattern[1]:
                if not isinstance(t, T.StructType) or name not in t.fieldNames():
                    return F.lit(False)
                if isinstance(sub, str) or sub[0] in ("fields", "empty", "each"):
                    ok = ok & c[name].isNotNull() & self._takes(sub, t[name].dataType, c[name], s, bound)
                else:
                    ok = ok & s.equal(c[name], self.expr(sub, s.df, None))
            return F.coalesce(ok, F.lit(False))
        if not isinstance(t, T.ArrayType):
            return F.lit(False)
        if pattern[0] == "empty":
            return F.coalesce(F.size(c) == 0, F.lit(False))
        if pattern[1] not in self.p.schemas:
            return F.lit(False)
        every = F.forall(c, lambda x: self.p.schemas[pattern[1]].fits(x, t.elementType))
        return F.coalesce(every, F.lit(False))

    def _match(self, step, ctx, df, current):
        _, source, arms = step
        d = self._bind(df, source, current, "_source")
        bindings, arm = [], None
        for k, (pattern, guard, _) in enumerate(arms):
            bound: dict[str, Column] = {}
            hit = self._takes(pattern, d.schema["_source"].dataType, F.col("_source"), Semantics(d), bound)
            if taken := set(bound) & set(df.columns):
                raise SyntaxFault(f"{taken.pop()} has a value already")
            bindings.append(bound)
            if guard is not None:
                with_names = d.withColumns(bound) if bound else d
                inside = None if source == ("lit", True) else "_source"
                guard, with_names, extra = self.decorrelated(guard, with_names, inside or current)
                # of records of another shape a guard may name what they don't have
                self._here.lenient = self._mine("lenient", int) + (pattern != "_")
                truth = Semantics(with_names).truthy(self.expr(guard, with_names, inside or current))
                self._here.lenient -= pattern != "_"
                d = with_names.withColumn(f"_hit{k}", hit & truth).drop(*bound, *extra)
                hit = F.col(f"_hit{k}")
            arm = F.when(hit, F.lit(k)) if arm is None else arm.when(hit, F.lit(k))
        d = d.withColumn("_arm", arm.otherwise(F.raise_error(F.lit("no arm matches")).cast("int"))).drop(*[f"_hit{k}" for k in range(len(arms))])
        out = []
        for k, (_, _, what) in enumerate(arms):
            part = d.filter(F.col("_arm") == k).drop("_arm")
            if bindings[k]:
                part = part.withColumns(bindings[k])
            if what[0] == "abort":
                part = part.filter(F.raise_error(F.lit(what[1])).cast("boolean"))
                out.append(part.drop("_source"))
            elif what[0] == "queue":
                item = F.struct(F.to_json("_source").alias("item"))
                self._put(what[1], part.select(item.alias("_source")), None)
            elif what[0] in ("retry", "jump"):
                if not part.isEmpty():
                    raise M.Retry() if what[0] == "retry" else M.Jump(what[1], what[2])
            elif what[0] == "run":
                # Another action, once, if any row asks for it; the rows go on
                if not part.isEmpty():
                    self.run(self.p.actions[what[1]], ctx, self.spark.range(1).drop("id"), None)
                out.append(part.drop("_source"))
            elif what[0] == "continue":
                out.append(part.drop("_source"))
            elif what[0] == "steps":
                self._here.lenient = self._mine("lenient", int) + (arms[k][0] != "_")
                out.append(self.run(what[1], ctx, part, current).drop("_source"))
                self._here.lenient -= arms[k][0] != "_"
        base = [c for c in df.columns]
        keep = [o.select(*base) for o in out]
        got = keep[0] if keep else df.limit(0)
        for o in keep[1:]:
            got = got.unionByName(o)
        return got

    def _wait(self, step, ctx, df, current):
        """The first events of a path, those that come before the timeout; a filter is
        asked of each body and keeps an event for which it has no value."""
        o = step[1]
        if self.events is None:
            raise LookupError("no events are given")
        e = self.events(self.spark, o["path"][1] if "path" in o else "")
        limit = int(o["expectedEvents"][1]) if "expectedEvents" in o else 1
        e = e.orderBy("receivedAt", "id").limit(limit)
        if "timeout" in o:
            start = e.agg(F.min("receivedAt").alias("_start"))
            until = F.col("_start") + F.make_dt_interval(secs=F.lit(o["timeout"][1] / 1000))
            e = e.crossJoin(F.broadcast(start)).filter(F.col("receivedAt") <= until).drop("_start")
        e = e.withColumnRenamed("body", "response")
        if "eventFilter" in o:
            e = e.filter(F.coalesce(Semantics(e).truthy(self.expr(o["eventFilter"], e, "response")), F.lit(True)))
        if "storage" in o:
            held = o["storage"]
            key = self.expr(held["key"], e, "response") if "key" in held else F.col("id")
            self._put(held["target"][1], e.withColumn("_source", F.struct("response.*")), key)
        return e.select("response")

    def _fetch(self, step, ctx, df, current):
        _, verb, target, opts = step
        name = opts["source"][1] if "source" in opts else target.split(".")[0] if verb == "call" else next(iter(self.p.sources), None)
        if name not in self.sources:
            raise LookupError(f"no reader is given for source {name}")
        key, since = self._since(name, target, opts)
        if isinstance(self.sources[name], Endpoint):
            out = self._ask(name, verb, target, opts, since, df, current)
            self._synced(key, opts, out)
            return out
        path = target if verb == "call" else target[1]
        if self.dry_run:
            # A reader says by `sample` what a dry run sees; without it nothing is asked
            sample = getattr(self.sources[name], "sample", None)
            if sample is None:
                return df.limit(0).withColumn("response", F.struct())
            got = mock_rows(self.spark, sample, 1)
            return got.select(F.struct(*[F.col(c) for c in got.columns]).alias("response"))
        got = self.sources[name](self.spark, {"verb": verb, "path": path, "options": opts, "frame": df, "params": since})
        out = got.select(F.struct(*[F.col(c) for c in got.columns]).alias("response"))
        if key is not None:
            out = settle(out)  # what is stored and what the checkpoint is taken from are one answer
        self._synced(key, opts, out)
        return out

    def _since(self, source: str, target, opts: dict) -> tuple[str | None, dict[str, str]]:
        """The key of the request's checkpoint and the parameter that asks for what is later."""
        if "since" not in opts:
            return None, {}
        kind, value, *more = opts["since"]
        if kind == "value":
            one = self.spark.range(1)
            got = one.select(Semantics(one).string(self.expr(value, one, None))).first()[0]
            return None, {self._text(opts.get("sinceParam"), "since"): got}
        o = more[0]
        key = value or self._text(opts.get("syncKey"), checkpoint_key(source, target if isinstance(target, str) else str(target[1])))
        param = self._text(o.get("param") or opts.get("sinceParam"), "since")
        wanted = self._text(o.get("format") or opts.get("sinceFormat"), "iso")
        kinds = {"ISO": "iso", "YYYY-MM-DD": "date-only", "timestamp": "unix"}
        mark = format_since(F.lit(self.marks.last(key)).cast("timestamp"), kinds.get(wanted, wanted))
        return key, {param: self.spark.range(1).select(mark).first()[0]}

    @staticmethod
    def _text(e: tuple | None, default: str) -> str:
        return default if e is None else str(e[1])

    def _synced(self, key: str | None, opts: dict, out: DataFrame) -> None:
        """The request's new checkpoint: the latest time its answers name (updateFrom), else
        that of planning, which is before anything is asked, so that nothing is lost between."""
        if key is None or self.dry_run:
            return
        path = opts["since"][2].get("updateFrom")
        if path is None:
            at = self.spark.range(1).select(F.lit(datetime.now(UTC)).cast("timestamp").alias("_at"))
        else:
            c = self.name("response." + self._text(path, ""), out, None)
            if c is None:
                raise LookupError(f"answers have no {path[1]}")
            c = F.array_max(F.transform(c, lambda x: parse_since(x.cast("string")))) if isinstance(Semantics(out).type_of(c), T.ArrayType) else parse_since(c.cast("string"))
            at = out.select(c.alias("_at"))
        self.marks = self.marks.advance(key, at, "_at", self.p.name)

    def _ask(self, name: str, verb: str, target, opts: dict, since: dict[str, str], df: DataFrame, current: str | None) -> DataFrame:
        """A request for each row of df, with its own path, parameters, body
        and headers. What only reads, or can be repeated, is asked once for all rows that ask the
        same; a post or patch is sent for each row. Answers are a table before they are used."""
        source: Endpoint = self.sources[name]
        if unknown := set(opts) - _OPTIONS:
            raise SyntaxFault(f"a request has no {unknown.pop()}")
        described = None
        if verb == "call":
            described = source.operation(target.split(".", 1)[1])
            verb, template = described.verb, ("lit", described.path)
        else:
            template = target
        paging = None
        if "paginate" in opts:
            _, kind, args = opts["paginate"]
            param, size = args[0][1], int(args[1][1])
            paging = Cursor(param, size, args[2][1]) if kind == "cursor" else {"offset": Offset, "page": Page}[kind](param, size)
        kind = source.answer_type(described, paging is not None)
        d = df if df.columns else self.spark.range(1).select(F.lit(0).alias("_row"))
        if self.dry_run:
            answer = mock_value(source.sample or (described.response if described and described.response else {"type": "object"}))
            return d.withColumn("response", F.from_json(F.lit(json.dumps([answer] if paging and not isinstance(answer, list) else answer)), kind)).drop("_row")
        params = dict(opts.get("params", {}))
        (template, params, body, own), d, extra = self.decorrelated((template, params, opts.get("body"), {**self.p.sources.get(name, {}).get("headers", {}), **opts.get("headers", {})}), d, current)
        if template[0] == "lit":
            scope = {}
            for place in re.findall(r"\{([^}]+)\}", template[1]):
                got = self.expr(params.pop(place), d, current) if described and place in params else self.name(place, d, current)
                if got is not None:
                    scope[place] = got
            path = self._path(template[1], d, scope)
        else:
            path = Semantics(d).string(self.expr(template, d, current))
        fields = [self.expr(v, d, current).alias(k) for k, v in params.items()]
        fields += [F.lit(v).alias(k) for k, v in since.items()]
        none = F.lit(None).cast("string")
        text = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}) if cols else none
        heads = [Semantics(d).string(self.expr(v, d, current)).alias(k) for k, v in own.items()]
        timeout = opts["timeout"][1] / 1000 if "timeout" in opts else None
        if (heads or timeout is not None) and not (is_dataclass(source.client) and hasattr(source.client, "headers")):
            raise SyntaxFault(f"the client of {name} takes no headers and no timeout")
        d = d.withColumns({PATH: path, PARAMS: text(fields), BODY: none if body is None else text([self.expr(body, d, current).alias("body")]), HEADERS: text(heads)})
        each = none
        if verb in ("post", "patch"):
            # places of the loops' elements if there are any: they are the same in a later run
            places = [F.col(c) for c in d.columns if c.startswith(_PLACE)]
            each = F.to_json(F.struct(*places)) if places else F.monotonically_increasing_id()
        what = f"{self.p.name}:{next(self._steps)}:{name}:{verb}:{opts.get('paginate')}:{opts.get('until')}"
        d = d.withColumn(KEY_, request_key(F.lit(what), F.col(PATH), F.col(PARAMS), F.col(BODY), F.col(HEADERS), each))
        until = page_condition(opts["until"]) if "until" in opts else None
        asked = source.with_auth(self.auth.get(name)).with_retry(_backoff(opts["retry"]) if "retry" in opts else None)
        got = self.log.ask(d, asked.ask(verb, paging, until, timeout))
        return got.withColumn("response", F.from_json(ANSWER, kind)).drop("_row", ANSWER, *extra)

    def _path(self, template: str, d: DataFrame, scope: dict[str, Column]) -> Column:
        s, parts = Semantics(d), []
        for k, piece in enumerate(re.split(r"\{([^}]+)\}", template)):
            parts.append(F.lit(piece) if k % 2 == 0 else s.string(scope[piece], "") if piece in scope else F.lit(""))
        return F.concat(*parts)


# The options a request knows.
_OPTIONS = {"source", "params", "body", "headers", "timeout", "paginate", "until", "since", "sinceParam", "sinceFormat", "syncKey", "retry", "validate"}


def _backoff(o: dict[str, tuple]) -> Backoff:
    """H2 as a request's `retry` says it."""
    names = {"maxAttempts": "attempts", "backoff": "kind", "initialDelay": "initial", "maxDelay": "most"}
    return Backoff(**{names[k]: v[1] if k == "backoff" else int(v[1]) for k, v in o.items()})


def page_condition(e: tuple) -> Callable[[object], bool]:
    """A condition of one page of JSON, asked where the page is read. What a page doesn't
    have is null; null is neither more nor less than anything."""

    def value(e: tuple, page: object) -> Any:
        kind = e[0]
        if kind == "lit":
            return e[1]
        if kind == "name":
            parts = e[1].split(".")
            for p in parts[1:] if parts[0] == "response" else parts:
                page = page.get(p) if isinstance(page, dict) else None
            return page
        if kind == "not":
            return not value(e[1], page)
        if kind == "call" and e[1] in ("length", "count"):
            got = value(e[2][0], page)
            return len(got) if isinstance(got, (list, str)) else 0
        if kind == "op":
            a, b = value(e[2], page), value(e[3], page)
            if e[1] in ("and", "or"):
                return bool(a) and bool(b) if e[1] == "and" else bool(a) or bool(b)
            if e[1] in ("==", "!="):
                alike = isinstance(a, bool) == isinstance(b, bool) and a == b
                return alike == (e[1] == "==")
            if e[1] in ("<", ">", "<=", ">="):
                if a is None or b is None:
                    return False
                return {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}[e[1]](a, b)
        raise SyntaxFault(f"a page's condition has no {e[1] if kind in ('op', 'call') else kind}")

    value(e, {})  # a fault is told now, not on an executor
    return lambda page: bool(value(e, page))


def _conjuncts(e: tuple) -> list[tuple]:
    """The parts of a condition that must all hold."""
    return [*_conjuncts(e[2]), *_conjuncts(e[3])] if e[:2] == ("op", "and") else [e]


def read_folder(files: dict[str, str]) -> Program:
    """A mission of several files, by name: one named mission.* (or the only one with a
    mission in it), the others with actions alone. Two actions of one name are a fault."""
    root = next((n for n in sorted(files) if n.startswith("mission.")), None)
    if root is None:
        roots = [n for n, t in files.items() if any(x.text == "mission" for x in tokens(t)[:1])]
        if len(roots) != 1:
            raise SyntaxFault("a folder has one mission")
        root = roots[0]
    p = Reader(files[root]).mission()
    for name in sorted(files):
        if name == root:
            continue
        r = Reader(files[name])
        while r.now.kind != "end":
            r.need("action")
            action = r.need("name")
            if action in p.actions:
                raise SyntaxFault(f"{name}: two actions named {action}")
            p.actions[action] = r.block()
    check_names(p)
    return p


def run(text: str, spark: SparkSession, stores: dict[str, DataFrame] | None = None, sources: dict[str, Fetch] | None = None, events: Callable[[SparkSession, str], DataFrame] | None = None, marks: Watermarks | None = None, log: RequestLog | None = None, auth: dict[str, Any] | None = None, executions: M.Executions | None = None, resume: bool = False, **kw) -> M.Mission:
    """Parse, compile and run a mission; its stores and checkpoints are in the result. `log`
    keeps answers for a later run of the mission; `auth` has each source's credentials (H5).
    `executions` keeps its stages, and with `resume` the newest that did not complete goes on."""
    c = Compiler(parse(text), spark, Catalog(spark, stores), sources, events, marks, log, auth)
    m = c.build(**kw)
    m.run(executions.reopen(m) if executions and resume else None, executions)
    m.marks = c.marks
    return m
