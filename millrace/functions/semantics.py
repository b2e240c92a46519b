"""Dynamic-language expression semantics as typed Columns.

The pipelines this engine runs were written for values whose type is known only when they
are met. Spark knows types when a plan is built, so each rule is chosen here by type, once,
and what runs is an ordinary Catalyst expression. A missing field and an explicit null are
both NULL; where the difference matters, records are VARIANT (see `is_missing`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


class Semantics:
    """Rules for the columns of one DataFrame. `lenient` turns what would raise into NULL."""

    def __init__(self, df: DataFrame, lenient: bool = False):
        self.df, self.lenient = df, lenient

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(_col(c).alias("x")).schema[0].dataType

    # --- conversion ---------------------------------------------------------------------
    def truthy(self, c) -> Column:
        """False, 0, NaN, '' and NULL are falsy; arrays and records never are."""
        c = _col(c)
        t = self.type_of(c)
        if isinstance(t, T.BooleanType):
            yes = c
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            yes = (c != 0) & ~F.isnan(c)
        elif isinstance(t, _NUMERIC):
            yes = c != 0
        elif isinstance(t, T.StringType):
            yes = c != ""
        elif isinstance(t, T.NullType):
            return F.lit(False)
        else:
            yes = c.isNotNull()
        return F.coalesce(yes, F.lit(False))

    def holds(self, c) -> Column:
        """A condition for `filter`, which drops NULL as it drops false: a comparison stays as
        it is, so that Spark can push it into the scan."""
        c = _col(c)
        return c if isinstance(self.type_of(c), T.BooleanType) else self.truthy(c)

    def number(self, c) -> Column:
        """Numbers stay, booleans are 0 or 1, text is parsed ('' and blanks are 0).
        Anything else raises, or is NULL when lenient."""
        c = _col(c)
        t = self.type_of(c)
        if isinstance(t, _NUMERIC):
            got = c.cast("double")
        elif isinstance(t, T.BooleanType):
            got = c.cast("int").cast("double")
        elif isinstance(t, T.StringType):
            s = F.trim(c)
            got = F.when(s == "", F.lit(0.0)).otherwise(s.try_cast("double"))
        else:
            got = F.lit(None).cast("double")
        if self.lenient:
            return got
        return F.when(got.isNull(), F.raise_error(F.lit("value is not a number")).cast("double")).otherwise(got)

    def string(self, c, missing: str | None = "null") -> Column:
        """100 is '100', 1.5 is '1.5', 3.0 is '3'; NULL is `missing`."""
        c = _col(c)
        t = self.type_of(c)
        if isinstance(t, (T.FloatType, T.DoubleType)):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            got = F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
        elif isinstance(t, T.ArrayType):
            got = F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "")
        elif isinstance(t, T.StructType):
            got = F.when(c.isNotNull(), F.lit("[object Object]"))
        else:
            got = c.cast("string")
        return got if missing is None else F.coalesce(got, F.lit(missing))

    # --- operators ----------------------------------------------------------------------
    def add(self, a, b) -> Column:
        """Text if either side is text (NULL as ''), else a sum."""
        a, b = _col(a), _col(b)
        if isinstance(self.type_of(a), T.StringType) or isinstance(self.type_of(b), T.StringType):
            return F.concat(self.string(a, ""), self.string(b, ""))
        return self.number(a) + self.number(b)

    def subtract(self, a, b) -> Column:
        return self.number(a) - self.number(b)

    def multiply(self, a, b) -> Column:
        return self.number(a) * self.number(b)

    def divide(self, a, b) -> Column:
        """True division; a zero divisor raises, or gives NULL when lenient."""
        if self.lenient:
            return F.try_divide(self.number(a), self.number(b))
        return self.number(a) / self.number(b)

    def modulo(self, a, b) -> Column:
        return F.try_mod(self.number(a), self.number(b)) if self.lenient else self.number(a) % self.number(b)

    def negate(self, a) -> Column:
        return -self.number(a)

    def equal(self, a, b) -> Column:
        """No coercion: values of different kinds are never equal; NULL equals NULL."""
        a, b = _col(a), _col(b)
        ta, tb = self.type_of(a), self.type_of(b)
        if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
            return a.isNull() & b.isNull()
        if self._kind(ta) != self._kind(tb):
            return F.lit(False)
        return a.eqNullSafe(b)

    @staticmethod
    def _kind(t: T.DataType) -> str:
        return "number" if isinstance(t, _NUMERIC) else type(t).__name__

    def compare(self, a, op: str, b, native: bool = False) -> Column:
        """Numeric order. With `native`, dates and text are ordered as such. Of two numbers
        the comparison stands alone, and a null one raises behind it unless lenient; in a
        filter Spark may drop such a row before that."""
        a, b = _col(a), _col(b)
        if isinstance(self.type_of(a), _NUMERIC) and isinstance(self.type_of(b), _NUMERIC):
            plain = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
            if self.lenient:
                return plain
            missing = a.isNull() | b.isNull()
            return plain & F.when(missing, F.raise_error(F.lit("value is not a number")).cast("boolean")).otherwise(F.lit(True))
        if native and self._kind(self.type_of(a)) == self._kind(self.type_of(b)):
            x, y = a, b
        else:
            x, y = self.number(a), self.number(b)
        return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    def both(self, a, b) -> Column:
        """Right value if the left is truthy, else false (right side as a truth value
        where the types differ)."""
        a, b = _col(a), _col(b)
        if isinstance(self.type_of(a), T.BooleanType) and isinstance(self.type_of(b), T.BooleanType):
            return F.coalesce(a, F.lit(False)) & b  # either side can reach a scan
        right = b if isinstance(self.type_of(b), T.BooleanType) else self.truthy(b)
        return F.when(self.truthy(a), right).otherwise(F.lit(False))

    def either(self, a, b) -> Column:
        """True if the left is truthy, else the truth of the right."""
        return F.when(self.truthy(a), F.lit(True)).otherwise(self.truthy(b))

    def default(self, a, b) -> Column:
        """The documented null-coalescing `a or b` and `a ?? b`."""
        return F.coalesce(_col(a), _col(b))

    def negation(self, a) -> Column:
        return ~self.truthy(a)

    def choose(self, cond, a, b) -> Column:
        """E13."""
        return F.when(self.truthy(cond), _col(a)).otherwise(_col(b))

    def match(self, subject, arms: list[tuple], default=None) -> Column:
        """The first arm that is strictly equal; no arm gives NULL."""
        out = None
        for pattern, result in arms:
            hit = self.equal(subject, pattern)
            out = F.when(hit, _col(result)) if out is None else out.when(hit, _col(result))
        return _col(default) if out is None else out.otherwise(_col(default))

    def cases(self, arms: list[tuple], default=None) -> Column:
        """The first arm whose condition is truthy."""
        out = None
        for cond, result in arms:
            hit = self.truthy(cond)
            out = F.when(hit, _col(result)) if out is None else out.when(hit, _col(result))
        return _col(default) if out is None else out.otherwise(_col(default))

    def any_of(self, array: Column, predicate=None) -> Column:
        """The first element that fits, else NULL; without a predicate a random one."""
        if predicate is None:
            return F.try_element_at(F.shuffle(array), F.lit(1))
        return F.try_element_at(F.filter(array, predicate), F.lit(1))

    def is_type(self, c: Column, name: str) -> Column:
        """E21, decided by the column's type; a NULL is of type null and no other."""
        t, name = self.type_of(c), name.lower()
        some = c.isNotNull()
        if name in ("null", "undefined"):
            return c.isNull()
        if name in ("number", "decimal"):
            return some & F.lit(isinstance(t, _NUMERIC))
        if name in ("int", "integer"):
            if isinstance(t, _WHOLE):
                return some
            return F.coalesce(c == F.floor(c), F.lit(False)) if isinstance(t, _NUMERIC) else F.lit(False)
        if name == "date":
            if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                return some
            return c.try_cast("timestamp").isNotNull() if isinstance(t, T.StringType) else F.lit(False)
        kinds = {"array": T.ArrayType, "object": (T.StructType, T.MapType), "string": T.StringType, "boolean": T.BooleanType}
        if name not in kinds:
            raise ValueError(f"unknown type: {name}")
        return some & F.lit(isinstance(t, kinds[name]))

    def interpolate(self, template: str, scope: dict[str, Column] | None = None) -> Column:
        """S3: {path} is the record's field, else the variable; what is missing is ''."""
        import re

        parts: list[Column] = []
        for k, piece in enumerate(re.split(r"\{([^}]+)\}", template)):
            if k % 2 == 0:
                parts += [F.lit(piece)] if piece else []
            else:
                got = resolve(piece, self.df, scope)
                parts.append(F.lit("") if got is None else self.string(got, ""))
        return F.concat(*parts) if parts else F.lit("")


def resolve(name: str, df: DataFrame, scope: dict[str, Column] | None = None, pipe: str | None = None) -> Column | None:
    """A field of the current record, else a bound name, else a field of the piped
    response (a struct column); None where nothing has the name."""

    def walk(t: T.DataType, c: Column, path: list[str]) -> Column | None:
        for p in path:
            if isinstance(t, T.StructType) and p in t.fieldNames():
                t, c = t[p].dataType, c[p]
            elif isinstance(t, T.MapType):
                t, c = t.valueType, c[p]
            else:
                return None
        return c

    head, *rest = name.lstrip(".").split(".")
    if pipe and head == "response":
        return walk(df.schema[pipe].dataType, F.col(pipe), rest)
    if head in df.columns and (got := walk(df.schema[head].dataType, F.col(f"`{head}`"), rest)) is not None:
        return got
    if scope and head in scope:
        c = scope[head]
        return walk(df.select(c.alias("x")).schema[0].dataType, c, rest)
    if pipe:
        return walk(df.schema[pipe].dataType, F.col(pipe), [head, *rest])
    return None


def is_missing(variant: Column, field: str) -> Column:
    """E21 `is undefined`, in a VARIANT record: the field isn't there at all."""
    v = F.try_variant_get(variant, f"$.{field}", "variant")
    return v.isNull()


def is_null(variant: Column, field: str) -> Column:
    """E21 `is null`, in a VARIANT record: the field is there and null."""
    return F.coalesce(F.is_variant_null(F.try_variant_get(variant, f"$.{field}", "variant")), F.lit(False))
