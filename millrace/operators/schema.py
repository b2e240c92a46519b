"""Declared schemas as predicates over records (R12, section 1.2).

A schema is open: it says which fields a record must have and of what kind, nothing about
others. Against a typed DataFrame most of it is decided when the plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class Field:
    name: str
    kind: str  # a primitive's name, "collection", "reference" or another schema's name
    optional: bool = False


@dataclass
class Schema:
    name: str
    fields: list[Field] = field(default_factory=list)

    @classmethod
    def of(cls, name: str, /, **kinds: str) -> Schema:
        """Schema.of("User", id="int", email="string?")"""
        return cls(name, [Field(k, v.rstrip("?"), v.endswith("?")) for k, v in kinds.items()])

    def matches(self, df: DataFrame, record: str | None = None) -> Column:
        """Whether each row (or its struct column `record`) fits."""
        if record:
            return self.fits(F.col(record), df.schema[record].dataType)
        return self._all(df.schema, lambda n: F.col(f"`{n}`"), F.lit(True))

    def fits(self, c: Column, t: T.DataType) -> Column:
        """Whether a value of static type t fits; only records do."""
        if not isinstance(t, T.StructType):
            return F.lit(False)
        return self._all(t, lambda n: c[n], c.isNotNull())

    def _all(self, t: T.StructType, get: Callable[[str], Column], ok: Column) -> Column:
        for f in self.fields:
            if f.name not in t.fieldNames():
                if not f.optional:
                    return F.lit(False)
                continue
            c = get(f.name)
            fits = kind_fits(c, t[f.name].dataType, f.kind)
            ok = ok & ((c.isNull() | fits) if f.optional else (c.isNotNull() & fits))
        return F.coalesce(ok, F.lit(False))


def kind_fits(c: Column, t: T.DataType, kind: str) -> Column:
    """Whether a value of static type t is of a declared kind. Unknown kinds fit anything."""
    k = kind.lower()
    if k in ("string",):
        return F.lit(isinstance(t, T.StringType))
    if k in ("int", "integer"):
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return F.lit(True)
        return c == F.floor(c) if isinstance(t, _NUMBER) else F.lit(False)
    if k in ("number", "decimal", "float", "double", "range"):
        return F.lit(isinstance(t, _NUMBER))
    if k in ("boolean", "bool"):
        return F.lit(isinstance(t, T.BooleanType))
    if k in ("date", "datetime"):
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(True)
        return c.try_cast("timestamp").isNotNull() if isinstance(t, T.StringType) else F.lit(False)
    if k in ("collection", "tuple"):
        return F.lit(isinstance(t, T.ArrayType))
    if k == "reference":
        return F.lit(isinstance(t, (T.StructType, T.MapType, T.ArrayType)))
    return F.lit(True)


def variant_matches(record: Column, schema: Schema) -> Column:
    """The same over a VARIANT record, whose rows may differ in shape."""
    ok = F.lit(True)
    for f in schema.fields:
        path = f"$.{f.name}"
        v = F.try_variant_get(record, path, "variant")
        t = F.schema_of_variant(v)
        there = v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))
        k = f.kind.lower()
        if k == "string":
            fits = t == "STRING"
        elif k in ("int", "integer"):
            d = F.try_variant_get(record, path, "double")
            fits = t.isin("BIGINT", "INT", "DOUBLE", "FLOAT") & (d == F.floor(d)) | (t.startswith("DECIMAL") & (d == F.floor(d)))
        elif k in ("number", "decimal", "float", "double", "range"):
            fits = t.isin("BIGINT", "INT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
        elif k in ("boolean", "bool"):
            fits = t == "BOOLEAN"
        elif k in ("date", "datetime"):
            fits = (t == "STRING") & F.try_variant_get(record, path, "string").try_cast("timestamp").isNotNull()
        elif k in ("collection", "tuple"):
            fits = t.startswith("ARRAY")
        elif k == "reference":
            fits = t.startswith("OBJECT") | t.startswith("ARRAY")
        else:
            fits = F.lit(True)
        ok = ok & F.coalesce((~there | fits) if f.optional else (there & fits), F.lit(False))
    return ok


WILDCARD = Schema("_")
