"""OpenAPI descriptions (S2, S10, S18, H7): operations, types, mock rows, violations."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Operation:
    verb: str
    path: str
    response: dict | None


def deref(spec: dict, node, depth: int = 0):
    """node with its local references replaced; a reference into itself ends as {}."""
    if depth > 20:
        return {}
    if isinstance(node, list):
        return [deref(spec, x, depth + 1) for x in node]
    if not isinstance(node, dict):
        return node
    if "$ref" in node:
        at = spec
        for p in node["$ref"].lstrip("#/").split("/"):
            at = at[p.replace("~1", "/").replace("~0", "~")]
        return deref(spec, at, depth + 1)
    return {k: deref(spec, v, depth + 1) for k, v in node.items()}


def load(text: str) -> tuple[str, dict[str, Operation]]:
    """Base address and operations by operationId, from JSON."""
    spec = json.loads(text)
    ops = {}
    for path, verbs in spec.get("paths", {}).items():
        for verb, op in verbs.items():
            if isinstance(op, dict) and "operationId" in op:
                content = op.get("responses", {}).get("200", {}).get("content", {}).get("application/json", {})
                ops[op["operationId"]] = Operation(verb, path, deref(spec, content.get("schema")))
    return (spec.get("servers") or [{"url": ""}])[0]["url"], ops


def spark_type(s: dict) -> T.DataType:
    for many in ("allOf",):
        if many in s:
            props: dict = {}
            for x in s[many]:
                props |= x.get("properties", {})
            return spark_type({"type": "object", "properties": props})
    for one in ("oneOf", "anyOf"):
        if s.get(one):
            return spark_type(s[one][0])
    kind = s.get("type", "object" if "properties" in s else "string")
    if kind == "array":
        return T.ArrayType(spark_type(s.get("items", {})))
    if kind == "object":
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in s.get("properties", {}).items()])
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


def mock_value(s: dict, depth: int = 3):
    """The first enum value, else the example, else the default, else one by type."""
    if s.get("enum"):
        return s["enum"][0]
    for k in ("example", "default"):
        if k in s:
            return s[k]
    if "allOf" in s:
        out: dict = {}
        for x in s["allOf"]:
            got = mock_value(x, depth)
            out |= got if isinstance(got, dict) else {}
        return out
    for k in ("oneOf", "anyOf"):
        if s.get(k):
            return mock_value(s[k][0], depth)
    kind = s.get("type", "object" if "properties" in s else "string")
    if kind == "array":
        return [mock_value(s.get("items", {}), depth - 1) for _ in range(2)] if depth > 0 else []
    if kind == "object":
        return {k: mock_value(v, depth - 1) for k, v in s.get("properties", {}).items()} if depth > 0 else {}
    samples = {"integer": max(1, int(s.get("minimum", 1))), "number": float(s.get("minimum", 1.5)), "boolean": True}
    formats = {"date": "2024-01-01", "date-time": "2024-01-01T00:00:00Z", "email": "user@example.com", "uuid": "00000000-0000-4000-8000-000000000000", "uri": "https://example.com"}
    return samples.get(kind, formats.get(s.get("format", ""), "string"))


def mock_rows(spark: SparkSession, s: dict, n: int) -> DataFrame:
    """n equal rows of a record's sample, as typed columns."""
    kind = spark_type(s)
    sample = F.from_json(F.lit(json.dumps(mock_value(s))), kind)
    return spark.range(n).select(sample.alias("r")).select("r.*")


def checks(c: Column, s: dict, path: str, t: T.DataType) -> list[tuple[str, str, Column]]:
    """(path, message, broken) for each rule about a value of static type t."""
    out: list[tuple[str, str, Column]] = []
    some = c.isNotNull()
    if not s.get("nullable", False):
        pass  # a null of an optional field is an absent one; required fields are below
    if s.get("enum"):
        out.append((path, f"not one of {s['enum']}", some & ~c.isin(s["enum"])))
    if isinstance(t, T.StringType):
        n = F.char_length(c)
        if "minLength" in s:
            out.append((path, f"shorter than {s['minLength']}", some & (n < s["minLength"])))
        if "maxLength" in s:
            out.append((path, f"longer than {s['maxLength']}", some & (n > s["maxLength"])))
        if "pattern" in s:
            out.append((path, f"does not match {s['pattern']}", some & ~c.rlike(s["pattern"])))
    if isinstance(t, (T.LongType, T.IntegerType, T.DoubleType)):
        if "minimum" in s:
            out.append((path, f"below {s['minimum']}", some & (c < s["minimum"])))
        if "maximum" in s:
            out.append((path, f"above {s['maximum']}", some & (c > s["maximum"])))
        if s.get("type") == "integer" and isinstance(t, T.DoubleType):
            out.append((path, "not an integer", some & (c != F.floor(c))))
    if isinstance(t, T.ArrayType):
        if "minItems" in s:
            out.append((path, f"fewer than {s['minItems']} items", some & (F.size(c) < s["minItems"])))
        if "maxItems" in s:
            out.append((path, f"more than {s['maxItems']} items", some & (F.size(c) > s["maxItems"])))
        if "items" in s:
            for i, (p, m, _) in enumerate(checks(F.lit(None).cast(t.elementType), s["items"], path + "[]", t.elementType)):
                out.append((p, m, some & F.exists(c, _element_breaks(i, s["items"], path, t.elementType))))
    if isinstance(t, T.StructType):
        names = t.fieldNames()
        for r in s.get("required", []):
            out.append((f"{path}.{r}".lstrip("."), "required", some & c[r].isNull() if r in names else some))
        if s.get("additionalProperties") is False:
            for x in names:
                if x not in s.get("properties", {}):
                    out.append((f"{path}.{x}".lstrip("."), "not allowed", some & c[x].isNotNull()))
        for k, v in s.get("properties", {}).items():
            if k in names:
                out += checks(c[k], v, f"{path}.{k}".lstrip("."), t[k].dataType)
    for many in ("oneOf", "anyOf"):
        if s.get(many):
            ways = [[b for *_, b in checks(c, x, path, t)] for x in s[many]]
            good = F.lit(False)
            for w in ways:
                bad = F.lit(False)
                for b in w:
                    bad = bad | F.coalesce(b, F.lit(False))
                good = good | ~bad
            out.append((path, f"fits none of {many}", some & ~good))
    return out


def _element_breaks(i: int, s: dict, path: str, t: T.DataType):
    """Whether an array's element breaks the i-th rule of its schema."""
    return lambda x: F.coalesce(checks(x, s, path + "[]", t)[i][2], F.lit(False))


def violations(df: DataFrame, s: dict, key: str) -> DataFrame:
    """H7: (key, path, message), a row for each broken rule, in one pass without a shuffle."""
    record = F.struct(*[F.col(c) for c in df.columns])
    found = [F.when(b, F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, m, b in checks(record, s, "", df.select(record.alias("r")).schema[0].dataType)]
    if not found:
        return df.limit(0).select(F.col(key), F.lit("").alias("path"), F.lit("").alias("message"))
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*found))).alias("v")).select(key, "v.*")


def enforce(df: DataFrame, s: dict, key: str, mode: str = "warning") -> tuple[DataFrame, DataFrame]:
    """What goes on and the violations: all rows (warning, off), only rows without a
    violation (split); strict raises at the first when run."""
    if mode == "off":
        return df, violations(df, s, key).limit(0)
    v = violations(df, s, key)
    if mode == "warning":
        return df, v
    record = F.struct(*[F.col(c) for c in df.columns])
    bad = F.lit(False)
    for *_, b in checks(record, s, "", df.select(record.alias("r")).schema[0].dataType):
        bad = bad | F.coalesce(b, F.lit(False))
    if mode == "split":
        return df.filter(~bad), v
    return df.filter(F.when(bad, F.raise_error(F.lit("response does not fit its schema")).cast("boolean")).otherwise(True)), v
