"""The function table (section 2.8): name -> builder of a Column. The first ten are the core;
the others are what pipelines use for text, arrays, records, numbers and dates."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- core ------------------------------------------------------------------------------------


def js_round(x: Column, digits: int | None = None) -> Column:
    """Half up, toward positive infinity: -2.5 is -2."""
    if not digits:
        return F.floor(x + F.lit(0.5)).cast("double")
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


CORE: dict[str, Callable[..., Column]] = {
    "length": lambda x, array=False: F.coalesce(F.size(x) if array else F.char_length(x), F.lit(0)),
    "sum": array_sum,
    "count": lambda a: F.coalesce(F.size(a), F.lit(0)),
    "first": lambda a: F.try_element_at(a, F.lit(1)),
    "last": lambda a: F.try_element_at(a, F.lit(-1)),
    "round": js_round,
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "now": now,
    "env": lambda name: F.lit(os.environ.get(name, "")),
}

# --- text ------------------------------------------------------------------------------------


def substring(s: Column, start: int, end: int | None = None) -> Column:
    """From a 0-based start up to, not including, end."""
    return F.substring(s, F.lit(start + 1), F.lit(max(0, end - start)) if end is not None else F.char_length(s))


STRING: dict[str, Callable[..., Column]] = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "substring": substring,
    "split": lambda s, by: F.split(s, re.escape(by), -1),
    "join": lambda a, by: F.array_join(a, by),
    "trim": F.trim,
    "trimStart": F.ltrim,
    "trimEnd": F.rtrim,
    "replace": lambda s, old, new: F.replace(s, F.lit(old), F.lit(new)),
    "concat": lambda *s: F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in s]),
    "contains": lambda s, x: s.contains(x),
    "startsWith": lambda s, x: s.startswith(x),
    "endsWith": lambda s, x: s.endswith(x),
    "slugify": lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", ""),
}

# --- arrays ----------------------------------------------------------------------------------

ARRAY: dict[str, Callable[..., Column]] = {
    "includes": lambda a, x: F.array_contains(a, x),
    "isEmpty": lambda a: F.coalesce(F.size(a) == 0, F.lit(True)),
    "map": F.transform,
    "filter": F.filter,
    "reduce": lambda a, zero, f: F.aggregate(a, zero, f),
    "concat_arrays": F.concat,
    "flatten": F.flatten,
    "unique": F.array_distinct,
    "sort": lambda a: F.array_sort(a),
    "sortBy": lambda a, key: F.array_sort(a, lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)),
    "find": lambda a, p: F.try_element_at(F.filter(a, p), F.lit(1)),
    "findIndex": lambda a, p: F.coalesce(F.array_position(F.transform(a, lambda x: F.coalesce(p(x), F.lit(False))), True), F.lit(0)).cast("int") - 1,
    "at": lambda a, i: F.get(a, F.lit(i)),
    "array_min": F.array_min,
    "array_max": F.array_max,
    "array_avg": lambda a: F.when(F.size(a) > 0, array_sum(a) / F.size(a)),
    "weighted_sum": lambda a, x, y: F.aggregate(a, F.lit(0.0), lambda acc, r: acc + r[x].cast("double") * r[y].cast("double")),
}

# --- records and maps ------------------------------------------------------------------------

OBJECT: dict[str, Callable[..., Column]] = {
    "keys": F.map_keys,
    "values": F.map_values,
    "entries": F.map_entries,
    "hasKey": lambda m, k: F.map_contains_key(m, k),
    "pick": lambda s, *names: F.struct(*[s[n].alias(n) for n in names]),
    "omit": lambda s, *names: s.dropFields(*names),
    "merge": lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b),
    "json_keys": F.json_object_keys,
    "spread": lambda s, **fields: _with_fields(s, fields),
}


def _with_fields(s: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        s = s.withField(name, value)
    return s


# --- numbers ---------------------------------------------------------------------------------

MATH: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "min": lambda *x: F.least(*x),
    "max": lambda *x: F.greatest(*x),
    "pow": F.pow,
    "sqrt": F.sqrt,
    "mod": lambda a, b: a % b,
}

# --- conversion ------------------------------------------------------------------------------

CONVERSION: dict[str, Callable[..., Column]] = {
    "toNumber": lambda x: x.try_cast("double"),
    "toString": lambda x: x.cast("string"),
    "toBoolean": lambda x: F.coalesce(F.lower(x.cast("string")).isin("true", "1", "yes"), F.lit(False)),
    "toArray": lambda *x: F.array(*x),
    "parseDecimal": lambda x, p=38, s=10: x.try_cast(f"decimal({p},{s})"),
    "exists": lambda x: x.isNotNull(),
    "uuid": lambda: F.uuid(),
    "generateId": lambda: F.uuid(),
}

# --- dates -----------------------------------------------------------------------------------

# Date tokens of pipeline texts and the patterns they stand for.
DATE_TOKENS = (("YYYY", "yyyy"), ("YY", "yy"), ("DD", "dd"), ("D", "d"), ("A", "a"))


def date_pattern(tokens: str) -> str:
    for a, b in DATE_TOKENS:
        tokens = re.sub(rf"(?<![A-Za-z]){a}(?![A-Za-z])", b, tokens)
    return tokens


DATE: dict[str, Callable[..., Column]] = {
    "parseDate": lambda s, fmt=None: F.try_to_timestamp(s, F.lit(date_pattern(fmt))) if fmt else F.try_to_timestamp(s),
    "formatDate": lambda d, fmt: F.date_format(d, date_pattern(fmt)),
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "dayOfWeek": lambda d: F.dayofweek(d) - 1,
    "addDays": lambda d, n: d + F.make_dt_interval(days=F.lit(n)),
    "subtractDays": lambda d, n: d - F.make_dt_interval(days=F.lit(n)),
    "addMonths": lambda d, n: d + F.make_ym_interval(F.lit(0), F.lit(n)),
    "diffDays": lambda a, b: F.datediff(a, b),
    "isBefore": lambda a, b: a < b,
    "isAfter": lambda a, b: a > b,
    "fromUnix": lambda s: F.timestamp_seconds(s),
    "days": lambda n: F.make_dt_interval(days=F.lit(n)),
    "hours": lambda n: F.make_dt_interval(hours=F.lit(n)),
}

FUNCTIONS: dict[str, Callable[..., Column]] = CORE | STRING | ARRAY | OBJECT | MATH | CONVERSION | DATE


class UnknownFunction(ValueError):
    """A call of a name that the table doesn't have."""


def call(name: str, *args, **kwargs) -> Column:
    if name not in FUNCTIONS:
        raise UnknownFunction(name)
    return FUNCTIONS[name](*args, **kwargs)


def register(name: str, builder: Callable[..., Column]) -> None:
    """Add a function of one's own to the table."""
    FUNCTIONS[name] = builder
