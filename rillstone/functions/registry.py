"""Scalar functions by name, built from Spark's own expressions; unknown names and wrong arities raise."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MANY = 1_000


@dataclass(frozen=True)
class Function:
    build: Callable[..., Column]
    least: int
    most: int
    group: bool = False  # allowed in GROUP BY in strict mode
    order: bool = False  # allowed in ORDER BY in strict mode


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _add(unit: str) -> Callable[..., Column]:
    return lambda t, n: F.timestamp_add(unit, _c(n), t)


def _case(*args) -> Column:
    """Pairs of condition and value; an odd argument at the end is the default."""
    out = None
    for k in range(0, len(args) - 1, 2):
        out = F.when(args[k], args[k + 1]) if out is None else out.when(args[k], args[k + 1])
    return out.otherwise(args[-1]) if len(args) % 2 else out


def _distance(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km by the haversine formula, radius 6371 km."""
    a = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    b = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b))


def _json_concat(*objects) -> Column:
    """Objects merged in order; of equal keys the last value stays. Values keep as strings."""
    maps = [F.from_json(x, "map<string,string>") for x in objects]
    return F.to_json(reduce(lambda out, more: F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(more, k)), more), maps))


def _slice(a, first, last) -> Column:
    """Elements first..last, counted from 1, both included."""
    return F.slice(a, _c(first), _c(last) - _c(first) + 1)


def _cast(kind: str) -> Callable[..., Column]:
    return lambda x: x.try_cast(kind)


def _contains(j, v) -> Column:
    kind = "array<string>" if isinstance(v, (str, Column)) else "array<boolean>" if isinstance(v, bool) else "array<double>"
    return F.array_contains(F.from_json(j, kind), _c(v))


_REGISTRY: dict[str, Function] = {}


def register(name: str, build: Callable[..., Column], least: int, most: int | None = None, group: bool = False, order: bool = False) -> None:
    """Adds a function, or replaces one, under any spelling of its name."""
    _REGISTRY[name.lower()] = Function(build, least, least if most is None else most, group, order)


def names() -> list[str]:
    return sorted(_REGISTRY)


def lookup(name: str) -> Function:
    if name.lower() not in _REGISTRY:
        raise NotImplementedError(f"function {name} isn't supported")
    return _REGISTRY[name.lower()]


def call(name: str, *args) -> Column:
    """call("Left", F.col("s"), 3): Python values become literals where a column is needed."""
    f = lookup(name)
    if not f.least <= len(args) <= f.most:
        raise ValueError(f"{name} takes {f.least} to {f.most} arguments, not {len(args)}")
    return f.build(*args)


def used(c: Column) -> list[str]:
    """Spark's names of the functions in a column; operators come by their sign or name."""
    out, todo = [], [c._jc.node()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "UnresolvedFunction":
            out.append(node.functionName().lower())
        inner = node.children()
        todo += [inner.apply(k) for k in range(inner.size())]
    return out


#: Operators that Spark names by a word.
_OPERATORS = frozenset(["and", "or", "not", "negative", "isnull", "isnotnull", "when", "coalesce", "in"])


def spark_names(what: str) -> frozenset[str]:
    """Spark's names of the functions allowed in "group" or "order", with what such functions are made of."""
    found = set(_OPERATORS)
    for f in set(_REGISTRY.values()):
        if getattr(f, what):
            found.update(used(f.build(*[F.col("x")] * f.most)))
    return frozenset(found)


for _n in ("ToUpper", "Upper"):
    register(_n, F.upper, 1, group=True, order=True)
for _n in ("ToLower", "Lower"):
    register(_n, F.lower, 1, group=True, order=True)
register("Substring", lambda s, a, n=None: F.substring(s, _c(a), F.length(s) if n is None else _c(n)), 2, 3, group=True)
for _n in ("Length", "Len"):
    register(_n, F.length, 1)
register("Trim", F.trim, 1)
register("Replace", lambda s, a, b: F.replace(s, _c(a), _c(b)), 3)
register("Contains", lambda s, x: F.contains(s, _c(x)), 2)
register("StartsWith", lambda s, x: F.startswith(s, _c(x)), 2)
register("EndsWith", lambda s, x: F.endswith(s, _c(x)), 2)
register("Split", lambda s, d: F.split(s, re.escape(d)), 2)
register("Concat", lambda *a: F.concat(*map(_c, a)), 2, MANY)
register("IndexOf", lambda s, x: F.instr(s, x), 2)
register("PadLeft", lambda s, n, p=" ": F.lpad(s, n, p), 2, 3)
register("PadRight", lambda s, n, p=" ": F.rpad(s, n, p), 2, 3)
register("Left", lambda s, n: F.left(s, _c(n)), 2, group=True)
register("Right", lambda s, n: F.right(s, _c(n)), 2, group=True)
register("Abs", F.abs, 1, order=True)
register("Round", lambda x, n=0: F.round(x, n), 1, 2, group=True)
register("Floor", F.floor, 1, group=True)
register("Ceiling", F.ceil, 1, group=True)
register("Sqrt", F.sqrt, 1)
register("Power", lambda x, y: F.pow(x, _c(y)), 2)
register("Sign", F.signum, 1)
register("Exp", F.exp, 1)
register("Sin", F.sin, 1)
register("Cos", F.cos, 1)
register("Tan", F.tan, 1)
register("Log", lambda x, base=None: F.ln(x) if base is None else F.ln(x) / F.ln(_c(base)), 1, 2)
register("Log10", F.log10, 1)
register("Year", F.year, 1, group=True, order=True)
register("Month", F.month, 1, group=True, order=True)
register("Day", F.dayofmonth, 1, group=True, order=True)
register("Hour", F.hour, 1, group=True)
register("Minute", F.minute, 1, group=True)
register("Second", F.second, 1, group=True)
for _n, _u in (("AddDays", "DAY"), ("AddHours", "HOUR"), ("AddMinutes", "MINUTE"), ("AddSeconds", "SECOND"), ("AddMilliseconds", "MILLISECOND")):
    register(_n, _add(_u), 2)
register("DayOfWeek", F.dayofweek, 1, group=True)
register("DayOfYear", F.dayofyear, 1, group=True)
register("WeekOfYear", F.weekofyear, 1, group=True)
register("FormatTimestamp", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 1, group=True)
register("ArrayLength", F.size, 1)
register("ArrayContains", lambda a, v: F.array_contains(a, _c(v)), 2)
register("ArraySlice", _slice, 3)
register("ArrayJoin", lambda a, d: F.array_join(a, d), 2)
register("ArrayDistinct", F.array_distinct, 1)
register("ArrayExcept", F.array_except, 2)
register("ArrayIntersect", F.array_intersect, 2)
register("ArrayUnion", F.array_union, 2)
register("ArraySort", F.array_sort, 1)
register("ArrayMax", F.array_max, 1)
register("ArrayMin", F.array_min, 1)
register("JsonExtractString", lambda j, p: F.get_json_object(j, p), 2)
register("JsonArrayLength", F.json_array_length, 1)
register("JsonKeys", F.json_object_keys, 1)
register("JsonArrayContains", _contains, 2)
register("JsonConcat", _json_concat, 2, MANY)
register("JsonRecords", lambda j: F.from_json(j, "map<string,string>"), 1)
register("ToString", lambda x: x.cast("string"), 1, group=True)
for _n, _k in (("ToInt", "int"), ("ToInt32", "int"), ("ToLong", "bigint"), ("ToInt64", "bigint"), ("ToDouble", "double"), ("ToDecimal", "decimal(18,2)"), ("ToBoolean", "boolean")):
    register(_n, _cast(_k), 1)
for _n in ("Parse", "Convert"):
    register(_n, lambda x, kind: x.try_cast(kind), 2)
register("Case", _case, 2, MANY)
register("Coalesce", lambda *a: F.coalesce(*map(_c, a)), 1, MANY)
register("IfNull", lambda a, b: F.ifnull(a, _c(b)), 2)
register("NullIf", lambda a, b: F.nullif(a, _c(b)), 2)
for _n, _p in (("UrlExtractHost", "HOST"), ("UrlExtractPath", "PATH"), ("UrlExtractQuery", "QUERY"), ("UrlExtractProtocol", "PROTOCOL")):
    register(_n, lambda u, part=_p: F.try_parse_url(u, F.lit(part)), 1)
register("GeoDistance", _distance, 4)
register("AsGeoJson", lambda lat, lon: F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))), 2)
register("Md5", F.md5, 1)
register("Sha1", F.sha1, 1)
register("Sha256", lambda x: F.sha2(x, 256), 1)
register("WindowStart", lambda w="window": F.col(f"{w}.start"), 0, 1)
register("WindowEnd", lambda w="window": F.col(f"{w}.end"), 0, 1)
register("RowTime", lambda t: F.col(t) if isinstance(t, str) else t, 1, order=True)
register("RowKey", lambda *k: F.struct(*k), 1, MANY)
