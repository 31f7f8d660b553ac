"""Aggregates as mergeable parts: what a second-long hub keeps, how frames merge it, and the value in the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    """parts: suffix -> aggregate over rows; merge: suffix -> aggregate over parts (given all parts by suffix);
    final: the value, given the parts by suffix; direct: the value in one grouping of a batch, where Spark has a cheaper
    aggregate than the parts that frames merge."""

    parts: dict[str, Column]
    merge: Callable[[dict[str, Column]], dict[str, Column]]
    final: Callable[[dict[str, Column]], Column]
    direct: Column | None = None

    def cast(self, kind: str) -> Agg:
        return Agg(self.parts, self.merge, lambda p: self.final(p).cast(kind), None if self.direct is None else self.direct.cast(kind))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count() -> Agg:
    return Agg({"n": F.count("*")}, lambda p: {"n": F.sum(p["n"])}, lambda p: p["n"].cast("long"))


def count_if(condition: Column) -> Agg:
    return Agg({"n": F.count_if(condition)}, lambda p: {"n": F.sum(p["n"])}, lambda p: p["n"].cast("long"))


def sum_(x) -> Agg:
    return Agg({"s": F.sum(_col(x))}, lambda p: {"s": F.sum(p["s"])}, lambda p: p["s"])


def avg(x) -> Agg:
    """sum / count over merged parts; null if there is no value."""
    return Agg({"s": F.sum(_col(x)), "n": F.count(_col(x))}, lambda p: {"s": F.sum(p["s"]), "n": F.sum(p["n"])}, lambda p: F.try_divide(p["s"], p["n"]))


def min_(x) -> Agg:
    return Agg({"v": F.min(_col(x))}, lambda p: {"v": F.min(p["v"])}, lambda p: p["v"])


def max_(x) -> Agg:
    return Agg({"v": F.max(_col(x))}, lambda p: {"v": F.max(p["v"])}, lambda p: p["v"])


def earliest(x, *order) -> Agg:
    """The value of the first row by `order`, which must be total (event time and an offset or id)."""
    o = F.struct(*map(_col, order))
    return Agg({"v": F.min_by(_col(x), o), "o": F.min(o)}, lambda p: {"v": F.min_by(p["v"], p["o"]), "o": F.min(p["o"])}, lambda p: p["v"])


def latest(x, *order) -> Agg:
    o = F.struct(*map(_col, order))
    return Agg({"v": F.max_by(_col(x), o), "o": F.max(o)}, lambda p: {"v": F.max_by(p["v"], p["o"]), "o": F.max(p["o"])}, lambda p: p["v"])


def collect_list(x, *order) -> Agg:
    """All values, sorted by `order` (by value without one)."""
    item = F.struct(*[_col(c).alias(f"o{k}") for k, c in enumerate(order)], _col(x).alias("v"))
    return Agg({"l": F.collect_list(item)}, lambda p: {"l": F.flatten(F.collect_list(p["l"]))}, lambda p: F.transform(F.sort_array(p["l"]), lambda s: s["v"]))


def collect_set(x) -> Agg:
    return Agg({"l": F.collect_set(_col(x))}, lambda p: {"l": F.array_distinct(F.flatten(F.collect_list(p["l"])))}, lambda p: F.sort_array(p["l"]))


def count_distinct(x) -> Agg:
    """The number of different values: a set of them where frames merge or a stream goes on, else Spark's own count."""
    return Agg({"l": F.collect_set(_col(x))}, lambda p: {"l": F.array_distinct(F.flatten(F.collect_list(p["l"])))}, lambda p: F.size(p["l"]).cast("long"), F.count_distinct(_col(x)))


def top_k(x, k: int, distinct: bool = False) -> Agg:
    """The k largest values, largest first; a part holds k values at most once made."""
    cut = lambda a: F.slice(F.sort_array(F.array_distinct(a) if distinct else a, asc=False), 1, k)
    return Agg({"l": cut((F.collect_set if distinct else F.collect_list)(_col(x)))}, lambda p: {"l": cut(F.flatten(F.collect_list(p["l"])))}, lambda p: p["l"])


def expr(f: Callable[..., Column], *inner: Agg) -> Agg:
    """A scalar expression over aggregates; only their parts are carried."""
    parts = {f"{k}{s}": c for k, a in enumerate(inner) for s, c in a.parts.items()}
    own = lambda p, k, a: {s: p[f"{k}{s}"] for s in a.parts}
    return Agg(parts, lambda p: {f"{k}{s}": c for k, a in enumerate(inner) for s, c in a.merge(own(p, k, a)).items()}, lambda p: f(*[a.final(own(p, k, a)) for k, a in enumerate(inner)]))


def partial(aggs: dict[str, Agg]) -> list[Column]:
    return [c.alias(f"{name}__{s}") for name, a in aggs.items() for s, c in a.parts.items()]


def merged(aggs: dict[str, Agg]) -> list[Column]:
    return [c.alias(f"{name}__{s}") for name, a in aggs.items() for s, c in a.merge({s: F.col(f"{name}__{s}") for s in a.parts}).items()]


def final(aggs: dict[str, Agg]) -> list[Column]:
    return [a.final({s: F.col(f"{name}__{s}") for s in a.parts}).alias(name) for name, a in aggs.items()]


def aggregate(df: DataFrame, keys: list, aggs: dict[str, Agg]) -> DataFrame:
    """One grouping with Spark's partial and final aggregation; keys may be names or aliased columns."""
    direct = {} if df.isStreaming else {name: a.direct.alias(name) for name, a in aggs.items() if a.direct is not None}
    parts = {name: a for name, a in aggs.items() if name not in direct}
    grouped = df.groupBy(*keys).agg(*partial(parts), *direct.values())
    width = len(grouped.columns) - sum(len(a.parts) for a in parts.values()) - len(direct)
    ends = dict(zip(parts, final(parts), strict=True))
    return grouped.select(*grouped.columns[:width], *[ends.get(name, F.col(name)) for name in aggs])


def top_rows(df: DataFrame, keys: list[str], value: str, k: int, alias: str = "top", distinct: bool = False) -> DataFrame:
    """keys and the k largest values of each, largest first. Ranks prune each task's rows before they are shuffled, so no
    task holds more than k values of a key; a key without a value has none and is left out."""
    rows = df.select(*keys, F.col(value).alias("_v")).where("_v is not null")
    rows = rows.distinct() if distinct else rows
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_v").desc()))
    best = rows.withColumn("_n", rank).where(F.col("_n") <= k)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda s: s["_v"]).alias(alias))


def histogram(df: DataFrame, keys: list[str], value: str, alias: str = "histogram") -> DataFrame:
    """keys and a map from each value (as string) to its number of rows; counted first, so a map is gathered only from
    distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n")))).alias(alias))
