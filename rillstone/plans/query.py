"""The query builder: an immutable specification that compiles to one lazy DataFrame, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions import registry
from rillstone.model import STREAM, TABLE, Entity, ModelError, check_shape
from rillstone.operators import aggregates as A
from rillstone.operators import bars, joins
from rillstone.operators.windows import Frame, frames, hopping, validate_frames

MOST_KEYS, MOST_ORDER, MOST_SOURCES = 10, 5, 2


#: Aggregate functions, which have no place in conditions on rows or in keys.
AGGREGATES = frozenset("any_value array_agg avg collect_list collect_set count first last max max_by mean min min_by stddev sum sum_distinct variance".split())


def _literal(c: Column) -> bool:
    return c._jc.node().getClass().getSimpleName() == "Literal"


def _no_aggregate(what: str, *found: Any) -> None:
    if any(isinstance(c, A.Agg) or isinstance(c, Column) and AGGREGATES.intersection(registry.used(c)) for c in found):
        raise ModelError(f"no aggregate in {what}")


@dataclass(frozen=True)
class Query:
    """Built by from_() and the clause methods; each returns a new query. Repeated where() and having() are ANDed."""

    source: Entity | DataFrame
    wheres: tuple[Column, ...] = ()
    joined: tuple[tuple[Any, tuple[tuple[str, str], ...], str], ...] = ()
    bound: float | None = None
    explicit_bound: bool = False
    keys: tuple[Any, ...] = ()
    havings: tuple[Column, ...] = ()
    projection: tuple[tuple[str, Any], ...] = ()
    windows: tuple[Frame, ...] = ()
    time: str | None = None
    hop: tuple[Frame, Frame] | None = None
    grace: str | None = None
    continuation: bool = False
    session: tuple | None = None
    order: tuple[Any, ...] = ()
    most: int | None = None
    skip: int = 0
    partition: tuple[str, ...] = ()
    distinct_rows: bool = False

    @staticmethod
    def from_(source: Entity | DataFrame) -> Query:
        return Query(source)

    def where(self, condition: Column) -> Query:
        """Filters rows; after group_by() it filters groups, as having()."""
        if self.projection:
            raise ModelError("where() comes before select()")
        if self.keys:
            return self.having(condition)
        _no_aggregate("where(): filter groups after group_by()", condition)
        return replace(self, wheres=(*self.wheres, condition))

    def join(self, other: Entity | DataFrame, on: list[tuple[str, str]], how: str = "inner") -> Query:
        """Directly after from_(). Column names must differ between the sources but for those that a caller drops."""
        if self.wheres or self.keys or self.projection or self.windows or self.hop:
            raise ModelError("join() comes directly after from_()")
        return replace(self, joined=(*self.joined, (other, tuple(on), how)))

    def within(self, seconds: float) -> Query:
        if seconds <= 0:
            raise ModelError("WITHIN must be positive")
        return replace(self, bound=seconds)

    def require_explicit_within(self) -> Query:
        return replace(self, explicit_bound=True)

    def group_by(self, *keys: str | Column) -> Query:
        if self.projection:
            raise ModelError("group_by() comes before select()")
        _no_aggregate("group_by()", *keys)
        if not keys or any(not isinstance(k, (str, Column)) for k in keys):
            raise ModelError("group_by() takes columns, not constants")
        if any(isinstance(k, Column) and _literal(k) for k in keys):
            raise ModelError("group_by() takes columns, not constants")
        return replace(self, keys=keys)

    def having(self, condition: Column) -> Query:
        if not self.keys:
            raise ModelError("having() needs group_by()")
        return replace(self, havings=(*self.havings, condition))

    def select(self, *stars: str, **columns: Any) -> Query:
        """Columns by name: names, Columns or aggregates. select("*") keeps all. A name given twice gets a suffix."""
        if self.projection:
            raise ModelError("select() can be given once")
        return replace(self, projection=(*[(c, c) for c in stars], *columns.items()))

    def tumbling(self, time: str | None = None, base_seconds: int = 10, grace: str | None = None, continuation: bool = False, **given) -> Query:
        if self.hop:
            raise ModelError("a query is tumbling or hopping, not both")
        found = frames(**given)
        if not found:
            raise ModelError("tumbling() needs a timeframe")
        validate_frames([f for f in found if f.unit != "s"], base_seconds)
        return replace(self, windows=tuple(found), time=time, grace=grace, continuation=continuation)

    def hopping(self, time: str | None, size: str, advance: str, grace: str | None = None) -> Query:
        if self.windows or self.hop:
            raise ModelError("hopping() can be given once, and not with tumbling()")
        return replace(self, hop=(Frame.of(size), Frame.of(advance)), time=time, grace=grace)

    def time_frame(self, schedule: DataFrame, on: list[tuple[str, str]], open_: str, close: str, open_inclusive: bool = True, close_inclusive: bool = False) -> Query:
        return replace(self, session=(schedule, on, open_, close, open_inclusive, close_inclusive))

    def order_by(self, *columns: str | Column) -> Query:
        return replace(self, order=(*self.order, *columns))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def partition_by(self, *columns: str) -> Query:
        """Single source without grouping or windows: deals rows out by the columns."""
        return replace(self, partition=columns)

    def distinct(self) -> Query:
        return replace(self, distinct_rows=True)

    def aggregates(self) -> dict[str, A.Agg]:
        return {n: v for n, v in self.projection if isinstance(v, A.Agg)}

    def kind(self) -> str:
        """TABLE if the query groups, has a window or an aggregate; else STREAM."""
        return TABLE if self.keys or self.windows or self.hop or self.aggregates() else STREAM

    def event_time(self) -> str:
        t = self.time or (self.source.timestamp if isinstance(self.source, Entity) else None)
        if not t:
            raise ModelError("an event time is needed: name it, or declare it on the entity")
        return t

    def validate(self, strict: bool = False) -> None:
        """Rules that don't need data. strict adds the narrower limits: two sources, ten keys, five order columns, and in
        keys and order only functions that are registered for them."""
        plain = [n for n, v in self.projection if not isinstance(v, A.Agg) and n != "*"]
        if (self.windows or self.hop) and not self.keys:
            raise ModelError("a windowed query needs group_by()")
        if self.aggregates() and not self.keys and plain:
            raise ModelError("columns beside aggregates need group_by()")
        if self.havings and not self.keys:
            raise ModelError("having() needs group_by()")
        if self.partition and (self.joined or self.keys or self.windows or self.hop):
            raise ModelError("partition_by() is for a single source without grouping or windows")
        if self.hop and any(how != "inner" for _, _, how in self.joined):
            raise ModelError("a join before a hopping window is an inner join with a table")
        if self.bound and not any(self._bounded(other, how) for other, _, how in self.joined):
            raise ModelError("within() is for an inner join of two streams with event times")
        if self.continuation and not self.windows:
            raise ModelError("continuation needs tumbling()")
        if self.windows or self.hop:
            self.event_time()
        if strict:
            if len(self.joined) + 1 > MOST_SOURCES:
                raise ModelError(f"at most {MOST_SOURCES} sources")
            if len(self.keys) > MOST_KEYS or len(self.order) > MOST_ORDER:
                raise ModelError(f"at most {MOST_KEYS} keys and {MOST_ORDER} order columns")
            for what, columns in (("group", self.keys), ("order", self.order)):
                used = {f for c in columns if isinstance(c, Column) for f in registry.used(c) if f.isidentifier()}
                if odd := used - registry.spark_names(what):
                    raise ModelError(f"functions not allowed in {what}_by(): {sorted(odd)}")

    def _bounded(self, other, how: str) -> bool:
        """Whether a join with `other` is bounded in time: an inner one of two streams with event times."""
        streams = isinstance(self.source, Entity) and isinstance(other, Entity) and STREAM == self.source.kind == other.kind
        return bool(how == "inner" and streams and self.source.timestamp and other.timestamp)

    def _frame(self, source, sources: Mapping[str, DataFrame]) -> DataFrame:
        return sources[source.name] if isinstance(source, Entity) else source

    def rows(self, sources: Mapping[str, DataFrame]) -> DataFrame:
        """Sources joined and filtered."""
        df = self._frame(self.source, sources)
        for other, on, how in self.joined:
            right = self._frame(other, sources)
            if self._bounded(other, how):
                df = joins.join_within(df, right, list(on), self.source.timestamp, other.timestamp, self.bound, self.explicit_bound, self.grace)
            else:
                df = joins.join(df, right, list(on), how)
        for w in self.wheres:
            df = df.where(w)
        if self.session:
            schedule, on, *rest = self.session
            df = joins.join_session(df, schedule, on, self.event_time(), *rest)
        if df.isStreaming and (self.windows or self.hop):
            df = df.withWatermark(self.event_time(), self.grace or "1 second")
        return df

    def _key_columns(self) -> list[Column]:
        return [F.col(k) if isinstance(k, str) else k for k in self.keys]

    def _project(self, df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        out, used = [], {}
        for name, v in self.projection:
            if name == "*":
                out.append(F.col("*"))
                continue
            used[name] = used.get(name, -1) + 1
            alias = f"{name}_{used[name]}" if used[name] else name
            out.append(F.col(name).alias(alias) if isinstance(v, A.Agg) else (F.col(v) if isinstance(v, str) else v).alias(alias))
        return df.select(*out) if out else df

    def to_df(self, sources: Mapping[str, DataFrame] | None = None, target: Entity | None = None) -> DataFrame:
        """The query's DataFrame; for several timeframes use to_frames()."""
        self.validate()
        if self.windows:
            if len(self.windows) > 1:
                raise ModelError("several timeframes: use to_frames()")
            return next(iter(self.to_frames(sources, target).values()))
        df = self.rows(sources or {})
        aggs = self.aggregates()
        if self.hop:
            keys = [*self._key_columns(), hopping(self.event_time(), *self.hop).alias("window")]
            df = A.aggregate(df, keys, aggs)
            df = df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")
        elif self.keys or aggs:
            df = A.aggregate(df, self._key_columns(), aggs)
        for h in self.havings:
            df = df.where(h)
        return self._finish(self._project(df) if self.projection else df, target)

    def to_frames(self, sources: Mapping[str, DataFrame] | None = None, target: Entity | None = None) -> dict[str, DataFrame]:
        """Bars of each timeframe: keys, bucket and the projection. In batch all frames share one hub; a stream takes
        each frame in one stage, so that changes come out as they happen."""
        self.validate()
        df = self.rows(sources or {})
        aggs, keys, out = self.aggregates(), [k for k in self.keys if isinstance(k, str)], {}
        if len(keys) < len(self.keys):
            raise ModelError("keys of a windowed query are columns")
        if df.isStreaming and self.continuation:
            raise ModelError("gaps are filled in a batch, not in a stream")
        if df.isStreaming:
            from rillstone.operators.windows import floor, window_of

            for f in self.windows:
                bucket = window_of(self.event_time(), f).alias("bucket") if f.unit != "mo" else floor(self.event_time(), f).alias("bucket")
                bar = A.aggregate(df, [*self._key_columns(), bucket], aggs)
                out[str(f)] = bar if f.unit == "mo" else bar.withColumn("bucket", F.col("bucket.start"))
        else:
            out = bars.cascade(df, keys, self.event_time(), aggs, list(self.windows))
            if self.continuation:
                prices = tuple(c for c in ("open", "high", "low") if c in aggs)
                out = {k: bars.fill_gaps(v, keys, Frame.of(k), others=prices).drop("filled") for k, v in out.items()}
        for k, bar in out.items():
            for h in self.havings:
                bar = bar.where(h)
            given = [n for n, _ in self.projection]
            shown = bar if not given else self._project(bar) if "bucket" in given else bar.select(*keys, "bucket", *[n for n in given if n not in keys])
            out[k] = self._finish(shown, target)
        return out

    def _finish(self, df: DataFrame, target: Entity | None) -> DataFrame:
        if self.distinct_rows:
            df = df.distinct()
        if target:
            kept = target.schema()
            df = df.select(*[F.col(c).cast(kept[c].dataType) if c in kept.names and kept[c].dataType.typeName() == "decimal" else F.col(c) for c in df.columns])
            check_shape(df.schema, target)
        if self.partition:
            df = df.repartition(*self.partition)
        if df.isStreaming and (self.order or self.skip):
            raise ModelError("a stream has no order: read what it keeps, and order that")
        if self.order:
            df = df.orderBy(*self.order)
        if self.skip:
            df = df.offset(self.skip)
        return df if self.most is None else df.limit(self.most)
