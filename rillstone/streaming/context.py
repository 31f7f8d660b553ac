"""The context: registered entities with snapshot and continuous reads, bucket reads and local exports."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillstone.model import STREAM, TABLE, Entity, ModelError
from rillstone.operators.bars import names, newest, rows_last
from rillstone.operators.windows import Frame, floor
from rillstone.plans.query import Query
from rillstone.sources.changelog import ChangeLog
from rillstone.streaming.errors import DLQ, RetryPolicy, for_each_batch, for_each_row
from rillstone.streaming.monitor import Incident, incidents


class EntitySet:
    """A handle on one entity's rows."""

    def __init__(self, context: StreamContext, entity: Entity):
        self.context, self.entity = context, entity

    @property
    def df(self) -> DataFrame:
        return self.context.frame(self.entity.name)

    def to_list(self, limit: int | None = None) -> list:
        """A table's rows, to the driver: give a limit unless the table is known to be small. Streams can't be listed."""
        if self.entity.kind == STREAM or self.df.isStreaming:
            raise ModelError(f"{self.entity.name} is a stream: read it with for_each()")
        return (self.df if limit is None else self.df.limit(limit)).collect()

    def add(self, rows: DataFrame) -> None:
        """Adds rows: to the store if the entity has one, else to what this context sees."""
        if self.entity.name in self.context.stores:
            return self.context.stores[self.entity.name].write(rows)
        self.context.frames[self.entity.name] = self.df.unionByName(rows)

    def remove(self, gone: DataFrame) -> None:
        if not self.entity.keys:
            raise ModelError(f"{self.entity.name} has no key")
        if self.entity.name in self.context.stores:
            return self.context.stores[self.entity.name].delete(gone)
        self.context.frames[self.entity.name] = self.df.join(gone.select(*self.entity.keys).distinct(), list(self.entity.keys), "left_anti")

    def map(self, **columns: Column) -> DataFrame:
        return self.df.select(*[c.alias(n) for n, c in columns.items()])

    def limit(self, n: int, by: str) -> DataFrame:
        """A table's newest n rows of each key but the last key column's; the rest counts as deleted."""
        if self.entity.kind != TABLE:
            raise ModelError("limit() keeps rows of a table")
        keys = [k for k in self.entity.keys if k != by]
        return newest(self.df, keys, [F.col(by).desc()], n)

    def for_each(self, handle: Callable[[DataFrame, int], None], checkpoint: str, action: str = "Skip", retry: RetryPolicy | None = None, dead=None) -> StreamingQuery:
        if action == DLQ and self.entity.name == self.context.dead_letters:
            raise ModelError("dead letters can't fail to the dead letters")
        run = for_each_batch(handle, action, retry, dead)
        return self.df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def for_each_row(self, handle: Callable[[dict], None], checkpoint: str, action: str = "Skip", retry: RetryPolicy | None = None, dead: ChangeLog | None = None) -> StreamingQuery:
        """Calls handle on the workers with each row as it comes; rows that fail after all tries are skipped, fail the batch
        (Retry) or go to the dead letters. The checkpoint commits whole batches, so a row may be handled again."""
        if action == DLQ and self.entity.name == self.context.dead_letters:
            raise ModelError("dead letters can't fail to the dead letters")
        run = for_each_row(handle, self.entity.name, action, retry, dead)
        return self.df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StreamContext:
    """Owns entities, their DataFrames and defined queries; strict ones keep to the narrower limits of validate()."""

    def __init__(self, spark: SparkSession, dead_letters: str = "dead_letters", strict: bool = False):
        self.spark, self.dead_letters, self.strict = spark, dead_letters, strict
        self.entities: dict[str, Entity] = {}
        self.frames: dict[str, DataFrame] = {}
        self.queries: dict[str, Query] = {}
        self.stores: dict[str, ChangeLog] = {}

    def frame(self, name: str) -> DataFrame:
        """A stored entity's rows as they are now, else the registered DataFrame."""
        return self.stores[name].read() if name in self.stores else self.frames[name]

    def store(self, entity: Entity, path: str) -> EntitySet:
        """Registers an entity whose rows are kept in a shared folder."""
        self.stores[entity.name] = ChangeLog(self.spark, entity, path)
        return self.register(entity, self.stores[entity.name].read())

    def persist(self, entity: Entity, query: Query, path: str, checkpoint: str | None = None, by: str | None = None, available_now: bool = True, retry: RetryPolicy | None = None) -> StreamingQuery | None:
        """A query that keeps writing its rows to an entity: a table's changes, a stream's new rows. Several queries may
        insert into one entity, each by a name and checkpoint of its own. A batch is written once, each time anew; for a
        stream the running query is returned, and its start is tried as often as `retry` says."""
        if (query.kind() == TABLE) != (entity.kind == TABLE):
            raise ModelError(f"{entity.name} is a {entity.kind}, the query gives a {query.kind()}")
        query.validate(self.strict)
        df = query.to_df({n: self.frame(n) for n in self.entities}, entity)
        if entity.name not in self.stores:
            self.store(entity, path)
        self.queries[entity.name] = query
        log, by = self.stores[entity.name], by or entity.name
        if not df.isStreaming:
            return log.write(df, by, 0)
        if checkpoint is None:
            raise ModelError("a stream needs a checkpoint")
        return (retry or RetryPolicy()).run(lambda: log.follow(df, by, checkpoint, available_now))

    def persist_bars(self, entity: Entity, query: Query, path: str, checkpoint: str, fill: bool = False, available_now: bool = True) -> StreamingQuery:
        """Closed bars of one timeframe kept in an entity with the key column bucket; fill adds flat bars in empty buckets
        between a key's bars as they come."""
        if len(query.windows) != 1 or entity.kind != TABLE or "bucket" not in entity.keys:
            raise ModelError("bars of one timeframe go to a table with bucket among its keys")
        df = query.to_df({n: self.frame(n) for n in self.entities})
        if entity.name not in self.stores:
            self.store(entity, path)
        log = self.stores[entity.name]
        if fill:
            return log.follow_filled(df, query.windows[0], entity.name, checkpoint, available_now=available_now)
        return log.follow(df, entity.name, checkpoint, available_now, "append")

    def write_bars(self, base: str, period: str, rows: DataFrame) -> None:
        """Writes bars to the period's stored entity."""
        name = f"{base}_{Frame.of(period)}_live"
        if name not in self.stores:
            raise ModelError(f"{name} isn't stored")
        self.stores[name].write(rows)

    def wait_for_bucket(self, base: str, period: str, keys: dict[str, object], bucket: str, tolerance: float = 0, timeout: float = 10, poll: float = 0.5) -> bool:
        """Whether a bar of the key stands within `tolerance` seconds of the bucket before `timeout` seconds are over; if
        not, an incident is published."""
        if not keys:
            raise ModelError("a key is needed")
        name, ends = f"{base}_{Frame.of(period)}_live", time.monotonic() + timeout
        span, at = F.expr(f"INTERVAL {tolerance} SECONDS"), F.lit(bucket).cast("timestamp_ntz")
        while True:
            df = self.frame(name).where(F.col("bucket").cast("timestamp_ntz").between(at - span, at + span))
            for k, v in keys.items():
                df = df.where(F.col(k) == F.lit(v))
            if df.take(1):
                return True
            if time.monotonic() + poll > ends:
                incidents.publish(Incident("timebucket_timeout", base, period, keys, bucket, "the bucket didn't come in time"))
                return False
            time.sleep(poll)

    def register(self, entity: Entity, df: DataFrame) -> EntitySet:
        self.entities[entity.name], self.frames[entity.name] = entity, df
        if not df.isStreaming:
            df.createOrReplaceTempView(entity.name)
        return EntitySet(self, entity)

    def set(self, name: str) -> EntitySet:
        return EntitySet(self, self.entities[name])

    def define(self, entity: Entity, query: Query) -> EntitySet:
        """Attaches a query to an entity: its rows are the query's, checked against the entity's columns."""
        query.validate(self.strict)
        self.queries[entity.name] = query
        return self.register(entity, query.to_df(self.frames, entity))

    def define_bars(self, base: str, query: Query) -> dict[str, DataFrame]:
        """One view for each timeframe, by the names of the cascade, and one of the latest bars."""
        query.validate(self.strict)
        bars = query.to_frames(self.frames)
        called = names(base, list(query.windows))
        for f, df in bars.items():
            self.frames[called[f]] = df
            df.createOrReplaceTempView(called[f])
        keys = [k for k in query.keys if isinstance(k, str)]
        shortest = next(iter(bars.values()))
        self.frames[called["last"]] = rows_last(shortest, keys, ["bucket"])
        self.frames[called["last"]].createOrReplaceTempView(called["last"])
        return bars

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def explain(self, name: str) -> str:
        return self.frames[name]._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def pull_rows(self, name: str, where: Column | None = None, limit: int | None = None) -> DataFrame:
        df = self.frame(name) if where is None else self.frame(name).where(where)
        return df if limit is None else df.limit(limit)

    def pull_count(self, name: str, where: Column | None = None) -> int:
        return self.pull_rows(name, where).count()

    def push(self, name: str, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
        """Continuous read: changes (update) or closed windows (append) as they come."""
        return self.frames[name].writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read_bars(self, base: str, period: str, keys: dict[str, object], bucket: str | None = None) -> DataFrame:
        """A period's bars of a key (or of its leading columns), those near a bucket if one is given: within 1 s, or 2 s
        for periods over a minute. Periods of seconds can't be read."""
        f = Frame.of(period)
        if f.unit == "s":
            raise ModelError("periods are minutes or longer")
        df = self.frame(f"{base}_{f}_live")
        for k, v in keys.items():
            df = df.where(F.col(k) == F.lit(v))
        if bucket is not None:
            span = F.expr(f"INTERVAL {2 if f.rank > 60 else 1} SECONDS")
            at = floor(F.lit(bucket).cast("timestamp_ntz"), f)
            df = df.where((F.col("bucket") >= at - span) & (F.col("bucket") <= at + span))
        return df

    def read_hopping(self, name: str, keys: dict[str, object], since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
        df = self.frames[name]
        for k, v in keys.items():
            df = df.where(F.col(k) == F.lit(v))
        if since is not None:
            df = df.where(F.col("window_start") >= F.lit(since).cast("timestamp_ntz"))
        if until is not None:
            df = df.where(F.col("window_end") <= F.lit(until).cast("timestamp_ntz"))
        return df if limit is None else df.limit(limit)

    def script(self) -> str:
        """All entities by name with their schema, and the plan of defined queries; dead letters are left out."""
        out = []
        for n in sorted(self.entities):
            if n != self.dead_letters:
                e = self.entities[n]
                out.append(f"-- {e.kind} {n} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in e.schema())}) KEY ({', '.join(e.keys)})")
                out += [self.explain(n)] if n in self.queries else []
        return "\n".join(out)

    def schemas(self) -> dict[str, str]:
        """A JSON schema of each entity's key and value columns."""
        out = {}
        for n, e in self.entities.items():
            fields = {f.name: json.loads(f.json()) for f in e.schema()}
            out[f"{n}-key"] = json.dumps([fields[k] for k in e.keys])
            out[f"{n}-value"] = json.dumps([v for k, v in fields.items() if k not in e.keys])
        return out
