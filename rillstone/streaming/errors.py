"""Error policies: skip, retry or dead letters, with the gate and envelope of the last."""

from __future__ import annotations

import json
import socket
import time
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.model import Entity
from rillstone.sources.changelog import ChangeLog

SKIP, RETRY, DLQ = "Skip", "Retry", "DLQ"

#: The fields of a stored dead letter.
DEAD_LETTER = Entity(
    "dead_letters",
    {
        "topic": "string", "partition": "int", "offset": "long", "timestamp": "datetime?", "ingested_at": "datetime?",
        "payload_format_key": "string?", "payload_format_value": "string?", "schema_id_key": "string?", "schema_id_value": "string?",
        "key_is_null": "bool?", "error_type": "string?", "error_message": "string?", "stack_trace": "string?", "fingerprint": "string?",
        "application_id": "string?", "consumer_group": "string?", "host": "string?", "headers": "map<string,string>?", "raw_text": "string?",
    },
    ("topic", "partition", "offset"),
)


@dataclass(frozen=True)
class RetryPolicy:
    """attempts tries in all; delays fixed, linear or exponential (doubling), 8 s at most."""

    attempts: int = 1
    delay: float = 1.0
    kind: str = "fixed"
    most: float = 8.0

    def delays(self) -> list[float]:
        factor = {"fixed": lambda k: 1, "linear": lambda k: k + 1, "exponential": lambda k: 2**k}[self.kind]
        return [min(self.most, self.delay * factor(k)) for k in range(self.attempts - 1)]

    def run(self, action: Callable[[], object], sleep: Callable[[float], None] = time.sleep):
        for wait in [*self.delays(), None]:
            try:
                return action()
            except Exception:
                if wait is None:
                    raise
                sleep(wait)


class CircuitBreaker:
    """Opens after `threshold` failures running; lets one try through after `recovery` seconds."""

    def __init__(self, threshold: int = 5, recovery: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.recovery, self.clock = threshold, recovery, clock
        self.failures, self.opened = 0, None

    def call(self, action: Callable[[], object]):
        if self.opened is not None and self.clock() - self.opened < self.recovery:
            raise RuntimeError("circuit is open")
        try:
            out = action()
        except Exception:
            self.failures += 1
            if self.failures >= self.threshold:
                self.opened = self.clock()
            raise
        self.failures, self.opened = 0, None
        return out


@dataclass(frozen=True)
class DlqOptions:
    enabled: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    sampling: float = 1.0
    per_second: int | None = 1


def gate(errors: DataFrame, options: DlqOptions, error_type: str, at: str, key: Sequence[str]) -> DataFrame:
    """Rows that go to the dead letters: enabled, then listed, then sampled by hash of the key, then the first
    `per_second` of each second by the key's order."""
    if not options.enabled:
        return errors.limit(0)
    out = errors
    if options.include:
        out = out.where(F.col(error_type).isin(*options.include))
    if options.exclude:
        out = out.where(~F.col(error_type).isin(*options.exclude))
    if options.sampling < 1:
        out = out.where(F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < int(options.sampling * 1_000_000))
    if options.per_second is not None:
        w = Window.partitionBy(F.date_trunc("second", at)).orderBy(*key)
        out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= options.per_second).drop("_n")
    return out


def _short(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def envelope(errors: DataFrame, topic: str = "topic", partition: str = "partition", offset: str = "offset", at: str = "timestamp", error_type: str = "error_type", message: str = "message", stack: str = "stack", others: tuple[str, ...] = ()) -> DataFrame:
    """Dead letters with a fixed schema: message cut at 1024, stack with single spaces cut at 2048, and a fingerprint;
    others are columns to keep beside it."""
    m = _short(F.coalesce(F.col(message), F.lit("")), 1024)
    s = _short(F.trim(F.regexp_replace(F.coalesce(F.col(stack), F.lit("")), r"\s+", " ")), 2048)
    return errors.select(
        F.col(topic).alias("topic"), F.col(partition).alias("partition"), F.col(offset).alias("offset"), F.col(at).alias("timestamp"),
        F.col(error_type).alias("error_type"), m.alias("error_message"), s.alias("stack_trace"),
        F.upper(F.sha2(F.concat_ws("\n", m, s), 256)).alias("fingerprint"), *others,
    )


def split_bad(raw: DataFrame, value: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Decoded rows, and those whose JSON doesn't decode; null and empty payloads are tombstones and in neither."""
    full = raw.where(F.col(value).isNotNull() & (F.col(value) != ""))
    seen = full.withColumn("_v", F.from_json(value, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = seen.where(F.col("_v._bad").isNull()).select(*[c for c in raw.columns if c != value], "_v.*").drop("_bad")
    return good, seen.where(F.col("_v._bad").isNotNull()).drop("_v")


def for_each_batch(handle: Callable[[DataFrame, int], None], action: str = SKIP, retry: RetryPolicy | None = None, dead: Callable[[DataFrame, Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function with an error policy. The checkpoint commits the batch once it returns."""
    if action == DLQ and dead is None:
        raise ValueError("the DLQ policy needs a sink, and can't be used on the dead letters themselves")

    def run(batch: DataFrame, epoch: int) -> None:
        try:
            (retry or RetryPolicy(2 if action == RETRY else 1)).run(lambda: handle(batch, epoch))
        except Exception as e:
            if action == DLQ:
                dead(batch, e)
            elif action == RETRY:
                raise

    return run


def complete(letters: DataFrame, application: str = "", group: str = "", payload: str = "json") -> DataFrame:
    """Letters of envelope() with the remaining fields of DEAD_LETTER; those that letters already have stay."""
    more = {
        "ingested_at": F.current_timestamp(), "payload_format_key": F.lit("none"), "payload_format_value": F.lit(payload), "schema_id_key": F.lit(""), "schema_id_value": F.lit(""),
        "key_is_null": F.lit(False), "application_id": F.lit(application), "consumer_group": F.lit(group), "host": F.lit(socket.gethostname()),
        "headers": F.lit(None).cast("map<string,string>"), "raw_text": F.lit(None).cast("string"),
    }
    return letters.withColumns({k: v for k, v in more.items() if k not in letters.columns})


def read_dead_letters(dead: ChangeLog, topic: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored dead letters with a message id of their topic, partition and offset, the oldest first if limited."""
    rows = dead.read().withColumn("message_id", F.concat_ws("/", "topic", "partition", "offset"))
    if topic is not None:
        rows = rows.where(F.col("topic") == topic)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return rows if limit is None else rows.orderBy("timestamp", "topic", "partition", "offset").limit(limit)


def for_each_row(handle: Callable[[dict], None], topic: str, action: str = SKIP, retry: RetryPolicy | None = None, dead: ChangeLog | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that calls handle with each row on the workers, as often as retry says. Rows that still fail
    are skipped, fail the batch, or are stored as dead letters: partition is the worker's task, offset the row's place in
    it beyond the epoch's first, and raw_text the row as JSON."""
    if action == DLQ and dead is None:
        raise ValueError("the DLQ policy needs a store")
    policy = retry or RetryPolicy(2 if action == RETRY else 1)

    def run(batch: DataFrame, epoch: int) -> None:
        def each(frames):
            at = epoch << 32
            for frame in frames:
                bad = []
                task = frame.pop("_task")
                for part, row in zip(task, frame.to_dict("records"), strict=True):
                    try:
                        policy.run(lambda row=row: handle(row))
                    except Exception as e:
                        bad.append((topic, int(part), at, type(e).__name__, str(e), traceback.format_exc(), json.dumps(row, default=str)))
                    at += 1
                yield pd.DataFrame(bad, columns=["topic", "partition", "offset", "error_type", "message", "stack", "raw_text"])

        kinds = "topic string, partition int, offset long, error_type string, message string, stack string, raw_text string"
        failed = batch.withColumn("_task", F.spark_partition_id()).mapInPandas(each, kinds)
        if action == DLQ:
            raw = failed.withColumn("timestamp", F.current_timestamp())
            dead.write(complete(envelope(raw, others=("raw_text",))), topic, epoch)
        elif action == RETRY:
            if n := failed.count():
                raise RuntimeError(f"{n} rows failed")
        else:
            failed.write.format("noop").mode("overwrite").save()

    return run
