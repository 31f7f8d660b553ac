"""Joins: time-bounded stream joins, stream-table joins, and range joins against a session schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.model import ModelError

DEFAULT_WITHIN = 300


def _condition(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> Column:
    if not on:
        raise ModelError("a join needs keys")
    out = None
    for a, b in on:
        x, y = left.schema[a].dataType, right.schema[b].dataType
        if x != y:
            raise ModelError(f"join keys {a} and {b} differ in type: {x.simpleString()} and {y.simpleString()}")
        out = left[a] == right[b] if out is None else out & (left[a] == right[b])
    return out


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on pairs of columns; Catalyst picks the strategy. Any of Spark's kinds, self-joins too."""
    return left.join(right, _condition(left, right, on), how)


def join_within(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_ts: str, right_ts: str, seconds: float | None = None, explicit: bool = False, late: str | None = None) -> DataFrame:
    """Stream-stream inner join: keys equal and event times at most `seconds` apart, rounded up; 300 by default.

    In a stream both sides have a watermark (`late` behind the newest event time, or as long as the bound), so that rows
    which can't match any more are forgotten. In batch, rows are first matched by key and by time slot (a slot is as long as the bound; the right side goes into
    its own and the two beside it), so a key with many rows meets only those near in time.
    """
    if seconds is None:
        if explicit:
            raise ModelError("WITHIN must be given")
        seconds = DEFAULT_WITHIN
    if seconds <= 0:
        raise ModelError("WITHIN must be positive")
    bound = int(-(-seconds // 1))
    span = F.expr(f"INTERVAL {bound} SECONDS")
    near = (right[right_ts] >= left[left_ts] - span) & (right[right_ts] <= left[left_ts] + span)
    if left.isStreaming and right.isStreaming:
        a, b = (d.withWatermark(t, late or f"{bound} seconds") for d, t in ((left, left_ts), (right, right_ts)))
        near = (b[right_ts] >= a[left_ts] - span) & (b[right_ts] <= a[left_ts] + span)
        return a.join(b, _condition(a, b, on) & near)
    if left.isStreaming or right.isStreaming:
        return left.join(right, _condition(left, right, on) & near)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    slot = lambda d, t: F.floor(F.timestamp_diff("SECOND", epoch, d[t].cast("timestamp_ntz")) / bound)
    a = left.withColumn("_slot", slot(left, left_ts))
    b = right.withColumn("_near", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: k + slot(right, right_ts))))
    near = (b[right_ts] >= a[left_ts] - span) & (b[right_ts] <= a[left_ts] + span)
    return a.join(b, _condition(a, b, on) & (a["_slot"] == b["_near"]) & near).drop("_slot", "_near")


def join_session(rows: DataFrame, schedule: DataFrame, on: list[tuple[str, str]], ts: str, open_: str, close: str, open_inclusive: bool = True, close_inclusive: bool = False) -> DataFrame:
    """Rows inside a session of their key, with the schedule's columns: open <= t < close, each bound as flagged.
    Rows of an unknown key are outside every session. A session stands once for each day it touches, so that a row meets
    the sessions of its own day alone."""
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    days = F.explode(F.sequence(day(F.col(open_)), F.greatest(day(F.col(open_)), day(F.col(close))), F.expr("INTERVAL 1 DAY")))
    slotted = schedule.withColumn("_day", days)
    own = rows.withColumn("_of", day(F.col(ts)))
    t = own[ts]
    begin = slotted[open_] <= t if open_inclusive else slotted[open_] < t
    end = t <= slotted[close] if close_inclusive else t < slotted[close]
    return own.join(slotted, _condition(own, slotted, on) & (own["_of"] == slotted["_day"]) & begin & end).drop("_of", "_day")
