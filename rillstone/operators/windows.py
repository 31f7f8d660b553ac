"""Time windows, periods and their arithmetic, all in UTC."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillstone.model import ModelError

_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "wk": 604800}
_NAMES = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "wk": "weeks", "mo": "months"}


@dataclass(frozen=True, order=True)
class Frame:
    """A timeframe such as 5m, 1h, 1d, 1wk, 1mo."""

    n: int
    unit: str

    @staticmethod
    def of(token: str | Frame) -> Frame:
        if isinstance(token, Frame):
            return token
        m = re.fullmatch(r"(\d+)(s|m|h|d|wk|mo)", token)
        if not m or not int(m[1]):
            raise ModelError(f"{token} isn't a timeframe")
        return Frame(int(m[1]), m[2])

    def __str__(self) -> str:
        return f"{self.n}{self.unit}"

    @property
    def seconds(self) -> int | None:
        return None if self.unit == "mo" else self.n * _SECONDS[self.unit]

    @property
    def rank(self) -> int:
        return self.seconds or self.n * 28 * 86400

    def interval(self) -> str:
        return f"{self.n} {_NAMES[self.unit]}"


def frames(minutes=(), hours=(), days=(), weeks=(), months=(), seconds=()) -> list[Frame]:
    """Without repeats, shortest first."""
    given = zip(("s", "m", "h", "d", "wk", "mo"), (seconds, minutes, hours, days, weeks, months), strict=True)
    return sorted({Frame(n, u) for u, ns in given for n in ns}, key=lambda f: f.rank)


def validate_frames(found: list[Frame], base_seconds: int = 10) -> None:
    """The base unit divides a minute; frames are its multiples; from a minute on they are whole minutes."""
    if base_seconds < 1 or 60 % base_seconds:
        raise ModelError("the base unit must divide 60 seconds")
    for f in found:
        if f.seconds and (f.seconds % base_seconds or f.seconds >= 60 and f.seconds % 60):
            raise ModelError(f"{f} isn't a multiple of {base_seconds} s, or not whole minutes")


def window_of(ts: Column | str, frame: Frame, advance: Frame | None = None) -> Column:
    """Spark's window column, aligned to the epoch; weeks begin on Monday. Months have no window: see floor()."""
    if frame.unit == "mo":
        raise ModelError("months have no fixed window; group by floor()")
    step = advance or frame
    begin = "4 days" if frame.seconds % 604800 == 0 and step.seconds % 86400 == 0 else None
    return F.window(ts, frame.interval(), step.interval(), begin) if advance or begin else F.window(ts, frame.interval())


def floor(ts: Column | str, frame: Frame) -> Column:
    """The start of the period around ts: calendar months, Monday weeks, otherwise multiples from the epoch."""
    t = F.col(ts) if isinstance(ts, str) else ts
    if frame.unit == "mo":
        month = F.date_trunc("month", t)
        return F.add_months(month, -((F.month(t) - 1) % frame.n)).cast("timestamp_ntz") if frame.n > 1 else month
    size = frame.seconds
    shift = 345600 if size % 604800 == 0 else 0
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t.cast("timestamp_ntz"))
    whole = seconds - F.pmod(seconds - shift, F.lit(size))
    return F.timestamp_add("SECOND", whole, F.lit("1970-01-01").cast("timestamp_ntz"))


def add(ts: Column | str, frame: Frame, times: int = 1) -> Column:
    """ts plus so many periods; months keep the time of day and clamp to the month's end."""
    t = F.col(ts) if isinstance(ts, str) else ts
    unit = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "wk": "WEEK", "mo": "MONTH"}[frame.unit]
    return F.timestamp_add(unit, F.lit(frame.n * times), t)


def hopping(ts: Column | str, size: Frame, advance: Frame) -> Column:
    if advance.rank > size.rank:
        raise ModelError("a hopping window can't advance by more than its size")
    return window_of(ts, size, advance)
