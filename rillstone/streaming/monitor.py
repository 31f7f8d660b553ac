"""What runs tell: events, incidents, lag, late rows, and an orderly stop."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


@dataclass(frozen=True)
class Event:
    """Something a query did: started, progress, idle or terminated."""

    name: str
    query: str = ""
    success: bool = True
    message: str = ""
    at: dt.datetime = field(default_factory=_now)


@dataclass(frozen=True)
class Incident:
    """Something an operator of the system should look at."""

    name: str
    entity: str = ""
    period: str = ""
    keys: Mapping[str, object] = field(default_factory=dict)
    bucket: str | None = None
    notes: str = ""
    at: dt.datetime = field(default_factory=_now)


class Bus:
    """Hands what is published to one sink, if there is one; a sink that fails disturbs nobody."""

    def __init__(self):
        self.sink: Callable[[object], None] | None = None

    def publish(self, what: object) -> None:
        try:
            if self.sink:
                self.sink(what)
        except Exception as e:
            print(f"a sink failed: {type(e).__name__}: {e}")


events, incidents = Bus(), Bus()


class _Listener(StreamingQueryListener):
    def onQueryStarted(self, event):
        events.publish(Event("started", event.name or str(event.id)))

    def onQueryProgress(self, event):
        events.publish(Event("progress", event.progress.name or str(event.progress.id), message=f"rows={event.progress.numInputRows}"))

    def onQueryIdle(self, event):
        events.publish(Event("idle", str(event.id)))

    def onQueryTerminated(self, event):
        events.publish(Event("terminated", str(event.id), event.exception is None, event.exception or ""))


def listen(spark: SparkSession) -> Callable[[], None]:
    """Publishes what all queries of the session do; call what is returned to end that."""
    listener = _Listener()
    spark.streams.addListener(listener)
    return lambda: spark.streams.removeListener(listener)


def _numbers(offset, at: tuple = ()) -> dict[tuple, int]:
    """Offsets by topic and partition, whether given as JSON text or parsed."""
    if isinstance(offset, str):
        try:
            offset = json.loads(offset)
        except ValueError:
            return {}
    if isinstance(offset, dict):
        return {k: v for name, x in offset.items() for k, v in _numbers(x, (*at, name)).items()}
    return {at: offset} if isinstance(offset, int) and not isinstance(offset, bool) else {}


def lag(progress: Mapping | None) -> dict[str, int]:
    """sum and max, over all partitions, of the offsets that a query's last progress had still to read. Sources that don't
    tell their latest offset count as read."""
    behind = [0]
    for source in (progress or {}).get("sources", []):
        done = _numbers(source.get("endOffset"))
        behind += [max(0, high - max(0, done.get(k, 0))) for k, high in _numbers(source.get("latestOffset")).items()]
    return {"sum": sum(behind), "max": max(behind)}


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as too late, over the progress Spark still knows."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def stop(query: StreamingQuery) -> None:
    """Stops after what has come is taken and closed windows are out; open ones stay in the checkpoint for the next start."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
