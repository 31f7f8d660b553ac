"""The bar cascade: a one-second hub, frames merged from it, latest rows, gap filling and order guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.operators.aggregates import Agg, final, merged, partial
from rillstone.operators.windows import Frame, floor, window_of

HUB = Frame(1, "s")


def names(base: str, frames: list[Frame]) -> dict[str, str]:
    """Names of the derived objects: hub, latest rows, and each frame's live bars."""
    return {"hub": f"{base}_1s_rows", "last": f"{base}_1s_rows_last"} | {str(f): f"{base}_{f}_live" for f in frames}


def hub(ticks: DataFrame, keys: list[str], ts: str, aggs: dict[str, Agg]) -> DataFrame:
    """keys, bucket and the aggregates' parts for each key and second that has rows. Filters belong before it."""
    return _hub(ticks, keys, ts, aggs).drop("_day")


def _hub(ticks: DataFrame, keys: list[str], ts: str, aggs: dict[str, Agg]) -> DataFrame:
    """hub() with the day of each bucket, dealt by key and day: frames of up to a day need no further exchange, and a key
    with many rows is spread over its days."""
    days = ticks.withColumn("_day", F.date_trunc("day", ts).cast("timestamp_ntz")).repartition(*keys, "_day")
    w = days.groupBy(*keys, "_day", window_of(ts, HUB).alias("_w")).agg(*partial(aggs))
    parts = [c for c in w.columns if c not in (*keys, "_day", "_w")]
    return w.select(*keys, "_day", F.col("_w.start").alias("bucket"), *parts)


def cascade(ticks: DataFrame, keys: list[str], ts: str, aggs: dict[str, Agg], frames: list[Frame]) -> dict[str, DataFrame]:
    """Bars (keys, bucket, aggregates) of each frame, merged from the longest shorter frame that divides it, so later
    frames read few rows. Rows are exchanged once, by key and day; only frames beyond a day exchange what days have left.
    Each frame is a plan of its own: where several are written, give the hub as a table (hub(), written once)."""
    made: dict[Frame, DataFrame] = {HUB: _hub(ticks, keys, ts, aggs)}
    out = {}
    for f in sorted(frames, key=lambda f: f.rank):
        whole = lambda g: (f.seconds or 86400) % g.seconds == 0 and g.seconds % 604800 if f.unit == "mo" else f.seconds % g.seconds == 0
        source = max((g for g in made if g.seconds and (g == HUB or whole(g))), key=lambda g: g.seconds)
        within = f.unit != "mo" and bool(f.seconds) and 86400 % f.seconds == 0
        by = [*keys, "_day"] if within else keys
        made[f] = made[source].groupBy(*by, floor("bucket", f).alias("bucket")).agg(*merged(aggs))
        out[str(f)] = made[f].select(*keys, "bucket", *final(aggs))
    return out


def rows_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; ties in `order` go to the largest values of the other columns."""
    values = [c for c in rows.columns if c not in keys]
    rest = [c for c in values if c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_l")).select(*keys, *[F.col(f"_l.{c}") for c in values])


def fill_gaps(bars: DataFrame, keys: list[str], frame: Frame, close: str = "close", others: tuple[str, ...] = ("open", "high", "low"), until: str | None = None) -> DataFrame:
    """bars with a flat bar (all prices the previous close) in each empty bucket up to the key's next bar, or until a
    given time behind its last. Each bar brings its gap, so bars are made once and nothing is sorted but each key's."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    step = F.expr(f"INTERVAL {frame.interval()}")
    end = F.lead("bucket").over(w)
    if until:
        end = F.coalesce(end, F.lit(until).cast(bars.schema["bucket"].dataType))
    last = F.when(end > F.col("bucket") + step, end - step).otherwise(F.col("bucket"))
    made = bars.withColumn("_last", last).select("*", F.posexplode(F.sequence("bucket", "_last", step)).alias("_k", "_b"))
    own = F.col("_k") == 0
    blank = [c for c in bars.columns if c not in (*keys, "bucket", close, *others)]
    flat = {"bucket": F.col("_b"), "filled": ~own} | {c: F.when(own, F.col(c)).otherwise(F.col(close)) for c in others} | {c: F.when(own, F.col(c)) for c in blank}
    return made.withColumns(flat).select(*bars.columns, "filled")


def dedup_in_window(ticks: DataFrame, keys: list[str], ts: str, watermark: str | None = None) -> DataFrame:
    """One row for each (keys, exact time). In a stream, within the watermark."""
    if ticks.isStreaming:
        return ticks.withWatermark(ts, watermark or "1 second").dropDuplicatesWithinWatermark([*keys, ts])
    return ticks.dropDuplicates([*keys, ts])


def monotonic_guard(ticks: DataFrame, keys: list[str], ts: str, arrival: str) -> DataFrame:
    """Drops rows whose second is before one the key has shown already, in order of arrival."""
    w = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    second = F.date_trunc("second", ts)
    return ticks.withColumn("_seen", F.max(second).over(w)).where(F.col("_seen").isNull() | (second >= F.col("_seen"))).drop("_seen")


def previous_change(rates: DataFrame, keys: list[str], ts: str, bid: str, ask: str, close: str) -> DataFrame:
    """Adds previous_close (0 at first) and change of the mid price against it (0 where it is 0)."""
    prev = F.lag(close, 1, 0.0).over(Window.partitionBy(*keys).orderBy(ts))
    out = rates.withColumn("previous_close", prev)
    return out.withColumn("change", F.when(F.col("previous_close") == 0, 0.0).otherwise(((F.col(bid) + F.col(ask)) / 2 - F.col("previous_close")) / F.col("previous_close")))


def newest(rows: DataFrame, keys: list[str], order: list, n: int = 10) -> DataFrame:
    """The n first rows of each key by `order`: top-n reports, and retention of a table's newest n bars."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
