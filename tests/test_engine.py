import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillstone.functions import registry
from rillstone.model import STREAM, TABLE, Entity, ModelError
from rillstone.operators import aggregates as A
from rillstone.operators import bars, joins
from rillstone.operators.windows import Frame, add, floor, frames, validate_frames
from rillstone.plans.query import Query
from rillstone.sources import io
from rillstone.streaming.context import StreamContext
from rillstone.streaming.errors import CircuitBreaker, DlqOptions, RetryPolicy, for_each_batch, gate, split_bad

BASE = dt.datetime(2025, 10, 13, 22, 31)
RATE = Entity("rate", {"broker": "string", "symbol": "string", "ts": "datetime", "bid": "double", "id": "long"}, ("broker", "symbol"), "ts")


def ticks(spark, rows):
    data = [("b", "s", t, float(p), i) for i, (t, p) in enumerate(rows)]
    return spark.createDataFrame(data, "broker string, symbol string, ts timestamp_ntz, bid double, id long")


def ohlc():
    return {"open": A.earliest("bid", "ts", "id"), "high": A.max_("bid"), "low": A.min_("bid"), "close": A.latest("bid", "ts", "id")}


def four(spark):
    return ticks(spark, [(BASE + dt.timedelta(seconds=s), p) for s, p in ((14, 100), (33, 105), (53, 99), (68, 101))])


def test_one_and_five_minute_bars(spark):
    made = Query.from_(four(spark)).group_by("broker", "symbol").tumbling("ts", minutes=[5, 1]).select(**ohlc()).to_frames()
    one = [tuple(r)[2:] for r in made["1m"].orderBy("bucket").collect()]
    assert one == [(BASE, 100, 105, 99, 99), (BASE + dt.timedelta(minutes=1), 101, 101, 101, 101)]
    assert [tuple(r)[2:] for r in made["5m"].collect()] == [(BASE.replace(minute=30), 100, 105, 99, 101)]


def test_gap_filling_is_flat(spark):
    start = dt.datetime(2025, 9, 5, 12)
    df = ticks(spark, [(start + dt.timedelta(seconds=s), round(100 + 0.01 * s, 4)) for s in range(600) if not 60 <= s < 120])
    q = Query.from_(df).group_by("broker", "symbol").tumbling("ts", minutes=[1, 5], continuation=True).select(**ohlc())
    made = q.to_frames()
    got = made["1m"].orderBy("bucket").collect()
    assert len(got) == 10 and len(made["5m"].collect()) == 2
    assert got[1]["open"] == got[1]["high"] == got[1]["low"] == got[1]["close"] == got[0]["close"]


def test_sessions_keep_the_weekend_out(spark):
    friday, monday = dt.datetime(2025, 9, 5, 12), dt.datetime(2025, 9, 8, 12)
    rows = [(d + dt.timedelta(minutes=m), 100 + m) for d in (friday, monday) for m in range(10)] + [(friday + dt.timedelta(days=k), 999) for k in (1, 2)]
    schedule = spark.createDataFrame([("b", "s", d, d + dt.timedelta(minutes=10)) for d in (friday, monday)], "sb string, ss string, open_at timestamp_ntz, close_at timestamp_ntz")
    q = Query.from_(ticks(spark, rows)).time_frame(schedule, [("broker", "sb"), ("symbol", "ss")], "open_at", "close_at").group_by("broker", "symbol")
    got = q.tumbling("ts", minutes=[1]).select(**ohlc()).to_df().collect()
    assert len(got) == 20 and max(r["high"] for r in got) < 999


def test_periods(spark):
    t = F.lit("2025-08-20 10:07:03").cast("timestamp_ntz")
    want = {"5m": "2025-08-20 10:05:00", "1h": "2025-08-20 10:00:00", "1d": "2025-08-20 00:00:00", "1wk": "2025-08-18 00:00:00", "1mo": "2025-08-01 00:00:00"}
    got = spark.range(1).select(*[floor(t, Frame.of(k)).cast("string").alias(k) for k in want]).first().asDict()
    assert got == want
    assert str(spark.range(1).select(add(F.lit("2025-01-31").cast("timestamp_ntz"), Frame.of("1mo"))).first()[0]) == "2025-02-28 00:00:00"


def test_cascade_equals_direct_aggregation(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    aggs = {"n": A.count(), "set": A.collect_set("user_id"), "top": A.top_k("value", 3), "first": A.earliest("value", "ts", "event_id"), "m": A.expr(lambda x: F.round(x, 6), A.avg("value"))}
    made = bars.cascade(df, ["event_type"], "ts", aggs, frames(minutes=[5], hours=[1], days=[1], weeks=[1], months=[1]))
    for f, got in made.items():
        direct = A.aggregate(df, ["event_type", floor("ts", Frame.of(f)).alias("bucket")], aggs)
        assert got.exceptAll(direct).count() == direct.exceptAll(got).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.write.parquet(str(tmp_path / "in"))
    events = Entity("events", {"event_id": "long", "ts": "datetime", "user_id": "long", "event_type": "string", "value": "double"}, ("user_id",), "ts")
    stream = io.read_stream(spark, events, str(tmp_path / "in"))
    q = Query.from_(events).group_by("event_type").tumbling(hours=[1]).select(n=A.count(), high=A.max_("value"))
    out = q.to_frames({"events": stream})["1h"]
    run = out.writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    want = q.to_frames({"events": df.withColumn("ts", F.col("ts").cast("timestamp"))})["1h"]
    closed = spark.table("bars").select("event_type", F.col("bucket").cast("string"), "n", "high")
    assert closed.count() > 50
    assert closed.exceptAll(want.select("event_type", F.col("bucket").cast("string"), "n", "high")).count() == 0


@pytest.mark.parametrize(
    "make",
    [
        lambda: Entity("t", {"a": "int"}, kind=TABLE),
        lambda: Entity("t", {"a": "enum"}),
        lambda: Entity("t", {"a": "int"}, ("b",)),
        lambda: Entity("t", {"a": "int"}, timestamp="a"),
        lambda: validate_frames([Frame(5, "s")], 10),
        lambda: validate_frames([], 7),
        lambda: Query.from_(RATE).select(a="bid").where(F.lit(True)),
        lambda: Query.from_(RATE).where(F.lit(True)).join(RATE, [("id", "id")]),
        lambda: Query.from_(RATE).within(0),
        lambda: Query.from_(RATE).having(F.lit(True)),
        lambda: Query.from_(RATE).tumbling(minutes=[1]).validate(),
        lambda: Query.from_(RATE).tumbling(minutes=[1]).hopping("ts", "5m", "1m"),
        lambda: Query.from_(RATE).select(a="bid", n=A.count()).validate(),
        lambda: Query.from_(RATE).select(a="bid").select(b="bid"),
        lambda: Query.from_(RATE).group_by("broker").partition_by("symbol").validate(),
        lambda: Query.from_(RATE).group_by(*[f"k{i}" for i in range(11)]).validate(strict=True),
        lambda: Frame.of("5x"),
    ],
)
def test_rules(spark, make):
    with pytest.raises(ModelError):
        make()


def test_kind_and_target(spark):
    assert Query.from_(RATE).select(a="bid").kind() == STREAM and Query.from_(RATE).select(n=A.count()).kind() == TABLE
    target = Entity("out", {"symbol": "string", "total": "decimal(18,4)"}, ("symbol",), kind=TABLE)
    q = Query.from_(four(spark)).group_by("symbol").select(symbol="symbol", total=A.sum_("bid"))
    assert StreamContext(spark).define(target, q).to_list()[0]["total"] == 405
    with pytest.raises(ModelError):
        q.to_df(target=Entity("out", {"total": "decimal", "symbol": "string"}))


def test_registry(spark):
    assert len(registry.names()) >= 80
    with pytest.raises(NotImplementedError):
        registry.call("Nope", F.lit(1))
    with pytest.raises(ValueError):
        registry.call("Trim", F.lit("a"), F.lit("b"))
    with pytest.raises(ModelError):
        joins.join_within(four(spark), four(spark), [("id", "id")], "ts", "ts", explicit=True)


def test_tombstones_and_latest(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, None, True)], "k int, o int, v string, _deleted boolean")
    assert [tuple(r) for r in io.without_deleted(log, ["k"], ["o"]).collect()] == [(1, 2, "b")]


def test_errors(spark):
    tries, waits = [], []
    with pytest.raises(ZeroDivisionError):
        RetryPolicy(4, 1, "exponential", 3).run(lambda: tries.append(1) or 1 / 0, waits.append)
    assert len(tries) == 4 and waits == [1, 2, 3]
    breaker = CircuitBreaker(2, 10, lambda: 0)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker.call(lambda: 1 / 0)
    with pytest.raises(RuntimeError):
        breaker.call(lambda: 1)
    dead = []
    for_each_batch(lambda b, e: 1 / 0, "DLQ", dead=lambda b, e: dead.append(e))(spark.range(1), 0)
    assert len(dead) == 1
    good, bad = split_bad(spark.createDataFrame([('{"a": 1}',), ("nope",), (None,), ("",)], "v string"), "v", "a int")
    assert [r["a"] for r in good.collect()] == [1] and [r["v"] for r in bad.collect()] == ["nope"]
    rows = spark.createDataFrame([(i, BASE, "x") for i in range(5)], "k int, t timestamp_ntz, e string")
    assert gate(rows, DlqOptions(per_second=2), "e", "t", ["k"]).count() == 2 and gate(rows, DlqOptions(enabled=False), "e", "t", ["k"]).count() == 0
