import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillstone.functions.registry import call
from rillstone.model import STREAM, TABLE, Entity, ModelError
from rillstone.operators import aggregates as A
from rillstone.operators import bars, joins
from rillstone.operators.windows import Frame
from rillstone.plans.query import Query
from rillstone.sources import io
from rillstone.streaming.context import StreamContext
from rillstone.streaming.errors import DlqOptions, envelope, gate

BASE = dt.datetime(2025, 10, 13, 9, 0)
TICK = Entity("tick", {"k": "string", "ts": "datetime", "v": "double", "id": "long"}, ("k",), "ts")
EVENTS = "/root/testdata/sf0.001/events.parquet"


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ohlc():
    return {"open": A.earliest("value", "ts", "event_id"), "high": A.max_("value"), "low": A.min_("value"), "close": A.latest("value", "ts", "event_id")}


def test_a_cascade_exchanges_rows_once(spark):
    e = spark.read.parquet(EVENTS)
    made = bars.cascade(e, ["event_type"], "ts", ohlc(), [Frame.of(x) for x in ("1m", "5m", "1h", "6h")])
    assert all(plan(df).count("Exchange") == 1 for df in made.values())


def test_gaps_are_filled_in_one_pass(spark):
    made = bars.cascade(spark.read.parquet(EVENTS), ["event_type"], "ts", ohlc(), [Frame.of("1h")])["1h"]
    assert plan(bars.fill_gaps(made, ["event_type"], Frame.of("1h"))).count("FileScan") == 1


def test_gaps_until_a_given_end(spark):
    rows = spark.createDataFrame([("a", at(0), 1.0, 1.0, 1.0, 2.0, 5)], "k string, bucket timestamp_ntz, open double, high double, low double, close double, n int")
    got = bars.fill_gaps(rows, ["k"], Frame.of("1m"), until=str(at(180))).orderBy("bucket").collect()
    assert [(r["bucket"], r["open"], r["n"], r["filled"]) for r in got] == [(at(0), 1, 5, False), (at(60), 2, None, True), (at(120), 2, None, True)]


def test_largest_values_prune_before_the_shuffle(spark):
    top = A.top_rows(spark.read.parquet(EVENTS), ["event_type"], "value", 5)
    assert "WindowGroupLimit" in plan(top)


def test_sessions_match_within_their_days(spark):
    ticks = spark.createDataFrame([("a", at(s)) for s in (-1, 0, 59, 60, 86400)], "k string, ts timestamp_ntz")
    schedule = spark.createDataFrame([("a", at(0), at(60)), ("a", at(43200), at(86400 + 1))], "sk string, o timestamp_ntz, c timestamp_ntz")
    seen = lambda **how: sorted((r["ts"] - BASE).total_seconds() for r in joins.join_session(ticks, schedule, [("k", "sk")], "ts", "o", "c", **how).collect())
    assert seen() == [0, 59, 86400]
    assert seen(open_inclusive=False, close_inclusive=True) == [59, 60, 86400]


def test_a_stream_join_forgets(spark, tmp_path):
    """Both sides of a time-bounded stream join have a watermark."""
    left, right = Entity("l", {"k": "string", "ts": "datetime"}, ("k",), "ts"), Entity("r", {"k2": "string", "ts2": "datetime"}, ("k2",), "ts2")
    for name, rows, kind in (("l", [("a", at(0)), ("b", at(0))], "k string, ts timestamp"), ("r", [("a", at(100)), ("b", at(400))], "k2 string, ts2 timestamp")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}")
    q = Query.from_(left).join(right, [("k", "k2")]).within(300).select(k="k", ts2="ts2")
    df = q.to_df({"l": io.read_stream(spark, left, f"{tmp_path}/l"), "r": io.read_stream(spark, right, f"{tmp_path}/r")})
    assert df._jdf.queryExecution().analyzed().toString().count("EventTimeWatermark") == 2
    run = df.writeStream.format("memory").queryName("joined").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r["k"] for r in spark.table("joined").collect()] == ["a"]


def test_late_rows_are_dropped_and_windows_close_once(spark, tmp_path):
    """Files come one at a time: a row behind the watermark's closed window changes nothing."""
    source = f"{tmp_path}/in"
    for k, rows in enumerate([[(1, 0), (2, 30)], [(3, 200)], [(4, 10)], [(5, 400)]]):
        spark.createDataFrame([("a", at(s), float(i), i) for i, s in rows], "k string, ts timestamp, v double, id long").coalesce(1).write.mode("append").parquet(source)
        if not k:
            q = Query.from_(TICK).group_by("k").tumbling(minutes=[1], grace="1 second").select(n=A.count(), last=A.latest("v", "ts", "id"))
        stream = io.read_stream(spark, TICK, source, files_per_trigger=1)
        out = q.to_frames({"tick": stream})["1m"].writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["bucket"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [n for _, n in got] == [2, 1] and len({b for b, _ in got}) == 2


def test_duplicates_in_a_stream_are_dropped(spark, tmp_path):
    spark.createDataFrame([("a", at(0), 1.0, 1), ("a", at(0), 2.0, 2), ("a", at(1), 3.0, 3)], "k string, ts timestamp, v double, id long").write.parquet(f"{tmp_path}/in")
    df = bars.dedup_in_window(io.read_stream(spark, TICK, f"{tmp_path}/in"), ["k"], "ts")
    df.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2


@pytest.mark.parametrize(
    "make",
    [
        lambda: Query.from_(TICK).group_by(F.lit(1)),
        lambda: Query.from_(TICK).join(Entity("t", {"x": "string"}, ("x",), kind=TABLE), [("k", "x")]).within(5).validate(),
        lambda: Query.from_(TICK).join(TICK, [("k", "k")], "left").within(5).validate(),
        lambda: Query.from_(TICK).order_by("a", "b", "c", "d", "e", "f").validate(strict=True),
        lambda: Query.from_(TICK).join(TICK, [("k", "k")]).join(TICK, [("k", "k")]).validate(strict=True),
        lambda: Query.from_(TICK).join(TICK, [("k", "k")], "left").group_by("k").hopping("ts", "5m", "1m").validate(),
        lambda: Query.from_(TICK).tumbling().validate(),
        lambda: Query.from_(TICK).where(F.sum("v") > 1),
        lambda: Query.from_(TICK).where(F.col("k").isNull() | (F.max("v") > 1)),
        lambda: Query.from_(TICK).group_by(F.count("v")),
        lambda: Query.from_(TICK).group_by(call("Trim", F.col("k"))).validate(strict=True),
        lambda: Query.from_(TICK).order_by(call("Hour", F.col("ts"))).validate(strict=True),
    ],
)
def test_rules(spark, make):
    with pytest.raises(ModelError):
        make()


def test_strict_allows_registered_functions(spark):
    keys = (call("Upper", F.col("k")).alias("u"), call("Year", F.col("ts")), F.col("v") + 1, F.coalesce("k", F.lit("?")))
    Query.from_(TICK).group_by(*keys).order_by(call("Abs", F.col("v")).desc(), call("Year", F.col("ts"))).validate(strict=True)
    Query.from_(TICK).group_by(call("Trim", F.col("k"))).validate()
    strict = StreamContext(spark, strict=True)
    strict.register(TICK, spark.createDataFrame([], "k string, ts timestamp, v double, id long"))
    with pytest.raises(ModelError):
        strict.define(Entity("x", {"k": "string"}, ("k",)), Query.from_(TICK).order_by(call("Trim", F.col("k"))).select(k="k"))


def test_a_stream_has_no_order(spark, tmp_path):
    spark.createDataFrame([("a", at(0), 1.0, 1)], "k string, ts timestamp, v double, id long").write.parquet(f"{tmp_path}/in")
    stream = {"tick": io.read_stream(spark, TICK, f"{tmp_path}/in")}
    with pytest.raises(ModelError):
        Query.from_(TICK).order_by("v").to_df(stream)
    assert Query.from_(TICK).order_by("v").to_df({"tick": spark.read.parquet(f"{tmp_path}/in")}).count() == 1


def test_where_after_group_by_filters_groups(spark):
    e = spark.read.parquet(EVENTS)
    q = Query.from_(e).group_by("event_type").where(F.col("n") > 100).select(event_type="event_type", n=A.count())
    assert {r["event_type"] for r in q.to_df().collect()} == {r["event_type"] for r in e.groupBy("event_type").count().where("count > 100").collect()}


def test_distinct_counts_use_sparks_own(spark):
    df = A.aggregate(spark.read.parquet(EVENTS), ["event_type"], {"n": A.count(), "users": A.count_distinct("user_id").cast("string")})
    assert df.columns == ["event_type", "n", "users"] and "collect_set" not in plan(df)


def test_entity_sets(spark, tmp_path):
    c = StreamContext(spark)
    table = Entity("t", {"k": "string", "b": "long", "v": "double"}, ("k", "b"), kind=TABLE)
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 4.0)], "k string, b long, v double")
    held = c.register(table, rows)
    assert held.limit(2, "b").count() == 3 and len(held.to_list(2)) == 2
    held.remove(spark.createDataFrame([("a", 1)], "k string, b long"))
    held.add(spark.createDataFrame([("c", 1, 5.0)], "k string, b long, v double"))
    assert c.pull_count("t") == 4 and c.pull_rows("t", F.col("k") == "a", 1).count() == 1
    assert io.key_prefix(held.df, ["k", "b"], ("a",)).count() == 2
    assert [r["w"] for r in held.map(w=F.col("v") * 2).orderBy("w").collect()] == [4, 6, 8, 10]
    assert "-- TABLE T " in c.script().upper() and set(c.schemas()) == {"t-key", "t-value"} and "Physical Plan" in c.explain("t")
    stream = Entity("s", {"k": "string", "b": "long", "v": "double"}, ("k",))
    io.write(held.df, stream, f"{tmp_path}/s")
    live = c.register(stream, io.read_stream(spark, stream, f"{tmp_path}/s"))
    with pytest.raises(ModelError):
        live.to_list()
    with pytest.raises(ModelError):
        live.limit(1, "b")
    seen = []
    live.for_each(lambda batch, epoch: seen.append(batch.count()), f"{tmp_path}/ck").awaitTermination()
    assert sum(seen) == 4
    c.dead_letters = "s"
    with pytest.raises(ModelError):
        live.for_each(lambda b, e: None, f"{tmp_path}/x", "DLQ", dead=lambda b, e: None)
    pushed = []
    c.push("s", lambda batch, epoch: pushed.append(batch.count()), f"{tmp_path}/ck2", "append").awaitTermination()
    assert sum(pushed) == 4
    io.write_stream(live.df, f"{tmp_path}/copy", f"{tmp_path}/ck3").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 4
    assert live.entity.kind == STREAM


def test_bars_by_name(spark):
    c = StreamContext(spark)
    e = spark.read.parquet(EVENTS)
    c.define_bars("t", Query.from_(e).group_by("event_type").tumbling("ts", minutes=[1, 5]).select(**ohlc()))
    assert c.frames["t_1s_rows_last"].count() == e.select("event_type").distinct().count()
    assert c.read_bars("t", "5m", {"event_type": "click"}).count() > 10
    with pytest.raises(ModelError):
        c.read_bars("t", "5s", {})


def test_dead_letters(spark):
    rows = spark.createDataFrame([("t", 0, i, at(i), "x" if i % 2 else "y", "m" * 3000, "s  \n" * 2000) for i in range(400)], "topic string, partition int, offset long, timestamp timestamp_ntz, error_type string, message string, stack string")
    key = ("topic", "partition", "offset")
    assert gate(rows, DlqOptions(exclude=("x",)), "error_type", "timestamp", key).count() == 200
    half = gate(rows, DlqOptions(sampling=0.5), "error_type", "timestamp", key)
    assert 140 < half.count() < 260 and half.count() == gate(rows, DlqOptions(sampling=0.5), "error_type", "timestamp", key).count()
    got = envelope(rows.limit(1)).first()
    assert len(got["error_message"]) == 1024 and len(got["stack_trace"]) == 2048 and len(got["fingerprint"]) == 64


def test_retention(spark):
    rows = spark.createDataFrame([(at(0),), (at(10),)], "t timestamp_ntz")
    assert io.retained(rows, "t", str(at(12)), 5000).count() == 1
