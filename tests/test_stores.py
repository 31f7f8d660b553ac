import datetime as dt
import json
import time

import pytest

from rillstone.__main__ import main
from rillstone.model import READ_ONLY, TABLE, Entity, ModelError
from rillstone.operators import aggregates as A
from rillstone.plans.query import Query
from rillstone.sources import io
from rillstone.sources.changelog import ChangeLog
from rillstone.streaming import monitor
from rillstone.streaming.context import StreamContext
from rillstone.streaming.errors import DEAD_LETTER, RetryPolicy, read_dead_letters

BASE = dt.datetime(2025, 10, 13, 9, 0)
TICK = Entity("tick", {"k": "string", "ts": "datetime", "v": "double", "id": "long"}, ("k",), "ts")
LAST = Entity("last", {"k": "string", "v": "double"}, ("k",), kind=TABLE)
SUMS = Entity("sums", {"k": "string", "n": "long", "s": "double"}, ("k",), kind=TABLE)
BARS = Entity("t_1m_live", {"k": "string", "bucket": "datetime", "open": "double", "high": "double", "low": "double", "close": "double", "n": "long?"}, ("k", "bucket"), kind=TABLE)
KINDS = "k string, ts timestamp, v double, id long"


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def put(spark, path, rows):
    spark.createDataFrame([(k, at(s), float(v), i) for k, s, v, i in rows], KINDS).coalesce(1).write.mode("append").parquet(path)


def live(spark, path):
    return io.read_stream(spark, TICK, path, files_per_trigger=1)


def test_stored_table(spark, tmp_path):
    held = StreamContext(spark).store(LAST, f"{tmp_path}/last")
    assert held.to_list() == []
    held.add(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"))
    held.add(spark.createDataFrame([("a", 3.0)], "k string, v double"))
    assert {tuple(r) for r in held.to_list()} == {("a", 3.0), ("b", 2.0)}
    held.remove(spark.createDataFrame([("b",)], "k string"))
    assert [tuple(r) for r in held.to_list()] == [("a", 3.0)]
    held.add(spark.createDataFrame([("b", 4.0)], "k string, v double"))
    log = held.context.stores["last"]
    assert {tuple(r) for r in log.copy(f"{tmp_path}/copy").read().collect()} == {("a", 3.0), ("b", 4.0)}
    with pytest.raises(ModelError):
        log.write(spark.createDataFrame([("a",)], "k string"))
    with pytest.raises(ModelError):
        log.write(held.df, "../x")
    with pytest.raises(ModelError):
        ChangeLog(spark, Entity("r", {"k": "string"}, ("k",), access=READ_ONLY), f"{tmp_path}/r").write(held.df)


def test_a_repeated_epoch_is_written_once(spark, tmp_path):
    log = ChangeLog(spark, TICK, f"{tmp_path}/log")
    rows = spark.createDataFrame([("a", at(0), 1.0, 1)], KINDS)
    for epoch in (0, 1, 1):
        log.write(rows, "w", epoch)
    log.write(rows, "other", 1)
    assert log.read().count() == 3


def test_persistent_queries(spark, tmp_path):
    c, source = StreamContext(spark), f"{tmp_path}/in"
    put(spark, source, [("a", 0, 1, 1), ("b", 0, 5, 2)])
    c.register(TICK, live(spark, source))
    q = Query.from_(TICK).group_by("k").select(k="k", n=A.count(), s=A.sum_("v"))
    run = lambda: c.persist(SUMS, q, f"{tmp_path}/sums", f"{tmp_path}/ck", retry=RetryPolicy(2, 0)).awaitTermination()
    run()
    put(spark, source, [("a", 10, 2, 3)])
    run()
    assert {tuple(r) for r in c.pull_rows("sums").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}
    big, small = Query.from_(TICK).where("v > 1"), Query.from_(TICK).where("v <= 1")
    both = Entity("both", TICK.fields, TICK.keys, "ts")
    for k, one in enumerate((big, small)):
        c.persist(both, one, f"{tmp_path}/both", f"{tmp_path}/ck{k}", f"w{k}").awaitTermination()
    assert sorted(r["id"] for r in c.pull_rows("both").collect()) == [1, 2, 3]
    with pytest.raises(ModelError):
        c.persist(both, q, f"{tmp_path}/x")
    with pytest.raises(ModelError):
        c.persist(both, big, f"{tmp_path}/x")


def test_gaps_are_filled_as_bars_come(spark, tmp_path):
    """Bars of different batches are joined by flat bars, and a restart goes on from the last."""
    c, source = StreamContext(spark), f"{tmp_path}/in"
    ohlc = {"open": A.earliest("v", "ts", "id"), "high": A.max_("v"), "low": A.min_("v"), "close": A.latest("v", "ts", "id"), "n": A.count()}
    q = Query.from_(TICK).group_by("k").tumbling(minutes=[1], grace="1 second").select(**ohlc)
    for rows in ([("a", 0, 1, 1), ("a", 30, 2, 2)], [("a", 200, 7, 3)], [("a", 400, 9, 4), ("b", 400, 1, 5)], [("a", 600, 9, 6)]):
        put(spark, source, rows)
        c.register(TICK, live(spark, source))
        c.persist_bars(BARS, q, f"{tmp_path}/bars", f"{tmp_path}/ck", fill=True).awaitTermination()
    got = [tuple(r) for r in c.pull_rows("t_1m_live").orderBy("k", "bucket").select("k", "bucket", "open", "close", "n").collect()]
    want = [("a", at(0), 1, 2, 2), ("a", at(60), 2, 2, None), ("a", at(120), 2, 2, None), ("a", at(180), 7, 7, 1)]
    want += [("a", at(240), 7, 7, None), ("a", at(300), 7, 7, None), ("a", at(360), 9, 9, 1), ("b", at(360), 1, 1, 1)]
    assert got == want


def test_buckets_are_written_and_waited_for(spark, tmp_path):
    c, seen = StreamContext(spark), []
    c.store(BARS, f"{tmp_path}/bars")
    monitor.incidents.sink = seen.append
    assert not c.wait_for_bucket("t", "1m", {"k": "a"}, str(at(60)), timeout=0.1, poll=0.05)
    assert [(x.name, x.period) for x in seen] == [("timebucket_timeout", "1m")]
    c.write_bars("t", "1m", spark.createDataFrame([("a", at(60), 1.0, 1.0, 1.0, 1.0, 1)], "k string, bucket timestamp, open double, high double, low double, close double, n long"))
    assert c.wait_for_bucket("t", "1m", {"k": "a"}, str(at(60)), timeout=1)
    assert c.wait_for_bucket("t", "1m", {"k": "a"}, str(at(62)), tolerance=2, timeout=1)
    assert not c.wait_for_bucket("t", "1m", {"k": "b"}, str(at(60)), timeout=0)
    assert c.read_bars("t", "1m", {"k": "a"}, str(at(60))).count() == 1
    with pytest.raises(ModelError):
        c.wait_for_bucket("t", "1m", {}, str(at(60)))
    with pytest.raises(ModelError):
        c.write_bars("t", "5m", c.frame("t_1m_live"))
    monitor.incidents.sink = None


def test_rows_that_fail_become_dead_letters(spark, tmp_path):
    c, source = StreamContext(spark), f"{tmp_path}/in"
    put(spark, source, [("a", 0, 1, 1), ("a", 1, 2, 2), ("b", 2, 3, 3)])
    held = c.register(TICK, live(spark, source))
    dead = ChangeLog(spark, DEAD_LETTER, f"{tmp_path}/dead")

    def handle(row):
        if row["id"] == 2:
            raise ValueError("two is refused")

    held.for_each_row(handle, f"{tmp_path}/ck", "DLQ", RetryPolicy(2, 0), dead).awaitTermination()
    got = read_dead_letters(dead, "tick", limit=5).collect()
    assert [(r["error_type"], r["error_message"], json.loads(r["raw_text"])["id"], r["payload_format_value"]) for r in got] == [("ValueError", "two is refused", 2, "json")]
    assert got[0]["message_id"].startswith("tick/") and len(got[0]["fingerprint"]) == 64
    assert read_dead_letters(dead, "other").count() == 0
    held.for_each_row(handle, f"{tmp_path}/ck2").awaitTermination()
    failing = held.for_each_row(handle, f"{tmp_path}/ck3", "Retry", RetryPolicy(1))
    with pytest.raises(Exception, match="1 rows failed"):
        failing.awaitTermination()
    c.dead_letters = "tick"
    with pytest.raises(ModelError):
        held.for_each_row(handle, f"{tmp_path}/ck4", "DLQ", dead=dead)


def test_lag():
    source = {"endOffset": {"t": {"0": 5, "1": 7}}, "latestOffset": '{"t": {"0": 9, "1": 7, "2": 3}}'}
    assert monitor.lag({"sources": [source, {"endOffset": "x", "latestOffset": None}]}) == {"sum": 7, "max": 4}
    assert monitor.lag(None) == {"sum": 0, "max": 0}


def test_events_late_rows_and_stop(spark, tmp_path):
    source, seen = f"{tmp_path}/in", []
    put(spark, source, [("a", 0, 1, 1), ("a", 300, 1, 2)])
    monitor.events.sink = seen.append
    end = monitor.listen(spark)
    q = Query.from_(TICK).group_by("k").tumbling(minutes=[1], grace="1 second").select(n=A.count())
    run = q.to_df({"tick": live(spark, source)}).writeStream.format("memory").queryName("closed").outputMode("append").start()
    run.processAllAvailable()
    put(spark, source, [("a", 10, 1, 3)])
    monitor.stop(run)
    assert not run.isActive and [r["n"] for r in spark.table("closed").collect()] == [1]
    assert monitor.late_rows(run) == 1
    deadline = time.time() + 10
    while not any(e.name == "terminated" for e in seen) and time.time() < deadline:
        time.sleep(0.1)
    end()
    monitor.events.sink = None
    assert {"started", "progress", "terminated"} <= {e.name for e in seen}


def make(spark):
    c = StreamContext(spark)
    c.register(LAST, spark.createDataFrame([("a", 1.0)], "k string, v double"))
    return c


def test_command_line(spark, tmp_path, capsys):
    assert main(["script", "-c", f"{__name__}:make"]) == 0
    assert "-- TABLE last" in capsys.readouterr().out
    main(["schema", "-c", f"{__name__}:make", "-o", f"{tmp_path}/s.json"])
    assert set(json.loads((tmp_path / "s.json").read_text())) == {"last-key", "last-value"}
