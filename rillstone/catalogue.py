"""One query for each operator over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.registry import call
from rillstone.model import TABLE, Entity
from rillstone.operators import aggregates as A
from rillstone.operators import bars, joins
from rillstone.operators.windows import Frame, add, floor
from rillstone.plans.query import Query
from rillstone.streaming.context import StreamContext
from rillstone.streaming.errors import DlqOptions, envelope, gate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TICKS = Entity("events", {"event_id": "long", "ts": "datetime", "user_id": "long", "event_type": "string", "value": "double", "props": "string?"}, ("user_id",), "ts")
ORDERS = Entity("orders", {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "datetime", "o_orderpriority": "string"}, ("o_orderkey",), "o_orderdate")
CUSTOMER = Entity("customer", {"c_custkey": "long", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}, ("c_custkey",), kind=TABLE)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add_(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add_


def _ohlc(ts: str = "ts", value: str = "value") -> dict[str, A.Agg]:
    return {
        "open": A.earliest(value, ts, "event_id"), "high": A.max_(value), "low": A.min_(value), "close": A.latest(value, ts, "event_id"),
        "total": A.expr(lambda s: F.round(s, 2), A.sum_(value)), "mean": A.expr(lambda m: F.round(m, 6), A.avg(value)), "cnt": A.count(),
    }


_OHLC = "arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, count(*) AS cnt"


@query("""SELECT event_id, user_id, value * 2 + 1 AS scaled, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band
FROM events WHERE event_type IN ('click', 'error', 'view') AND NOT (event_type IN ('error')) AND value IS NOT NULL AND props LIKE '{"k"%' AND NOT contains(props, '99') AND value * 2 - 1 > 3""")
def filter_project(spark, d):
    q = Query.from_(_t(spark, d, "events")).where(F.col("event_type").isin("click", "error", "view")).where(~F.col("event_type").isin("error") & F.col("value").isNotNull())
    q = q.where(call("StartsWith", F.col("props"), '{"k"') & ~call("Contains", F.col("props"), "99") & (F.col("value") * 2 - 1 > 3))
    band = call("Case", F.col("value") > 50, F.lit("high"), F.col("value") > 10, F.lit("mid"), F.lit("low"))
    return q.select(event_id="event_id", user_id="user_id", scaled=F.col("value") * 2 + 1, band=band).to_df()


@query("SELECT * FROM region")
def select_all(spark, d):
    return Query.from_(_t(spark, d, "region")).select("*").to_df()


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(sum(CASE WHEN o_totalprice > 200000 THEN o_totalprice ELSE 0 END), 2) AS large,
count(*) FILTER (WHERE o_totalprice > 200000) AS n_large FROM orders GROUP BY 1, 2 HAVING count(*) > 100 AND NOT (sum(o_totalprice) < 1000)""")
def group_having(spark, d):
    rounded = lambda c: A.expr(lambda s: F.round(s, 2), A.sum_(c))
    q = Query.from_(_t(spark, d, "orders")).group_by("o_orderstatus", "o_orderpriority").having((F.col("n") > 100) & ~(F.col("total") < 1000))
    large = F.col("o_totalprice") > 200000
    return q.select(o_orderstatus="o_orderstatus", o_orderpriority="o_orderpriority", n=A.count(), total=rounded("o_totalprice"), large=rounded(F.when(large, F.col("o_totalprice")).otherwise(0.0)), n_large=A.count_if(large)).to_df()


@query("SELECT year(o_orderdate) AS y, upper(substring(o_orderpriority, 1, 1)) AS p, coalesce(o_orderstatus, '?') AS s, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def group_expression(spark, d):
    keys = [call("Year", F.col("o_orderdate")).alias("y"), call("Upper", call("Left", F.col("o_orderpriority"), 1)).alias("p"), call("Coalesce", F.col("o_orderstatus"), "?").alias("s")]
    return Query.from_(_t(spark, d, "orders")).group_by(*keys).select(y="y", p="p", s="s", n=A.count()).to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def order_limit_offset(spark, d):
    q = Query.from_(_t(spark, d, "orders")).select(o_orderkey="o_orderkey", o_totalprice="o_totalprice")
    return q.order_by(F.col("o_totalprice").desc(), "o_orderkey").offset(5).limit(20).to_df()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def topn_per_key(spark, d):
    return bars.newest(_t(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def partition_by_folded(spark, d):
    return Query.from_(_t(spark, d, "orders")).select(o_custkey="o_custkey", o_orderstatus="o_orderstatus").distinct().to_df()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000")
def partition_by(spark, d):
    return Query.from_(_t(spark, d, "orders")).where(F.col("o_totalprice") > 300000).partition_by("o_custkey").select(o_orderkey="o_orderkey", o_custkey="o_custkey").to_df()


@query("SELECT count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders")
def count_query(spark, d):
    return Query.from_(_t(spark, d, "orders")).select(n=A.count(), top=A.max_("o_totalprice")).to_df()


@query("""SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, substring(c_name, 3, 4) AS sub, length(c_name) AS len, trim(concat(' ', c_name, ' ')) AS tr, replace(c_name, '0', 'x') AS rep,
contains(c_name, '1') AS has, starts_with(c_name, 'C') AS st, ends_with(c_name, '5') AS en, string_split(c_name, '#')[1] AS part, concat(c_name, '-', c_mktsegment) AS cat, instr(c_name, '#') AS at,
lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, ' ') AS rp, left(c_name, 3) AS lf, right(c_name, 3) AS rt FROM customer""")
def fn_string(spark, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return _t(spark, d, "customer").select(
        "c_custkey", call("ToUpper", n).alias("up"), call("ToLower", n).alias("low"), call("Substring", n, 3, 4).alias("sub"), call("Length", n).alias("len"),
        call("Trim", call("Concat", " ", n, " ")).alias("tr"), call("Replace", n, "0", "x").alias("rep"), call("Contains", n, "1").alias("has"), call("StartsWith", n, "C").alias("st"),
        call("EndsWith", n, "5").alias("en"), call("Split", n, "#")[0].alias("part"), call("Concat", n, "-", m).alias("cat"), call("IndexOf", n, "#").alias("at"),
        call("PadLeft", m, 12, "*").alias("lp"), call("PadRight", m, 12).alias("rp"), call("Left", n, 3).alias("lf"), call("Right", n, 3).alias("rt"),
    )


@query("""SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(sqrt(abs(c_acctbal)), 6) AS s, round(power(c_acctbal / 1000, 2), 6) AS p, CAST(sign(c_acctbal) AS DOUBLE) AS g,
round(exp(c_acctbal / 10000), 6) AS e, round(sin(c_acctbal), 6) AS si, round(cos(c_acctbal), 6) AS co, round(tan(c_acctbal / 10000), 6) AS ta, round(c_acctbal / 3 - 1, 6) AS di, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log10(abs(c_acctbal) + 1), 6) AS lt, round(ln(abs(c_acctbal) + 1) / ln(2), 6) AS lb, c_custkey % 7 AS m FROM customer""")
def fn_math(spark, d):
    x, p = F.col("c_acctbal"), F.abs("c_acctbal") + 1
    r = lambda c, n: F.round(c, 6).alias(n)
    return _t(spark, d, "customer").select(
        "c_custkey", call("Abs", x).alias("a"), call("Round", x, 1).alias("r"), call("Floor", x).alias("f"), call("Ceiling", x).alias("c"), r(call("Sqrt", F.abs(x)), "s"), r(call("Power", x / 1000, 2), "p"),
        call("Sign", x).alias("g"), r(call("Exp", x / 10000), "e"), r(call("Sin", x), "si"), r(call("Cos", x), "co"), r(call("Tan", x / 10000), "ta"), r(x / 3 - 1, "di"), r(call("Log", p), "l"), r(call("Log10", p), "lt"), r(call("Log", p, 2), "lb"), (F.col("c_custkey") % 7).alias("m"),
    )


@query("""SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CAST(second(ts) AS BIGINT) AS s, ts + INTERVAL 3 DAY AS d3, ts + INTERVAL 5 HOUR AS h5, ts + INTERVAL 7 MINUTE AS m7, ts + INTERVAL 9 SECOND AS s9, ts + INTERVAL 250 MILLISECOND AS ms,
dayofweek(ts) + 1 AS dw, dayofyear(ts) AS dy, weekofyear(ts) AS w, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS f FROM events""")
def fn_date(spark, d):
    t = F.col("ts")
    return _t(spark, d, "events").select(
        "event_id", *[call(f, t).cast("long").alias(n) for f, n in (("Year", "y"), ("Month", "mo"), ("Day", "d"), ("Hour", "h"), ("Minute", "mi"), ("Second", "s"))], call("AddDays", t, 3).alias("d3"), call("AddHours", t, 5).alias("h5"), call("AddMinutes", t, 7).alias("m7"),
        call("AddSeconds", t, 9).alias("s9"), call("AddMilliseconds", t, 250).alias("ms"), *[call(f, t).cast("long").alias(n) for f, n in (("DayOfWeek", "dw"), ("DayOfYear", "dy"), ("WeekOfYear", "w"))], call("FormatTimestamp", t).alias("f"),
    )


@query("""SELECT vec_id, len(embedding) AS n, list_contains(embedding, embedding[3]) AS has, array_to_string(list_transform(embedding[2:4], lambda x: CAST(CAST(round(x * 1000) AS INTEGER) AS VARCHAR)), ',') AS s, len(list_distinct(embedding)) AS ds,
round(list_max(embedding), 5) AS mx, round(list_min(embedding), 5) AS mn, round(list_sort(embedding)[1], 5) AS so, label FROM embeddings""")
def fn_array(spark, d):
    e = F.col("embedding")
    # in single precision, as in SQL: Spark would widen a float times an integer to double
    s = F.transform(call("ArraySlice", e, 2, 4), lambda x: F.round(x * F.lit(1000).cast("float")).cast("int").cast("string"))
    return _t(spark, d, "embeddings").select(
        "vec_id", call("ArrayLength", e).alias("n"), call("ArrayContains", e, F.get(e, 2)).alias("has"), call("ArrayJoin", s, ",").alias("s"), call("ArrayLength", call("ArrayDistinct", F.array_compact(e))).alias("ds"),
        F.round(call("ArrayMax", e), 5).alias("mx"), F.round(call("ArrayMin", e), 5).alias("mn"), F.round(F.get(call("ArraySort", e), 0), 5).alias("so"), "label",
    )


@query("""WITH a AS (SELECT n_nationkey AS k, [n_nationkey, n_regionkey, 3] AS x, [n_regionkey, 3, 9] AS y FROM nation)
SELECT k, array_to_string(list_sort(list_distinct(list_filter(x, lambda e: NOT list_contains(y, e)))), ',') AS ex, array_to_string(list_sort(list_intersect(x, y)), ',') AS isct, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS un FROM a""")
def fn_array_sets(spark, d):
    x, y = F.array("n_nationkey", "n_regionkey", F.lit(3)), F.array("n_regionkey", F.lit(3), F.lit(9))
    show = lambda f, n: F.array_join(call("ArraySort", call(f, x, y)).cast("array<string>"), ",").alias(n)
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), show("ArrayExcept", "ex"), show("ArrayIntersect", "isct"), show("ArrayUnion", "un"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 3 AS n, 'k' AS keys, TRUE AS has, '{"k":"' || json_extract_string(props, '$.k') || '","z":"1"}' AS both, json_extract_string(props, '$.k') AS rec FROM events""")
def fn_json(spark, d):
    p = F.col("props")
    return _t(spark, d, "events").select(
        "event_id", call("JsonExtractString", p, "$.k").alias("k"), call("JsonArrayLength", F.lit("[1,2,3]")).alias("n"), F.array_join(call("JsonKeys", p), ",").alias("keys"), call("JsonArrayContains", F.lit('["a","b"]'), "a").alias("has"),
        call("JsonConcat", p, F.lit('{"z": "1"}')).alias("both"), call("JsonRecords", p)["k"].alias("rec"),
    )


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS s, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS i, TRY_CAST(event_type AS INTEGER) AS bad, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS dbl, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS dc, TRY_CAST('true' AS BOOLEAN) AS b, CAST(user_id AS BIGINT) AS l FROM events""")
def fn_cast(spark, d):
    k = call("JsonExtractString", F.col("props"), "$.k")
    return _t(spark, d, "events").select(
        "event_id", call("ToString", F.col("user_id")).alias("s"), call("ToInt", k).alias("i"), call("Parse", F.col("event_type"), "int").alias("bad"), call("ToDouble", k).alias("dbl"), call("ToDecimal", F.col("value")).cast("double").alias("dc"),
        call("ToBoolean", F.lit("true")).alias("b"), call("ToLong", F.col("user_id")).alias("l"),
    )


@query("""SELECT event_id, CASE WHEN value > 50 THEN 1 WHEN value > 20 THEN 2 ELSE 3 END AS c, coalesce(nullif(event_type, 'click'), 'none') AS co, ifnull(nullif(event_type, 'error'), 'e') AS i FROM events""")
def fn_cond(spark, d):
    v, e = F.col("value"), F.col("event_type")
    return _t(spark, d, "events").select("event_id", call("Case", v > 50, 1, v > 20, 2, F.lit(3)).alias("c"), call("Coalesce", call("NullIf", e, "click"), "none").alias("co"), call("IfNull", call("NullIf", e, "error"), "e").alias("i"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS q, regexp_extract(url, '^([a-z]+):', 1) AS proto FROM pages""")
def fn_url(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", *[call(f"UrlExtract{f}", u).alias(n) for f, n in (("Host", "host"), ("Path", "path"), ("Query", "q"), ("Protocol", "proto"))])


@query("SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer")
def fn_hash(spark, d):
    n = F.col("c_name")
    return _t(spark, d, "customer").select("c_custkey", call("Md5", n).alias("m"), call("Sha1", n).alias("s1"), call("Sha256", n).alias("s2"))


@query("""WITH g AS (SELECT n_nationkey AS k, n_nationkey * 3.0 - 30 AS lat, n_regionkey * 40.0 - 90 AS lon FROM nation)
SELECT k, round(2 * 6371.0 * asin(sqrt(power(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * power(sin(radians(20 - lon) / 2), 2))), 4) AS km, '{"type":"Point","coordinates":[' || CAST(CAST(lon AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(lat AS DOUBLE) AS VARCHAR) || ']}' AS geo FROM g""")
def fn_geo(spark, d):
    g = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 3.0 - 30).alias("lat"), (F.col("n_regionkey") * 40.0 - 90).alias("lon"))
    return g.select("k", F.round(call("GeoDistance", F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 4).alias("km"), call("AsGeoJson", F.col("lat"), F.col("lon")).alias("geo"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi, round(avg(value), 1) AS ra FROM events GROUP BY 1")
def agg_basic(spark, d):
    r = lambda n, a: A.expr(lambda x: F.round(x, n), a)
    return A.aggregate(_t(spark, d, "events"), ["event_type"], {"n": A.count(), "s": r(2, A.sum_("value")), "a": r(6, A.avg("value")), "lo": A.min_("value"), "hi": A.max_("value"), "ra": r(1, A.avg("value"))})


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def agg_earliest_latest(spark, d):
    return A.aggregate(_t(spark, d, "events"), ["user_id"], {"first_value": A.earliest("value", "ts", "event_id"), "last_value": A.latest("value", "ts", "event_id")})


@query("SELECT user_id, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY ts, event_id), ',') AS l, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS s FROM events GROUP BY 1")
def agg_collect(spark, d):
    join = lambda a: A.expr(lambda x: F.array_join(x.cast("array<string>"), ","), a)
    return A.aggregate(_t(spark, d, "events"), ["user_id"], {"l": join(A.collect_list("event_id", "ts", "event_id")), "s": join(A.collect_set("event_type"))})


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_count_distinct(spark, d):
    return A.aggregate(_t(spark, d, "events"), ["event_type"], {"users": A.count_distinct("user_id")})


@query("SELECT user_id, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2")
def agg_histogram(spark, d):
    return A.histogram(_t(spark, d, "events"), ["user_id"], "event_type").select("user_id", F.explode("histogram").alias("v", "n"))


@query("SELECT event_type, array_to_string(list_transform(list_reverse_sort(list(value))[1:5], lambda x: printf('%.2f', x)), ',') AS top FROM events GROUP BY 1")
def agg_topk(spark, d):
    top = A.top_rows(_t(spark, d, "events"), ["event_type"], "value", 5)
    return top.withColumn("top", F.array_join(F.transform("top", lambda x: F.format_string("%.2f", x)), ","))


@query("SELECT event_type, array_to_string(list_transform(list_reverse_sort(list(DISTINCT user_id))[1:4], lambda x: CAST(x AS VARCHAR)), ',') AS top FROM events GROUP BY 1")
def agg_topk_distinct(spark, d):
    top = A.top_rows(_t(spark, d, "events"), ["event_type"], "user_id", 4, distinct=True)
    return top.withColumn("top", F.array_join(F.col("top").cast("array<string>"), ","))


@query("SELECT event_type, date_trunc('day', ts) AS bucket, array_to_string(list_transform(list_reverse_sort(list(value))[1:3], lambda x: printf('%.2f', x)), ',') AS top, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def bars_merged_sets(spark, d):
    text = lambda a: F.array_join(F.transform(a, lambda x: F.format_string("%.2f", x)), ",")
    aggs = {"top": A.expr(text, A.top_k("value", 3)), "users": A.count_distinct("user_id")}
    return bars.cascade(_t(spark, d, "events"), ["event_type"], "ts", aggs, [Frame.of("1h"), Frame.of("1d")])["1d"]


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_inner(spark, d):
    q = Query.from_(ORDERS).join(CUSTOMER, [("o_custkey", "c_custkey")]).where(F.col("o_totalprice") > 100000)
    return q.select(o_orderkey="o_orderkey", c_name="c_name", o_totalprice="o_totalprice").to_df({"orders": _t(spark, d, "orders"), "customer": _t(spark, d, "customer")})


@query("SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def join_left(spark, d):
    return joins.join(_t(spark, d, "customer"), _t(spark, d, "orders").where("o_totalprice > 400000"), [("c_custkey", "o_custkey")], "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1).cast("long")).alias("o_orderkey"))


@query("SELECT event_id, n FROM events JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) USING (user_id, event_type)")
def join_composite(spark, d):
    e = _t(spark, d, "events")
    b = A.aggregate(e, [F.col("user_id").alias("u2"), F.col("event_type").alias("t2")], {"n": A.count()})
    return joins.join(e, b, [("user_id", "u2"), ("event_type", "t2")]).select("event_id", "n")


@query("SELECT a.event_id AS click_id, b.event_id AS error_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 300 SECOND AND a.ts + INTERVAL 300 SECOND WHERE a.event_type = 'click' AND b.event_type <> 'click'")
def join_within_300s(spark, d):
    e = _t(spark, d, "events")
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts")
    b = e.where("event_type <> 'click'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("u2"), F.col("ts").alias("ts2"))
    return joins.join_within(a, b, [("user_id", "u2")], "ts", "ts2").select("click_id", "error_id")


@query("SELECT event_id, c_name, value FROM events JOIN customer ON user_id = c_custkey")
def join_stream_table(spark, d):
    q = Query.from_(TICKS).join(CUSTOMER, [("user_id", "c_custkey")]).select(event_id="event_id", c_name="c_name", value="value")
    return q.to_df({"events": _t(spark, d, "events"), "customer": _t(spark, d, "customer")})


def _tumbling(token: str, bucket: str, keys: tuple[str, ...]):
    def run(spark, d):
        return bars.cascade(_t(spark, d, "events"), list(keys), "ts", _ohlc(), [Frame.of(token)])[token]

    run.__name__ = f"tumbling_{token}"
    query(f"SELECT {', '.join(keys)}, {bucket} AS bucket, {_OHLC} FROM events GROUP BY ALL")(run)


for _f, _b in (("1m", "time_bucket(INTERVAL 1 MINUTE, ts)"), ("5m", "time_bucket(INTERVAL 5 MINUTE, ts)"), ("15m", "time_bucket(INTERVAL 15 MINUTE, ts)")):
    _tumbling(_f, _b, ("user_id",))
for _f, _b in (("1h", "date_trunc('hour', ts)"), ("1d", "CAST(date_trunc('day', ts) AS TIMESTAMP)"), ("1wk", "CAST(date_trunc('week', ts) AS TIMESTAMP)"), ("1mo", "CAST(date_trunc('month', ts) AS TIMESTAMP)")):
    _tumbling(_f, _b, ("event_type",))


def _hop(q: Query) -> Query:
    return q.hopping("ts", "5m", "1m")


_HOP = """WITH h AS (SELECT e.*, unnest(generate_series(date_trunc('minute', ts) - INTERVAL 4 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS window_start FROM events e)"""


@query(f"{_HOP} SELECT user_id, window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS n, round(sum(value), 2) AS s, max(value) AS hi FROM h GROUP BY ALL")
def hopping_5m_1m(spark, d):
    q = _hop(Query.from_(_t(spark, d, "events")).group_by("user_id"))
    return q.select(user_id="user_id", window_start="window_start", window_end="window_end", n=A.count(), s=A.expr(lambda x: F.round(x, 2), A.sum_("value")), hi=A.max_("value")).to_df()


@query(f"{_HOP} SELECT c_mktsegment, window_start, count(*) AS n FROM h JOIN customer ON user_id = c_custkey GROUP BY ALL HAVING count(*) > 1")
def hopping_join_table(spark, d):
    q = _hop(Query.from_(TICKS).join(CUSTOMER, [("user_id", "c_custkey")]).group_by("c_mktsegment")).having(F.col("n") > 1)
    return q.select(c_mktsegment="c_mktsegment", window_start="window_start", n=A.count()).to_df({"events": _t(spark, d, "events"), "customer": _t(spark, d, "customer")})


@query(f"{_HOP} SELECT user_id, window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS n FROM h WHERE user_id = 8 AND window_start >= TIMESTAMP '2024-01-02' AND window_start + INTERVAL 5 MINUTE <= TIMESTAMP '2024-01-09' GROUP BY ALL")
def hopping_read(spark, d):
    c = StreamContext(spark)
    c.frames["h"] = _hop(Query.from_(_t(spark, d, "events")).group_by("user_id")).select(user_id="user_id", window_start="window_start", window_end="window_end", n=A.count()).to_df()
    return c.read_hopping("h", {"user_id": 8}, "2024-01-02", "2024-01-09")


@query(f"SELECT event_type, date_trunc('second', ts) AS bucket, {_OHLC} FROM events GROUP BY ALL")
def bars_hub_1s(spark, d):
    aggs = _ohlc()
    return bars.hub(_t(spark, d, "events"), ["event_type"], "ts", aggs).select("event_type", "bucket", *A.final(aggs))


@query(f"SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, {_OHLC} FROM events GROUP BY ALL")
def bars_cascade(spark, d):
    q = Query.from_(_t(spark, d, "events")).group_by("event_type").tumbling("ts", minutes=[1, 5], hours=[1, 6])
    return q.select(**_ohlc()).to_frames()["6h"]


@query(f"SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, {_OHLC} FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) > 1")
def bars_having(spark, d):
    q = Query.from_(_t(spark, d, "events")).where(F.col("event_type") == "click").group_by("user_id").having(F.col("cnt") > 1).tumbling("ts", days=[1])
    return q.select(**_ohlc()).to_df()


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def rows_last(spark, d):
    return bars.rows_last(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("""WITH b AS (SELECT event_type, date_trunc('hour', ts) AS bucket, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM b GROUP BY 1),
f AS (SELECT g.event_type, g.bucket, open, high, low, last_value(close IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.bucket) AS close, b.bucket IS NULL AS filled FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.bucket = b.bucket)
SELECT event_type, bucket, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, filled FROM f""")
def gap_fill_1h(spark, d):
    aggs = {k: v for k, v in _ohlc().items() if k in ("open", "high", "low", "close")}
    made = bars.cascade(_t(spark, d, "events"), ["event_type"], "ts", aggs, [Frame.of("1h")])["1h"]
    return bars.fill_gaps(made, ["event_type"], Frame.of("1h"))


_SCHEDULE = "(SELECT u AS k, CAST(t AS TIMESTAMP) + INTERVAL 9 HOUR AS open_at, CAST(t AS TIMESTAMP) + INTERVAL 17 HOUR AS close_at FROM (SELECT unnest(['click', 'error']) AS u), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-06-30', INTERVAL 1 DAY)) AS t) WHERE dayofweek(t) BETWEEN 1 AND 5)"


@query(f"SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS cnt, max(value) AS high FROM events JOIN {_SCHEDULE} ON event_type = k AND open_at <= ts AND ts < close_at GROUP BY 1, 2")
def session_bars(spark, d):
    days = spark.sql("SELECT explode(array('click', 'error')) AS k, t FROM (SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-06-30', interval 1 day)) AS t) WHERE weekday(t) < 5")
    schedule = days.select("k", add("t", Frame.of("9h")).alias("open_at"), add("t", Frame.of("17h")).alias("close_at"))
    q = Query.from_(_t(spark, d, "events")).time_frame(schedule, [("event_type", "k")], "open_at", "close_at").group_by("event_type").tumbling("ts", hours=[1])
    return q.select(cnt=A.count(), high=A.max_("value")).to_df()


@query("""WITH b AS (SELECT user_id AS k, date_trunc('day', ts) AS t, arg_max(value, (ts, event_id)) AS close, max(value) AS bid, min(value) AS ask FROM events GROUP BY 1, 2),
p AS (SELECT k, CAST(t AS TIMESTAMP) AS bucket, lag(close, 1, 0) OVER (PARTITION BY k ORDER BY t) AS previous_close, bid, ask FROM b) SELECT k, bucket, previous_close, CASE WHEN previous_close = 0 THEN 0 ELSE round(((bid + ask) / 2 - previous_close) / previous_close, 6) END AS change FROM p""")
def prev_close_change(spark, d):
    daily = bars.cascade(_t(spark, d, "events"), ["user_id"], "ts", {"close": A.latest("value", "ts", "event_id"), "bid": A.max_("value"), "ask": A.min_("value")}, [Frame.of("1d")])["1d"]
    out = bars.previous_change(daily, ["user_id"], "bucket", "bid", "ask", "close")
    return out.select(F.col("user_id").alias("k"), "bucket", "previous_close", F.round("change", 6).alias("change"))


@query("SELECT user_id, date_trunc('minute', ts) AS m, count(DISTINCT ts) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY 1, 2")
def dedup_in_window(spark, d):
    e = _t(spark, d, "events")
    both = e.unionByName(e.where("event_id % 3 = 0"))
    return bars.dedup_in_window(both, ["user_id"], "ts").groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("m")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT *, (event_id * 7919) % 10007 AS arrival FROM events), s AS (SELECT *, max(date_trunc('second', ts)) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a) SELECT event_id, user_id FROM s WHERE seen IS NULL OR date_trunc('second', ts) >= seen")
def monotonic_guard(spark, d):
    e = _t(spark, d, "events").withColumn("arrival", F.struct((F.col("event_id") * 7919 % 10007).alias("a"), "event_id"))
    return bars.monotonic_guard(e, ["user_id"], "ts", "arrival").select("event_id", "user_id")


@query("""WITH e AS (SELECT 'events' AS topic, CAST(user_id AS INTEGER) AS partition, event_id AS "offset", ts AS timestamp, event_type AS error_type, props AS m FROM events WHERE event_type IN ('error', 'click')),
r AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('second', timestamp) ORDER BY topic, partition, "offset") AS n FROM e) SELECT topic, partition, "offset", timestamp, error_type, m AS error_message, 'at x y' AS stack_trace, upper(sha256(m || chr(10) || 'at x y')) AS fingerprint FROM r WHERE n <= 1""")
def dlq_gate(spark, d):
    e = _t(spark, d, "events").select(F.lit("events").alias("topic"), F.col("user_id").cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"), F.col("event_type").alias("error_type"), F.col("props").alias("message"), F.lit("at  x\n y").alias("stack"))
    return envelope(gate(e, DlqOptions(include=("error", "click")), "error_type", "timestamp", ("topic", "partition", "offset")))


@query(f"SELECT user_id, bucket, open, close FROM (SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, {_OHLC} FROM events WHERE user_id = 8 GROUP BY ALL) WHERE bucket BETWEEN TIMESTAMP '2024-01-01 00:00:00' - INTERVAL 2 SECOND AND TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 2 SECOND")
def bucket_read(spark, d):
    c = StreamContext(spark)
    q = Query.from_(_t(spark, d, "events")).group_by("user_id").tumbling("ts", minutes=[5]).select(**_ohlc())
    c.define_bars("tick", q)
    return c.read_bars("tick", "5m", {"user_id": 8}, "2024-01-01 00:00:00").select("user_id", "bucket", "open", "close")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def tombstones(spark, d):
    from rillstone.sources.io import remove

    return remove(_t(spark, d, "customer"), _t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT event_id, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS q, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS qt, ts + INTERVAL 1 MONTH AS next FROM events")
def period_math(spark, d):
    return _t(spark, d, "events").select("event_id", floor("ts", Frame.of("15m")).alias("q"), floor("ts", Frame.of("1wk")).alias("w"), floor("ts", Frame.of("3mo")).cast("timestamp_ntz").alias("qt"), add("ts", Frame.of("1mo")).alias("next"))




@query(f"""WITH h AS (SELECT event_type, '1m' AS frame, time_bucket(INTERVAL 1 MINUTE, ts) AS bucket, {_OHLC} FROM events GROUP BY ALL UNION ALL SELECT event_type, '5m', time_bucket(INTERVAL 5 MINUTE, ts), {_OHLC} FROM events GROUP BY ALL
UNION ALL SELECT event_type, '1h', date_trunc('hour', ts), {_OHLC} FROM events GROUP BY ALL UNION ALL SELECT event_type, '6h', time_bucket(INTERVAL 6 HOUR, ts), {_OHLC} FROM events GROUP BY ALL
UNION ALL SELECT event_type, '1wk', CAST(date_trunc('week', ts) AS TIMESTAMP), {_OHLC} FROM events GROUP BY ALL) SELECT * FROM h""")
def bars_every_frame(spark, d):
    q = Query.from_(_t(spark, d, "events")).group_by("event_type").tumbling("ts", minutes=[1, 5], hours=[1, 6], weeks=[1])
    out = None
    for frame, bar in q.select(**_ohlc()).to_frames().items():
        bar = bar.withColumn("frame", F.lit(frame))
        out = bar if out is None else out.unionByName(bar)
    return out


@query("""SELECT event_id, nullif(event_type, 'click') AS kind, value > 50 AS large FROM events WHERE (nullif(event_type, 'click') IS NULL OR value > 90) AND (value > 50 OR nullif(event_type, 'view') IS NULL)""")
def predicates_with_nulls(spark, d):
    e = _t(spark, d, "events").withColumns({"kind": call("NullIf", F.col("event_type"), "click"), "large": F.col("value") > 50})
    q = Query.from_(e).where(F.col("kind").isNull() | (F.col("value") > 90)).where(F.col("large") | call("NullIf", F.col("event_type"), "view").isNull())
    return q.select(event_id="event_id", kind="kind", large="large").to_df()


@query("SELECT c_custkey, substring(c_name, 4) AS s2, CASE WHEN length(c_mktsegment) < 40 THEN c_mktsegment END AS r40, TRY_CAST(c_mktsegment AS INTEGER) AS bad, TRY_CAST(right(c_name, 3) AS INTEGER) AS num, CAST(c_custkey AS INTEGER) AS i32, CAST(c_custkey AS BIGINT) AS i64, CAST(c_custkey AS DOUBLE) AS dbl FROM customer")
def fn_convert(spark, d):
    n, m, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    return _t(spark, d, "customer").select(
        "c_custkey", call("Substring", n, 4).alias("s2"), call("Right", m, 40).alias("r40"), call("Convert", m, "int").alias("bad"), call("Convert", call("Right", n, 3), "int").alias("num"),
        call("ToInt32", k).alias("i32"), call("ToInt64", k).alias("i64"), call("ToDouble", k).alias("dbl"),
    )


@query("""SELECT event_id, json_array_length('[' || repeat('1,', CAST(event_id % 4 AS INTEGER)) || '2]') AS n, array_to_string(json_keys('{"' || event_type || '": 1, "z": 2}'), ',') AS k, event_type = 'click' AS has, event_type IN ('click', 'view') AS listed FROM events""")
def fn_json_columns(spark, d):
    t = F.col("event_type")
    many = F.concat(F.lit("["), F.repeat(F.lit("1,"), (F.col("event_id") % 4).cast("int")), F.lit("2]"))
    keyed = F.concat(F.lit('{"'), t, F.lit('": 1, "z": 2}'))
    return _t(spark, d, "events").select(
        "event_id", call("JsonArrayLength", many).alias("n"), F.array_join(call("JsonKeys", keyed), ",").alias("k"),
        call("JsonArrayContains", F.concat(F.lit('["'), t, F.lit('"]')), "click").alias("has"), call("ArrayContains", F.array(F.lit("click"), F.lit("view")), t).alias("listed"),
    )


@query("SELECT user_id, event_id, ts AS t FROM events ORDER BY year(ts), month(ts), value / 2 DESC, event_id LIMIT 50")
def order_by_functions(spark, d):
    q = Query.from_(_t(spark, d, "events").withColumn("k", call("RowKey", F.col("user_id"), F.col("event_id"))))
    q = q.order_by(call("Year", F.col("ts")), call("Month", F.col("ts"))).order_by((F.col("value") / 2).desc(), "event_id").limit(50)
    return q.to_df().select("k.user_id", "k.event_id", call("RowTime", "ts").alias("t"))


@query("SELECT c_nationkey + 1 AS n1, c_acctbal > 0 AS rich, count(*) AS n FROM customer GROUP BY 1, 2")
def group_by_arithmetic(spark, d):
    keys = [(F.col("c_nationkey") + 1).alias("n1"), (F.col("c_acctbal") > 0).alias("rich")]
    return Query.from_(_t(spark, d, "customer")).group_by(*keys).where(F.col("n") > 0).select(n1="n1", rich="rich", n=A.count()).to_df()


_RICH = "(SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000)"


@query(f"SELECT o_orderkey, coalesce(c_name, '-') AS c_name FROM {_RICH} RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(spark, d):
    rich = _t(spark, d, "customer").where("c_acctbal > 5000")
    q = Query.from_(rich).join(_t(spark, d, "orders"), [("c_custkey", "o_custkey")], "right")
    return q.select(o_orderkey="o_orderkey", c_name=call("Coalesce", F.col("c_name"), "-")).to_df()


@query(f"SELECT coalesce(o_orderkey, -1) AS o_orderkey, coalesce(c_name, '-') AS c_name FROM {_RICH} FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def join_full(spark, d):
    rich, large = _t(spark, d, "customer").where("c_acctbal > 5000"), _t(spark, d, "orders").where("o_totalprice > 300000")
    q = Query.from_(rich).join(large, [("c_custkey", "o_custkey")], "full")
    return q.select(o_orderkey=call("Coalesce", F.col("o_orderkey"), F.lit(-1).cast("long")), c_name=call("Coalesce", F.col("c_name"), "-")).to_df()


@query("SELECT a.event_id AS e, o_orderkey FROM events a JOIN orders ON user_id = o_custkey AND ts BETWEEN o_orderdate - INTERVAL 86400 SECOND AND o_orderdate + INTERVAL 86400 SECOND")
def join_within_builder(spark, d):
    q = Query.from_(TICKS).join(ORDERS, [("user_id", "o_custkey")]).within(86400).require_explicit_within()
    return q.select(e="event_id", o_orderkey="o_orderkey").to_df({"events": _t(spark, d, "events"), "orders": _t(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))})


@query(f"SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS cnt FROM events JOIN {_SCHEDULE} ON event_type = k AND open_at < ts AND ts <= close_at GROUP BY 1, 2")
def session_bars_bounds(spark, d):
    days = spark.sql("SELECT explode(array('click', 'error')) AS k, t FROM (SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-06-30', interval 1 day)) AS t) WHERE weekday(t) < 5")
    schedule = days.select("k", add("t", Frame.of("9h")).alias("open_at"), add("t", Frame.of("17h")).alias("close_at"))
    q = Query.from_(_t(spark, d, "events")).time_frame(schedule, [("event_type", "k")], "open_at", "close_at", open_inclusive=False, close_inclusive=True)
    return q.group_by("event_type").tumbling("ts", hours=[1]).select(cnt=A.count()).to_df()
