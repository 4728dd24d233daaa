import datetime as dt

import pytest
from pyspark.sql import functions as F

from spillway.operators import grouping as g
from spillway.operators import joins as j
from spillway.schema import Field, Schema, SchemaError, Watermark, duration_ms


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-01 {text}")


def stamped(spark, times, **more):
    return spark.createDataFrame([(k, at(t), *more.get("extra", [()] * 99)[k]) for k, t in enumerate(times)], "id int, ts timestamp_ntz" + more.get("columns", ""))


def bounds(df):
    return sorted((r["window_start"].strftime("%H:%M"), r["window_end"].strftime("%H:%M")) for r in df.collect())


# The times and bounds of windows and joins below are the scenarios that the semantics are stated by.


def test_tumble_and_slide(spark):
    one = stamped(spark, ["12:03:27"])
    assert bounds(g.bounded(one, g.Span("tumble", "ts", "5 MINUTE"))) == [("12:00", "12:05")]
    assert bounds(g.bounded(stamped(spark, ["12:07:00"]), g.Span("slide", "ts", "10 MINUTE", "5 MINUTE"))) == [("12:00", "12:10"), ("12:05", "12:15")]
    edge = g.aggregate(stamped(spark, ["12:04:59", "12:05:00"]), [], {"n": "count(*)"}, g.Span("tumble", "ts", "5 minutes"))
    assert bounds(edge) == [("12:00", "12:05"), ("12:05", "12:10")]
    with pytest.raises(ValueError):
        g.Span("hop", "ts", "1 minute")


def test_session(spark):
    rows = stamped(spark, ["10:00", "10:02", "10:04", "10:30", "10:31"])
    assert bounds(g.aggregate(rows, [], {"n": "count(*)"}, g.Span("session", "ts", "15 minutes"))) == [("10:00", "10:19"), ("10:30", "10:46")]
    assert bounds(g.bounded(rows, g.Span("session", "ts", "15 minutes"))) == [("10:00", "10:19")] * 3 + [("10:30", "10:46")] * 2
    bridged = stamped(spark, ["10:00", "10:20", "10:12"])
    assert bounds(g.aggregate(bridged, [], {"n": "count(*)"}, g.Span("session", "ts", "15 minutes"))) == [("10:00", "10:35")]
    # a gap that is exactly reached still holds a session together
    assert len(bounds(g.aggregate(stamped(spark, ["10:00", "10:15"]), [], {"n": "count(*)"}, g.Span("session", "ts", "15 minutes")))) == 1


def test_aggregate_keys_first(spark):
    df = spark.createDataFrame([(2, "tide", 0.5), (1, "wind", 4.0), (2, "wind", None), (1, "wind", 1.5), (2, "tide", 2.5), (None, "sun", 9.0)], "site int, source string, mwh double")
    out = g.aggregate(df, ["site", "source"], {"hours": "COUNT(mwh)", "source": "source", "best": "MAX(mwh)"})
    assert out.columns == ["site", "source", "hours", "best"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "wind", 2, 4.0), (2, "tide", 2, 2.5), (2, "wind", 0, None), (None, "sun", 1, 9.0)]
    assert g.aggregate(df, ["source"], {}).count() == 3
    assert g.aggregate(df.limit(0), [], {"n": "count(*)"}).collect() == [(0,)]


def test_deduplicate_and_top(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z"), (None, 1, "n"), ("a", 2, "w")], "k string, t int, v string")
    assert sorted(map(tuple, g.deduplicate(df, ["k"], "t").collect()), key=str) == [("a", 1, "x"), ("b", 5, "z"), (None, 1, "n")]
    assert ("a", 2, "w") in set(map(tuple, g.deduplicate(df, ["k"], "t", "last").collect()))
    assert g.top(df, ["k"], {"t": "DESC", "v": "ASC"}, 1, "rank").where("k = 'a'").collect() == [("a", 2, "w", 1)]
    assert g.top(df, [], {"t": "DESC"}, 1).collect() == [("b", 5, "z")]
    for bad in (lambda: g.deduplicate(df, ["k"], "t", "any"), lambda: g.top(df, ["k"], {"t": "UP"}), lambda: g.top(df, ["k"], {"t": "ASC"}, 0)):
        with pytest.raises(ValueError):
            bad()


def test_top_limits_groups_before_the_shuffle(spark):
    plan = g.top(spark.range(1000).selectExpr("id % 3 AS k", "id"), ["k"], {"id": "ASC"}, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_join_kinds(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "id int, v string")
    counts = {k: j.join(a, b, "l.id = r.id", k).count() for k in j.KINDS}
    assert counts == {"inner": 1, "left": 3, "right": 3, "full": 5, "semi": 1, "anti": 2}
    assert j.join(a, b, "l.id = r.id").collect()[0].asDict() == {"id": 2, "v": "b", "r_id": 2, "r_v": "B"}
    assert j.join(a, b, "x.id < y.id", aliases=("x", "y")).count() == 3
    with pytest.raises(ValueError):
        j.join(a, b, "l.id = r.id", "outer")


def test_interval_join_is_inclusive(spark):
    orders = stamped(spark, ["10:00"])
    pays = stamped(spark, ["09:58:59", "09:59:00", "10:00:00", "10:30:00", "10:30:01"]).withColumnRenamed("ts", "paid")
    for lower, upper in (("-1 MINUTE", "30 MINUTES"), ("l.ts - INTERVAL '1' MINUTE", "l.ts + INTERVAL '30' MINUTE"), (-60_000, 1_800_000)):
        out = j.interval_join(orders, pays, "true", "ts", "paid", lower, upper)
        assert sorted(r["r_id"] for r in out.collect()) == [1, 2, 3]
    assert sorted(r["r_id"] for r in j.interval_join(orders, pays, "true", "ts", "paid", "l.ts", "l.ts + INTERVAL '1' HOUR").collect()) == [2, 3, 4]
    assert j.interval_join(orders, pays, "true", "ts", "paid", 1_900_000, 2_000_000, "left").collect()[0]["r_id"] is None
    with pytest.raises(ValueError):
        j.interval_join(orders, pays, "true", "ts", "paid", 5, 1)


def test_temporal_join(spark):
    facts = spark.createDataFrame([("k", 150), ("k", 250), ("k", 50), ("z", 1), ("k", 200), (None, 5), ("k", 350)], "k string, t int")
    versions = spark.createDataFrame([("k", 100, 40, "INSERT"), ("k", 200, 50, "UPDATE"), ("k", 300, None, "DELETE"), (None, 1, 9, "INSERT")], "k string, v int, price int, op string")
    out = j.temporal_join(facts, versions, ["k"], "t", "v", "left", changelog="op")
    got = {(r["k"], r["t"]): r["price"] for r in out.collect()}
    assert got == {("k", 150): 40, ("k", 250): 50, ("k", 50): None, ("z", 1): None, ("k", 200): 50, (None, 5): None, ("k", 350): None}
    inner = j.temporal_join(facts, versions.drop("op"), {"k": "k"}, "t", "v")
    assert sorted((r["t"], r["v"]) for r in inner.collect()) == [(150, 100), (200, 200), (250, 200), (350, 300)]


def test_windowed_join(spark):
    a = g.bounded(stamped(spark, ["10:01", "10:07"]), g.Span("tumble", "ts", "5 minutes"))
    b = g.bounded(stamped(spark, ["10:04", "10:05"]), g.Span("tumble", "ts", "5 minutes"))
    out = j.windowed_join(a, b, "true")
    assert sorted((r["id"], r["r_id"]) for r in out.collect()) == [(0, 0), (1, 1)] and "r_window_start" not in out.columns
    assert j.windowed_join(a, b.where("id = 0"), "true", "left").count() == 2


def test_lookup_join(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8)], "id int, c int")
    dim = spark.createDataFrame([(7, "x", "y")], "key int, name string, more string")
    out = j.lookup_join(rows, lambda: dim, "l.c = r.key", ["name"])
    assert out.columns == ["id", "c", "name"] and sorted(map(tuple, out.collect())) == [(1, 7, "x"), (2, 8, None)]


def test_schema_rules():
    s = Schema({"ts": Field.TIMESTAMP(3), "n": Field.DECIMAL(10, 2)}, Watermark("ts", "ts - INTERVAL '5' SECOND"), ("n",))
    assert s.watermark.delay == "5 seconds" and s.struct().simpleString() == "struct<ts:timestamp_ntz,n:decimal(10,2)>"
    for bad in (lambda: Schema({}), lambda: Schema({"a": "int"}), lambda: Schema({"a": Field.INT()}, Watermark("b", "b")), lambda: Schema({"a": Field.INT()}, None, ("b",)), lambda: Watermark("ts", "ts + 1").delay):
        with pytest.raises(SchemaError):
            bad()
    assert [duration_ms(x) for x in ("5 MINUTE", "1 hour", "INTERVAL '2' DAYS", "250 milliseconds", 7)] == [300_000, 3_600_000, 172_800_000, 250, 7]
    kinds = [Field.BOOLEAN(), Field.TINYINT(), Field.SMALLINT(), Field.INT(), Field.BIGINT(), Field.FLOAT(), Field.DOUBLE(), Field.STRING(), Field.DATE(), Field.TIME(), Field.BYTES(), Field.TIMESTAMP_LTZ(), Field.VARCHAR(5), Field.CHAR(2), Field.ARRAY(Field.INT()), Field.MAP(Field.STRING(), Field.INT()), Field.ROW({"a": Field.INT()})]
    assert [k.simpleString() for k in kinds] == ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string", "date", "bigint", "binary", "timestamp", "string", "string", "array<int>", "map<string,int>", "struct<a:int>"]


def test_filters_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = g.aggregate(df.where(F.col("l_quantity") > 30), ["l_returnflag"], {"n": "count(*)"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
