import datetime as dt

from spillway.operators import grouping as g


def test_rows_of_keyed_sessions_are_those_of_the_aggregate(spark):
    start = dt.datetime(2024, 3, 1)
    rows = [(k % 5 or None, start + dt.timedelta(minutes=(k * k * 7) % 900), k) for k in range(200)] + [(1, None, 999)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v int")
    span = g.Span("session", "ts", "9 minutes")
    out = g.sessions(df, span, ["k"])
    assert out.count() == 200 and out.columns == ["k", "ts", "v", g.START, g.END]
    counted = out.groupBy("k", g.START, g.END).agg({"v": "count"}).collect()
    assert sorted(map(str, map(tuple, counted))) == sorted(map(str, map(tuple, g.aggregate(df.where("ts is not null"), ["k"], {"n": "count(v)"}, span).collect())))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
