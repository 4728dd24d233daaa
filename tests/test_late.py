"""Windows that take rows after their end: results, corrections and rows that are too late."""

import datetime as dt
import random
from collections import Counter

import pytest

import spillway as sp
from spillway.operators import grouping as g
from spillway.plans import nodes as n
from spillway.schema import Field, Schema, Watermark
from spillway.streaming import late

from .test_streaming import Feed, at, play

COLUMNS = "k string, ts timestamp, v double, q bigint"
SELECT = {"rows": "COUNT(*)", "known": "COUNT(v)", "total": "SUM(v)", "lo": "MIN(q)", "hi": "MAX(q * 2)", "mean": "AVG(q)"}


def test_corrections_and_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    df = late.late_aggregate(feed.stream().withWatermark("ts", "30 seconds"), ["k"], g.Span("tumble", "ts", "10 minutes"), {"k": "k", **SELECT}, "20 minutes")
    assert df.columns == ["op", "k", "window_start", "window_end", *SELECT]
    batches = [
        [("x", "07:02", 4.0, 5), ("x", "07:09", None, 1), ("y", "07:01", 1.0, 2)],
        [("x", "07:15", 1.5, 3)],  # 07:10 has passed
        [("x", "07:04", 2.0, None), ("y", "07:16", 0.0, 0)],  # corrects the first window of x
        [("x", "08:30", 0.0, 0)],
        [("x", "07:05", 9.0, 9), ("y", "08:31", 0.0, 0)],  # after all lateness
    ]
    out = [r for got in play(spark, feed, df, batches, "update", tmp_path) for r in got]
    first = [(r[0], *r[4:]) for r in out if r[1] == "x" and r[2] == at("07:00")]
    assert first == [("+", 2, 1, 4.0, 1, 10, 3.0), ("-", 2, 1, 4.0, 1, 10, 3.0), ("+", 3, 2, 6.0, 1, 10, 3.0), ("late", 1, 1, 9.0, 9, 18, 9.0)]
    assert [(r[0], *r[4:]) for r in out if r[1] == "y" and r[2] == at("07:00")] == [("+", 1, 1, 1.0, 2, 4, 2.0)]


def net(rows):
    """Results that hold in the end."""
    left = Counter()
    for op, *rest in rows:
        left[tuple(rest)] += {"+": 1, "-": -1}[op]
    assert set(left.values()) <= {0, 1}
    return sorted((r for r, many in left.items() if many), key=str)


@pytest.mark.parametrize("span", [g.Span("tumble", "ts", "7 minutes"), g.Span("slide", "ts", "10 minutes", "4 minutes"), g.Span("session", "ts", "5 minutes")], ids=["tumble", "slide", "session"])
def test_what_is_left_is_the_batch(spark, tmp_path, span):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), at("10:00") + dt.timedelta(seconds=rng.randrange(7200)), float(rng.randrange(9)), rng.randrange(99)) for _ in range(120)]
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    df = late.late_aggregate(feed.stream().withWatermark("ts", "1 minute"), ["k"], span, SELECT, "10 hours")
    # rows come in any order; the last ones push the watermark past every window of theirs
    end = [[("z", "14:00", 0.0, 0)], [("z", "14:01", 0.0, 0)]]
    out = [r for got in play(spark, feed, df, [rows[:50], rows[50:90], rows[90:], *end], "update", tmp_path) for r in got]
    want = g.aggregate(spark.createDataFrame(rows, COLUMNS), ["k"], SELECT, span).collect()
    assert net(r for r in out if r[1] != "z") == sorted(map(tuple, want), key=str) and any(r[0] == "-" for r in out)


def test_a_pipeline_with_lateness(spark, tmp_path):
    schema = Schema({"k": Field.STRING(), "ts": Field.TIMESTAMP(), "v": Field.DOUBLE(), "q": Field.BIGINT()}, Watermark("ts", "ts - INTERVAL '1' MINUTE"))
    spark.createDataFrame([("a", at("10:01"), 1.0, 1), ("a", at("10:02"), 2.0, 2), ("a", at("12:00"), 0.0, 0)], COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = n.FileSource(path=str(tmp_path / "in"), schema=schema)
    sums = source.tumble("5 minutes", "ts", allowed_lateness="1 hour").filter("v >= 0").aggregate(["k"], {"total": "SUM(v)"})
    out = sums.filter("op <> 'late'").to(n.MemorySink(name="late_sums"))
    sp.run_streams(spark, sp.Pipeline("late_sums", (out,), output_mode="update"), every="available-now")
    assert [(r["op"], r["k"], r["total"]) for r in spark.table("late_sums").collect()] == [("+", "a", 3.0)]
    with pytest.raises(ValueError, match="lateness"):
        late.late_aggregate(spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in")), ["k"], g.Span("tumble", "ts", "1 minute"), {"x": "STDDEV(v)"}, "1 hour")
