"""Stream scenarios: files arrive batch by batch, each read once."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from spillway import suites
from spillway.operators import grouping as g
from spillway.operators import joins as j
from spillway.schema import Field, Schema, Watermark
from spillway.sources import generated
from spillway.streaming import run, state


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-01 {text}")


class Feed:
    """A folder that a stream reads; each call adds one batch."""

    def __init__(self, spark, path, columns):
        self.spark, self.path, self.columns = spark, str(path), columns
        self.add([])

    def add(self, rows):
        self.spark.createDataFrame(rows, self.columns).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.columns).parquet(self.path)


def play(spark, feed, df, batches, mode, tmp_path):
    """Rows that each batch gives; the query stops and resumes from its checkpoint between them."""
    out, checkpoint = [], str(tmp_path / f"ckpt-{uuid.uuid4().hex}")
    for rows in batches:
        feed.add([(k, at(t) if isinstance(t, str) else t, *more) for k, t, *more in rows])
        got = []
        run.start(df, lambda batch, _, got=got: got.extend(map(tuple, batch.collect())), checkpoint, mode).awaitTermination()
        out.append(got)
    return out


COLUMNS = "k string, ts timestamp, v double"


def test_watermark_follows_the_latest_row(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    counts = g.aggregate(feed.stream().withWatermark("ts", "5 seconds"), [], {"n": "count(*)"}, g.Span("tumble", "ts", "10 seconds"))
    batches = [[("a", "10:00:01", 1.0)], [("a", "10:00:12", 1.0)], [("a", "10:00:02", 1.0)], [("a", "10:00:30", 1.0)], [("a", "10:00:31", 1.0)]]
    out = play(spark, feed, counts, batches, "append", tmp_path)
    # 10:00:02 still counts while the watermark is 10:00:07; the window closes after 10:00:15
    closed = [(str(r[0])[11:], r[2]) for got in out for r in got]
    assert sorted(closed) == [("10:00:00", 2), ("10:00:10", 1)]


def test_late_side_output_and_retraction(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    df = state.late_windows(feed.stream(), "k", "ts", "1 minute", "5 minutes", value="v")
    batches = [[("a", "10:00:10", 1.0), ("a", "10:00:20", 2.0)], [("a", "10:02:00", 5.0)], [("a", "10:00:30", 4.0)], [("a", "10:30:00", 1.0)], [("a", "10:00:40", 7.0)], [("a", "10:31:00", 0.0)]]
    out = [r for got in play(spark, feed, df, batches, "update", tmp_path) for r in got]
    first = [(op, n, total) for _, op, start, _, n, total, _ in out if start == at("10:00:00")]
    assert first == [("+", 2, 3.0), ("-", 2, 3.0), ("+", 3, 7.0), ("late", 1, 7.0)]
    assert ("+", 1, 5.0) in [(op, n, total) for _, op, start, _, n, total, _ in out if start == at("10:02:00")]


def test_keep_last_and_first_by_order(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    batches = [[("a", "10:00", 1.0), ("b", "10:00", 1.0)], [("a", "09:00", 2.0)], [("a", "11:00", 3.0), ("b", "08:00", 4.0)]]
    last = play(spark, feed, state.deduplicate_stream(feed.stream(), ["k"], "ts", "last"), batches, "update", tmp_path)
    assert [sorted((r[0], r[2]) for r in got) for got in last] == [[("a", 1.0), ("b", 1.0)], [], [("a", 3.0)]]
    feed = Feed(spark, tmp_path / "again", COLUMNS)
    first = play(spark, feed, state.deduplicate_stream(feed.stream(), ["k"], "ts", "first"), batches, "update", tmp_path)
    assert [sorted((r[0], r[2]) for r in got) for got in first] == [[("a", 1.0), ("b", 1.0)], [("a", 2.0)], [("b", 4.0)]]


def test_fold_keeps_state(spark, tmp_path):
    import pandas as pd

    def step(key, value, pdf):
        total = (value[0] if value else 0.0) + float(pdf.v.sum())
        return (total,), pd.DataFrame([(key[0], total)], columns=["k", "total"])

    feed = Feed(spark, tmp_path / "in", COLUMNS)
    schema = spark.createDataFrame([], "k string, total double").schema
    out = play(spark, feed, state.fold(feed.stream(), ["k"], step, "total double", schema), [[("a", "10:00", 1.0)], [("a", "10:01", 2.0), ("b", "10:00", 5.0)]], "update", tmp_path)
    assert [sorted(x) for x in out] == [[("a", 1.0)], [("a", 3.0), ("b", 5.0)]]


def test_stream_anti_join(spark, tmp_path):
    left, right = (Feed(spark, tmp_path / x, COLUMNS) for x in ("l", "r"))
    sides = [f.stream().withWatermark("ts", "1 minute") for f in (left, right)]
    out = j.join(*sides, "l.k = r.k AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 5 MINUTES", "anti")
    got = []
    # the watermark is that of the slower side, so both go on
    for l_rows, r_rows in (([("a", "10:00", 1.0), ("b", "10:00", 2.0)], [("a", "10:01", 1.0)]), ([("y", "11:00", 0.0)], [("z", "11:00", 0.0)]), ([("y", "12:00", 0.0)], [("z", "12:00", 0.0)])):
        for feed, rows in ((left, l_rows), (right, r_rows)):
            feed.add([(k, at(t), v) for k, t, v in rows])
        run.start(out, lambda batch, _: got.extend(r["k"] for r in batch.collect()), str(tmp_path / "ckpt")).awaitTermination()
    assert got[0] == "b" and "a" not in got


def test_batch_and_stream_agree(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    rows = [("ab"[n % 2], at(f"10:{n % 60:02}"), float(n)) for n in range(90)]
    feed.add(rows[:50])
    feed.add(rows[50:])
    span = g.Span("slide", "ts", "10 minutes", "5 minutes")
    count = lambda df: g.aggregate(df, ["k"], {"n": "count(*)", "total": "sum(v)"}, span)
    streamed = run.collect(count(feed.stream()), f"t{uuid.uuid4().hex}", "complete")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, count(spark.read.parquet(feed.path)).collect()))


def test_a_collected_stream_lies_in_files(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    feed.add([("a", at("10:00"), 1.0), ("b", at("10:01"), 2.0)])
    out = run.collect(feed.stream().select("k", "v"), f"t{uuid.uuid4().hex}")
    assert sorted(map(tuple, out.collect())) == [("a", 1.0), ("b", 2.0)]
    # rows that came to the driver have no files
    assert out.inputFiles()
    none = run.collect(feed.stream().where("v > 5").groupBy("k").count(), f"t{uuid.uuid4().hex}", "complete")
    assert none.columns == ["k", "count"] and none.count() == 0


def test_sessions_that_batches_join_are_whole_and_lie_in_files(spark, tmp_path, sf_dir):
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    for minutes in ((0, 20, 9), (4, 40)):
        feed.add([(k, at(f"10:{m:02}"), 1.0) for k in "ab" for m in minutes])
    one_by_one = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(feed.path)
    counts = g.aggregate(one_by_one, ["k"], {"n": "count(*)"}, g.Span("session", "ts", "6 minutes"))
    out = run.collect(counts, f"t{uuid.uuid4().hex}", "complete")
    starts = [(at("10:00"), 3), (at("10:20"), 1), (at("10:40"), 1)]
    assert sorted((r["k"], r["window_start"], r["n"]) for r in out.collect()) == [(k, *s) for k in "ab" for s in starts]
    # rows that came to the driver have no files, and state in memory has another store
    assert suites.QUERIES["stream_session"](spark, sf_dir).inputFiles()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == state.ROCKSDB


def test_micro_batch_sql_and_route(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    feed.add([("a", at("10:00"), 1.0), ("a", at("10:01"), 2.0), ("b", at("10:00"), 30.0)])
    got, high, rest = [], [], []
    run.start(feed.stream(), run.micro_batch_sql("SELECT k, sum(v) AS total FROM input GROUP BY k", lambda df, _: got.extend(map(tuple, df.collect()))), str(tmp_path / "c1")).awaitTermination()
    assert sorted(got) == [("a", 3.0), ("b", 30.0)]
    from spillway.operators import stateless

    sinks = [lambda df, _: high.extend(r["v"] for r in df.collect()), lambda df, _: rest.extend(r["v"] for r in df.collect())]
    run.start(feed.stream(), run.routed(lambda df: stateless.route(df, ["v > 10"]), sinks), str(tmp_path / "c2")).awaitTermination()
    assert (high, sorted(rest)) == ([30.0], [1.0, 2.0])


def test_failed_batch_is_repeated(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", COLUMNS)
    feed.add([("a", at("10:00"), 1.0)])
    tries, seen = [], []

    def sink(df, batch):
        tries.append(batch)
        if len(tries) == 1:
            raise RuntimeError("no")
        seen.extend(r["v"] for r in df.collect())

    slept = []
    boss = run.Supervisor(lambda: run.start(feed.stream(), sink, str(tmp_path / "c")), run.Restart("fixed-delay", 2, "1 second"), sleep=slept.append)
    assert boss.run() == 1 and seen == [1.0] and slept == [1.0] and tries[0] == tries[1]


def test_restart_strategies():
    class Query:
        def awaitTermination(self):
            raise RuntimeError("no")

    for kind, times, starts in (("no-restart", [0], 1), ("fixed-delay", list(range(10)), 3), ("failure-rate", [0, 0, 0, 1000, 1000, 2000, 2000] + [2000] * 20, None)):
        clock, made = iter(times * 3), []

        def start(made=made):
            made.append(1)
            return Query()

        boss = run.Supervisor(start, run.Restart(kind, 2, "1 second", "5 minutes"), sleep=lambda s: None, clock=lambda c=clock: next(c, 10**6))
        with pytest.raises(RuntimeError):
            boss.run()
        assert starts is None or len(made) == starts
    with pytest.raises(ValueError):
        run.Restart("sometimes")


def test_lookup_cache(spark):
    now, loads = [0.0], []

    def load():
        loads.append(1)
        return spark.range(1)

    cache = run.LookupCache(load, "5 minutes", clock=lambda: now[0])
    cache(), cache()
    now[0] = 600.0
    cache()
    assert len(loads) == cache.loads == 2


def test_metrics(spark, tmp_path):
    metrics = run.Metrics()
    spark.streams.addListener(metrics)
    try:
        feed = Feed(spark, tmp_path / "in", COLUMNS)
        feed.add([("a", at("10:00"), 1.0)] * 5)
        query = run.start(feed.stream(), lambda df, _: df.count(), str(tmp_path / "c"))
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        import time

        for _ in range(50):
            if metrics.queries.get(str(query.id), {}).get("ended"):
                break
            time.sleep(0.1)
        said = metrics.queries[str(query.id)]
        assert said["rows"] == 5 and said["batches"] >= 1 and said["error"] is None and sum(said["latency"].values()) == said["batches"]
    finally:
        spark.streams.removeListener(metrics)


def test_generated_stream(spark):
    schema = Schema({"id": Field.BIGINT(), "ts": Field.TIMESTAMP()}, Watermark("ts", "ts - INTERVAL '5' SECOND"))
    df = generated.generate(spark, schema, 50, 20, streaming=True)
    assert df.isStreaming and df.schema["ts"].dataType.simpleString() == "timestamp"
    query = df.writeStream.format("memory").queryName("made").start()
    try:
        import time

        for _ in range(100):
            if spark.table("made").count() >= 20:
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(r["id"] for r in spark.table("made").collect()) == list(range(20))


def test_settings(spark):
    before = spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy")
    run.configure(spark, "memory", "max")
    assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "max"
    run.configure(spark, watermark=before)
    with pytest.raises(ValueError):
        run.configure(spark, "disk")
    with pytest.raises(ValueError):
        run.start(spark.readStream.format("rate").load(), mode="retract")
    assert run.trigger("5 MINUTES") == {"processingTime": "300 seconds"} and F is not None
