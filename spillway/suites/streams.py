"""Definitions run as streams over files that are there, compared with the same SQL as the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grouping, joins, stateless
from ..plans import nodes as n
from ..plans.execute import start_streams
from ..schema import Field, Schema, Watermark
from ..sources import external
from ..streaming import run as streaming
from ..streaming import state
from .base import query

EVENTS = Schema(
    {"event_id": Field.BIGINT(), "ts": Field.TIMESTAMP(), "user_id": Field.BIGINT(), "event_type": Field.STRING(), "value": Field.DOUBLE(), "props": Field.STRING()},
    Watermark("ts", "ts - INTERVAL '1' HOUR"),
)


def events(spark: SparkSession, d: str) -> DataFrame:
    return external.read_files(spark, f"{d}/events.parquet", "parquet", EVENTS, streaming=True)


def settle(df: DataFrame, mode: str) -> DataFrame:
    """The finite stream's whole output; each query has a table of its own."""
    return streaming.collect(df, f"stream_{uuid.uuid4().hex[:12]}", mode)


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 50")
def stream_filter_map(spark, d):
    rows = stateless.where(events(spark, d), "value > 50")
    return settle(stateless.project(rows, {"event_id": "event_id", "kind": "UPPER(event_type)"}), "append")


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumble(spark, d):
    counts = grouping.aggregate(events(spark, d), ["user_id"], {"n": "COUNT(*)"}, grouping.Span("tumble", "ts", "1 day"))
    return settle(counts, "complete").select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""SELECT user_id, min(ts) AS window_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_session(spark, d):
    state.use_rocksdb(spark)
    counts = grouping.aggregate(events(spark, d), ["user_id"], {"n": "COUNT(*)"}, grouping.Span("session", "ts", "6 hours"))
    return settle(counts, "complete").select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_running_total(spark, d):
    return settle(grouping.aggregate(events(spark, d), ["event_type"], {"n": "COUNT(*)"}), "complete")


@query("""SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id
  AND p.ts BETWEEN v.ts - INTERVAL 1 MINUTE AND v.ts + INTERVAL 5 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def stream_interval_join(spark, d):
    views = events(spark, d).where("event_type = 'view'").selectExpr("event_id AS view_id", "user_id", "ts")
    bought = events(spark, d).where("event_type = 'purchase'").selectExpr("event_id AS purchase_id", "user_id AS buyer", "ts AS pts")
    return settle(joins.interval_join(views, bought, "l.user_id = r.buyer", "ts", "pts", "-1 MINUTE", "5 HOURS"), "append").select("view_id", "purchase_id")


@query("SELECT count(DISTINCT user_id) AS users FROM events")
def stream_deduplicate(spark, d):
    from ..streaming import state

    kept = state.deduplicate_within(external.read_files(spark, f"{d}/events.parquet", streaming=True), ["user_id"], "ts", "60 days")
    return settle(kept.select("user_id"), "append").agg(F.count("*").alias("users"))


@query("SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def stream_lookup(spark, d):
    rows = joins.lookup_join(events(spark, d), lambda: spark.read.parquet(f"{d}/customer.parquet"), "l.user_id = r.c_custkey", ["c_name"], "inner")
    return settle(rows.select("event_id", "c_name"), "append")


def piped(spark: SparkSession, node: n.Node, mode: str = "append") -> DataFrame:
    """All that a pipeline of one node gives over the files that are there."""
    name = f"piped_{uuid.uuid4().hex[:12]}"
    for begun in start_streams(spark, n.Pipeline(name, (node.to(n.MemorySink(name=name)),), output_mode=mode), every="available-now"):
        begun.awaitTermination()
    return spark.table(name)


def event_source(d: str) -> n.Node:
    return n.FileSource(path=f"{d}/events.parquet", schema=EVENTS)


@query("SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def stream_lookup_ttl(spark, d):
    """A lookup within each micro-batch, of a table that is kept for a time."""
    table = n.FileSource(path=f"{d}/customer.parquet")
    looked = event_source(d).via(n.LookupJoin(table=table, on="l.user_id = r.c_custkey", select=("c_name",), cache_ttl="1 minute", cache_max_rows=1_000_000))
    return piped(spark, looked.via(n.Project(columns=("event_id", "c_name"))))


CLOSED = """(SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY ALL)
  WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


@query(f"SELECT user_id, window_start, n FROM {CLOSED}")
def stream_closed_windows(spark, d):
    """Windows that the watermark has passed; those still open stay in the state."""
    counts = event_source(d).tumble("1 day", "ts").aggregate(["user_id"], {"n": "COUNT(*)"})
    return piped(spark, counts).select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(f"SELECT user_id, window_start, n FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, user_id) AS place FROM {CLOSED}) WHERE place <= 3")
def stream_window_top(spark, d):
    """The three busiest users of each day that has closed."""
    counts = event_source(d).tumble("1 day", "ts").aggregate(["user_id"], {"n": "COUNT(*)"})
    top = counts.via(n.TopN(partition_by=("window_start",), order_by={"n": "DESC", "user_id": "ASC"}, n=3))
    return piped(spark, top).select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("SELECT user_id, count(*) AS n, max(value) AS best FROM events GROUP BY 1")
def stream_custom_state(spark, d):
    """A running count and maximum in state of one's own; the last row per user is the whole."""
    import pandas as pd

    from ..streaming import state

    def step(key, value, pdf):
        many, best = value or (0, float("-inf"))
        value = (many + len(pdf), max(best, float(pdf.value.max())))
        return value, pd.DataFrame([(key[0], *value)], columns=["user_id", "n", "best"])

    schema = spark.createDataFrame([], "user_id bigint, n bigint, best double").schema
    rows = settle(state.fold(events(spark, d).select("user_id", "value"), ["user_id"], step, "n bigint, best double", schema), "update")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max("best").alias("best"))
