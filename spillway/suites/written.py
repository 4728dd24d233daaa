"""Sinks: what a pipeline wrote, read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans import nodes as n
from ..plans.execute import run_batch
from .base import query, source


def fresh(spark: SparkSession) -> str:
    """A folder that executors share: below spark.checkpoint.dir, or a local one where that is unset, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spillway-")
    return f"{shared.rstrip('/')}/written-{uuid.uuid4().hex[:12]}"


def through(spark: SparkSession, node: n.Node, sink: n.Sink) -> DataFrame:
    run_batch(spark, n.Pipeline("written", (node.to(sink),), mode="batch"))
    return spark.read.format(getattr(sink, "format", "parquet")).load(sink.path)


@query("SELECT event_id, user_id, event_type FROM events")
def sink_files(spark, d):
    """One folder per event type."""
    rows = source(d, "events").via(n.Project(columns=("event_id", "user_id", "event_type")))
    return through(spark, rows, n.FileSink(path=fresh(spark), partition_by=("event_type",))).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events")
def sink_orc(spark, d):
    return through(spark, source(d, "events").via(n.Project(columns=("event_id", "user_id", "event_type"))), n.FileSink(path=fresh(spark), format="orc"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def sink_upsert(spark, d):
    """The newest event per user; writing the same rows again changes nothing."""
    path = fresh(spark)
    rows = source(d, "events").via(n.Project(columns=("user_id", "event_id")))
    for _ in range(2):
        out = through(spark, rows, n.UpsertSink(path=path, keys=("user_id",), order="event_id"))
    return out
