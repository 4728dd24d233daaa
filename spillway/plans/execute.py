"""Running a pipeline: batches write each sink; streams start one query per sink, or one per source of a route."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import Dialect
from ..operators import stateless
from ..operators.grouping import END, START
from ..sinks import write
from ..streaming import run as streams
from . import nodes as n
from .compile import Compiler
from .validate import require_valid


def compiler_for(spark: SparkSession, pipeline: n.Pipeline, defaults: dict | None = None) -> Compiler:
    for key, value in pipeline.spark.items():
        spark.conf.set(key, value)
    said = {"state_ttl": pipeline.state_ttl} if pipeline.state_ttl else {}
    c = Compiler(spark, pipeline.mode == "streaming", Dialect(pipeline.compat, pipeline.integer_division), {**said, **(defaults or {})})
    c.names = {id(x): k for k, x in pipeline.nodes().items()}
    return c


def write_batch(sink: n.Sink, df: DataFrame, name: str, defaults: dict, batch: int | None = None) -> None:
    """One batch into a sink. Files of a micro-batch get a folder by its number, which a repeat overwrites."""
    if isinstance(sink, n.ConsoleSink):
        write.write_console(df, sink.max_rows)
    elif isinstance(sink, n.FileSink):
        path = sink.path if batch is None else f"{sink.path}/_batch={batch}"
        write.write_files(df, path, sink.format, list(sink.partition_by), sink.single)
    elif isinstance(sink, n.UpsertSink):
        write.upsert_files(df, sink.path, list(sink.keys), sink.order)
    elif isinstance(sink, n.JdbcSink):
        write.write_jdbc(df, sink.url, sink.table, list(sink.upsert_keys) or None, sink.properties)
    elif isinstance(sink, n.KafkaSink):
        write.write_kafka(df, sink.topic, sink.bootstrap_servers or defaults["bootstrap_servers"], list(sink.key_by) or None, sink.format)
    elif isinstance(sink, n.MemorySink):
        df.createOrReplaceTempView(name)
    else:
        raise n.DefinitionError(f"{sink.component} can't be written")


def run_batch(spark: SparkSession, pipeline: n.Pipeline, defaults: dict | None = None) -> None:
    require_valid(pipeline)
    c = compiler_for(spark, pipeline, defaults)
    for sink in pipeline.sinks:
        write_batch(sink, c.frame(sink), c.names[id(sink)], c.defaults)


def routed_sinks(pipeline: n.Pipeline) -> dict[int, tuple[n.Route, list[n.Sink]]]:
    """Routes all of whose outputs go straight to sinks: one query can feed them all."""
    out: dict[int, tuple[n.Route, list[n.Sink]]] = {}
    for sink in pipeline.sinks:
        if sink.inputs and isinstance(sink.inputs[0], n.RouteOutput):
            route = sink.inputs[0].inputs[0]
            out.setdefault(id(route), (route, []))[1].append(sink)
    return out


#: Operators that take row by row: on a micro-batch they give what they would give on the stream.
ROW_BY_ROW = (n.Filter, n.Map, n.FlatMap, n.Rename, n.Drop, n.Project, n.Cast, n.Coalesce, n.AddField, n.LookupJoin, n.Sink)


def within_windows(node: n.Node) -> bool:
    """A top-n of closed windows: an aggregate of windows gives all rows of a window in one micro-batch."""
    if not isinstance(node, n.TopN) or not {START, END} & set(node.partition_by):
        return False
    at = node.inputs[0]
    while isinstance(at, ROW_BY_ROW) and at.inputs:
        at = at.inputs[0]
    return isinstance(at, n.Aggregate) and any(isinstance(x, n.WindowNode) for x in n.walk([at]))


def per_batch(c: Compiler, node: n.Node, mode: str = "append") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """A node's stream, and what is left to do with each micro-batch of it. Lookups after the last operator that isn't
    row by row belong there: they join the table as it is then, or as its cache has it. So do top-ns of closed windows."""
    path: list[n.Node] = []
    at = node
    while at.inputs and (isinstance(at, ROW_BY_ROW) or mode == "append" and within_windows(at)):
        path.append(at)
        at = at.inputs[0]
    while path and not isinstance(path[-1], (n.LookupJoin, n.TopN)):
        at = path.pop()
    if not path:
        return c.frame(node), lambda df: df
    held: dict[str, DataFrame] = {}
    after: n.Node = n.TableSource(frame=lambda _: held["rows"])
    for each in reversed(path):
        after = dataclasses.replace(each, inputs=(after,))

    def apply(df: DataFrame) -> DataFrame:
        held["rows"] = df
        return Compiler(c.spark, False, c.dialect, c.defaults, caches=c.caches).frame(after)

    return c.frame(path[-1].inputs[0]), apply


def starters(spark: SparkSession, pipeline: n.Pipeline, defaults: dict | None = None, every: str | None = None) -> list[Callable[[], StreamingQuery]]:
    """What starts each query of a pipeline. Each has its own folder below the checkpoint's location, and resumes from it."""
    require_valid(pipeline)
    streams.configure(spark, pipeline.state_backend, parallelism=pipeline.parallelism)
    c = compiler_for(spark, pipeline, defaults)
    ckpt = pipeline.checkpoint
    every = every or (ckpt.interval if ckpt else None)
    out: list[Callable[[], StreamingQuery]] = []
    routed: set[int] = set()

    def start(df: DataFrame, sink, key: str, name: str, other: str | None = None) -> None:
        location = f"{ckpt.location}/{key}" if ckpt and ckpt.location else other
        out.append(lambda: streams.start(df, sink, location, pipeline.output_mode, every, name=name))

    for route, sinks in routed_sinks(pipeline).values():
        conditions, dialect = [b.condition for b in route.branches], c.dialect
        by_index = {s.inputs[0].index: s for s in sinks}
        order = [*range(len(conditions)), -1]
        writers = [(lambda df, batch, s=by_index[k]: write_batch(s, df, c.names[id(s)], c.defaults, batch)) if k in by_index else None for k in order]
        df, apply = per_batch(c, route.inputs[0], pipeline.output_mode)
        start(df, streams.routed(lambda df, q=conditions, d=dialect, f=apply: stateless.route(f(df), q, d), writers), c.names[id(route)], f"{pipeline.name}_{c.names[id(route)]}")
        routed |= {id(s) for s in sinks}
    for sink in pipeline.sinks:
        if id(sink) in routed:
            continue
        (df, apply), name = per_batch(c, sink, pipeline.output_mode), c.names[id(sink)]
        if not isinstance(sink, n.MemorySink):
            start(df, lambda rows, batch, s=sink, k=name, f=apply: write_batch(s, f(rows), k, c.defaults, batch), name, f"{pipeline.name}_{name}")
        else:
            # a lookup or a top-n is known once there are rows
            known = None if any(isinstance(x, (n.LookupJoin, n.TopN)) for x in n.walk([sink])) else df.schema
            kept = streams.Kept(spark, name, pipeline.output_mode == "complete", known)
            start(df, lambda rows, batch, k=kept, f=apply: k(f(rows), batch), name, f"{pipeline.name}_{name}", kept.checkpoint)
    return out


def start_streams(spark: SparkSession, pipeline: n.Pipeline, defaults: dict | None = None, every: str | None = None) -> list[StreamingQuery]:
    """The running queries of a pipeline."""
    return [begin() for begin in starters(spark, pipeline, defaults, every)]


def run_streams(spark: SparkSession, pipeline: n.Pipeline, defaults: dict | None = None, every: str | None = None) -> int:
    """Runs all queries until they end, each restarted after failures as the pipeline's ``restart`` says; the number of
    restarts. What a query can't recover from is raised once the others have ended."""
    begins = starters(spark, pipeline, defaults, every)
    with ThreadPoolExecutor(max(1, len(begins))) as pool:
        ran = [pool.submit(streams.Supervisor(begin, pipeline.restart or streams.Restart()).run) for begin in begins]
    return sum(r.result() for r in ran)
