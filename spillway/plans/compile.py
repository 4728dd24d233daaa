"""Lowering of nodes to DataFrames. Each node is lowered once, whatever reads it; the physical plan is Catalyst's."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import Dialect
from ..operators import cep, grouping, joins, sql, stateless
from ..schema import Schema, SchemaError, interval
from ..sources import external, generated
from ..streaming import late, state
from ..streaming import run as streams
from . import nodes as n


@dataclass
class Rows:
    """A lowered node: its rows, the window that they are to be grouped by, and what their source declared."""

    df: DataFrame
    span: grouping.Span | None = None
    keys: tuple[str, ...] = ()
    schema: Schema | None = None
    lateness: str | None = None

    @property
    def bounded(self) -> bool:
        return {grouping.START, grouping.END} <= set(self.df.columns)


@dataclass
class Compiler:
    spark: SparkSession
    streaming: bool = False
    dialect: Dialect = field(default_factory=Dialect)
    defaults: dict = field(default_factory=dict)
    done: dict[n.Node, Rows] = field(default_factory=dict)
    routes: dict[n.Node, list[DataFrame]] = field(default_factory=dict)
    names: dict[int, str] = field(default_factory=dict)
    caches: dict[int, streams.LookupCache] = field(default_factory=dict)

    def rows(self, node: n.Node) -> Rows:
        # a lookup loads its table itself, when it wants it
        for each in n.walk([node], lambda x: list(x.inputs)):
            if each not in self.done:
                lower = LOWERING.get(type(each)) or next((f for t, f in LOWERING.items() if isinstance(each, t)), None)
                if lower is None:
                    raise n.DefinitionError(f"{each.component} has no lowering")
                self.done[each] = lower(self, each, [self.done[i] for i in each.inputs])
        return self.done[node]

    def frame(self, node: n.Node) -> DataFrame:
        """A node's rows; those of a window node with window_start and window_end."""
        return self.materialised(self.rows(node))

    def materialised(self, rows: Rows) -> DataFrame:
        if rows.span is None or rows.bounded:
            return rows.df
        if rows.span.kind == "session":
            return grouping.sessions(rows.df, rows.span, list(rows.keys))
        return grouping.bounded(rows.df, rows.span)


LOWERING: dict[type, Callable[[Compiler, n.Node, list[Rows]], Rows]] = {}


def lowers(*kinds: type):
    def register(f):
        LOWERING.update(dict.fromkeys(kinds, f))
        return f

    return register


# ---- sources


@lowers(n.GeneratorSource)
def _generator(c: Compiler, node: n.GeneratorSource, _) -> Rows:
    return Rows(generated.generate(c.spark, node.schema, node.rows_per_second, node.max_rows, c.streaming), schema=node.schema)


@lowers(n.FileSource)
def _files(c: Compiler, node: n.FileSource, _) -> Rows:
    return Rows(external.read_files(c.spark, node.path, node.format, node.schema, c.streaming, node.options), schema=node.schema)


@lowers(n.JdbcSource)
def _jdbc(c: Compiler, node: n.JdbcSource, _) -> Rows:
    return Rows(external.read_jdbc(c.spark, node.url, node.table, node.partition_column, node.partitions, (node.lower, node.upper), node.properties), schema=node.schema)


@lowers(n.KafkaSource)
def _kafka(c: Compiler, node: n.KafkaSource, _) -> Rows:
    servers = node.bootstrap_servers or c.defaults.get("bootstrap_servers")
    if not servers:
        raise n.DefinitionError(f"topic {node.topic!r} has no servers")
    return Rows(external.read_kafka(c.spark, node.schema, node.topic, servers, node.format, c.streaming, node.startup_mode, node.consumer_group, node.timestamp_ms), schema=node.schema)


@lowers(n.TableSource)
def _table(c: Compiler, node: n.TableSource, _) -> Rows:
    df = node.frame(c.spark) if callable(node.frame) else node.frame
    return Rows(node.schema.watermarked(df) if node.schema else df, schema=node.schema)


# ---- stateless: a window over their input stays


def through(c: Compiler, rows: Rows, df: DataFrame) -> Rows:
    """The rows go on with their window, declared event time and key."""
    out = Rows(df, rows.span, rows.keys, rows.schema, rows.lateness)
    if rows.span is not None and not out.bounded and rows.span.on not in df.columns:
        raise n.DefinitionError(f"window column {rows.span.on!r} is gone")
    return out


@lowers(n.Filter)
def _filter(c, node, ins):
    return through(c, ins[0], stateless.where(ins[0].df, node.condition, c.dialect))


@lowers(n.Map)
def _map(c, node, ins):
    return through(c, ins[0], stateless.project(ins[0].df, node.select, c.dialect, node.preserve_order))


@lowers(n.FlatMap)
def _flat_map(c, node, ins):
    return through(c, ins[0], stateless.unnest(ins[0].df, node.unnest, node.into))


@lowers(n.Rename)
def _rename(c, node, ins):
    return through(c, ins[0], stateless.rename(ins[0].df, node.columns))


@lowers(n.Drop)
def _drop(c, node, ins):
    return through(c, ins[0], stateless.drop(ins[0].df, node.columns))


@lowers(n.Project)
def _project(c, node, ins):
    return through(c, ins[0], stateless.pick(ins[0].df, node.columns))


@lowers(n.Cast)
def _cast(c, node, ins):
    return through(c, ins[0], stateless.cast(ins[0].df, node.columns, node.on_error))


@lowers(n.Coalesce)
def _coalesce(c, node, ins):
    return through(c, ins[0], stateless.fill(ins[0].df, node.columns, c.dialect))


@lowers(n.AddField)
def _add_field(c, node, ins):
    return through(c, ins[0], stateless.add(ins[0].df, node.columns, node.types, c.dialect))


@lowers(n.Union)
def _union(c, node, ins):
    return Rows(stateless.union([c.materialised(i) for i in ins]))


@lowers(n.Route)
def _route(c, node, ins):
    df = c.materialised(ins[0])
    c.routes[node] = stateless.route(df, [b.condition for b in node.branches], c.dialect)
    return Rows(df)


@lowers(n.RouteOutput)
def _route_output(c, node, ins):
    return Rows(c.routes[node.inputs[0]][node.index])


# ---- windows and grouping


@lowers(n.TumbleWindow)
def _tumble(c, node, ins):
    return Rows(ins[0].df, grouping.Span("tumble", node.on, node.size), schema=ins[0].schema, lateness=node.allowed_lateness)


@lowers(n.SlideWindow)
def _slide(c, node, ins):
    return Rows(ins[0].df, grouping.Span("slide", node.on, node.size, node.slide), schema=ins[0].schema, lateness=node.allowed_lateness)


@lowers(n.SessionWindow)
def _session(c, node, ins):
    return Rows(ins[0].df, grouping.Span("session", node.on, node.gap), node.key, ins[0].schema, node.allowed_lateness)


@lowers(n.Aggregate)
def _aggregate(c, node, ins):
    keys = list(node.group_by)
    if ins[0].lateness and ins[0].df.isStreaming:
        return Rows(late.late_aggregate(ins[0].df, keys, ins[0].span, node.select, ins[0].lateness, c.dialect))
    if ins[0].span is not None and ins[0].bounded:
        keys += [k for k in (grouping.START, grouping.END) if k not in keys]
        return Rows(grouping.aggregate(ins[0].df, keys, node.select, None, c.dialect))
    return Rows(grouping.aggregate(ins[0].df, keys, node.select, ins[0].span, c.dialect))


def with_bounds(rows: Rows, keys: tuple[str, ...]) -> list[str]:
    return [*keys, *([k for k in (grouping.START, grouping.END) if k not in keys] if rows.span is not None else [])]


@lowers(n.TopN)
def _top(c, node, ins):
    rows = ins[0]
    if rows.df.isStreaming:
        raise n.DefinitionError("a stream's top-n is one of closed windows: partition it by window_start, after an aggregate, in append mode")
    if rows.span is not None and rows.span.kind == "session" and not rows.keys:
        rows = Rows(rows.df, rows.span, node.partition_by)
    return Rows(grouping.top(c.materialised(rows), with_bounds(rows, node.partition_by), node.order_by, node.n, node.rank_column))


@lowers(n.Deduplicate)
def _deduplicate(c, node, ins):
    df = c.materialised(ins[0])
    if df.isStreaming:
        node = dataclasses.replace(node, within=node.within or c.defaults.get("state_ttl"))
        order = node.order.split()[0]
        downwards = node.order.upper().endswith(" DESC")
        if node.keep == "first" and not downwards and node.within and ins[0].schema and ins[0].schema.watermark and ins[0].schema.watermark.column == order:
            return Rows(state.deduplicate_within(df, list(node.key), order, node.within))
        keep = node.keep if not downwards else {"first": "last", "last": "first"}[node.keep]
        return Rows(state.deduplicate_stream(df, list(node.key), order, keep, node.within))
    return Rows(grouping.deduplicate(df, with_bounds(ins[0], node.key), node.order, node.keep))


@lowers(n.OrderBy)
def _order(c, node, ins):
    return Rows(c.materialised(ins[0]).orderBy(*grouping.ordering(node.columns)))


@lowers(n.Limit)
def _limit(c, node, ins):
    return Rows(c.materialised(ins[0]).limit(node.n))


# ---- joins


@lowers(n.Join)
def _join(c, node, ins):
    left, right = ins
    if left.span is not None and right.span is not None:
        return Rows(joins.windowed_join(c.materialised(left), c.materialised(right), node.on, node.type, node.aliases, c.dialect), left.span)
    a, b, extra = c.materialised(left), c.materialised(right), None
    ttl = node.state_ttl or c.defaults.get("state_ttl")
    if ttl and a.isStreaming and b.isStreaming:
        marks = [r.schema.watermark.column if r.schema and r.schema.watermark else None for r in (left, right)]
        if None in marks:
            raise n.DefinitionError("state_ttl needs sources with a watermark on both sides")
        ttl = interval(ttl)
        extra = F.expr(f"{node.aliases[1]}.`{marks[1]}` BETWEEN {node.aliases[0]}.`{marks[0]}` - INTERVAL {ttl} AND {node.aliases[0]}.`{marks[0]}` + INTERVAL {ttl}")
    return Rows(joins.join(a, b, node.on, node.type, node.aliases, node.broadcast, extra, c.dialect))


@lowers(n.IntervalJoin)
def _interval_join(c, node, ins):
    a, b = (c.materialised(i) for i in ins)
    return Rows(joins.interval_join(a, b, node.on, node.left_ts, node.right_ts, node.lower, node.upper, node.type, node.aliases, c.dialect))


@lowers(n.TemporalJoin)
def _temporal_join(c, node, ins):
    a, b = (c.materialised(i) for i in ins)
    if a.isStreaming and not b.isStreaming:
        # a stream against versions at rest: ranges of validity, which are a static table
        return Rows(temporal_ranges(a, b, node))
    return Rows(joins.temporal_join(a, b, node.on, node.as_of, node.version, node.type, node.changelog, node.aliases))


def temporal_ranges(facts: DataFrame, versions: DataFrame, node: n.TemporalJoin) -> DataFrame:
    from pyspark.sql import Window

    kind = facts.schema[node.as_of].dataType
    upto = F.lead(F.col(node.version).cast(kind)).over(Window.partitionBy(*node.on.values()).orderBy(node.version))
    ranged = versions.withColumn("__upto", upto)
    if node.changelog:
        ranged = ranged.where(F.upper(F.col(node.changelog)) != "DELETE").drop(node.changelog)
    a, b = node.aliases
    on = " AND ".join(f"{a}.`{x}` = {b}.`{y}`" for x, y in node.on.items())
    on += f" AND {a}.`{node.as_of}` >= {b}.`{node.version}` AND ({b}.__upto IS NULL OR {a}.`{node.as_of}` < {b}.__upto)"
    return joins.join(facts, ranged, on, node.type, node.aliases).drop("__upto")


@lowers(n.LookupJoin)
def _lookup_join(c, node, ins):
    def load() -> DataFrame:
        if isinstance(node.table, n.Node):
            return Compiler(c.spark, False, c.dialect, c.defaults).frame(node.table)
        return external.read_jdbc(c.spark, node.url, node.table, properties=node.properties)

    rows, table = c.materialised(ins[0]), load
    if node.cache_ttl:
        if rows.isStreaming:
            raise n.DefinitionError("between a lookup with cache_ttl and its sink each operator takes row by row")
        table = c.caches.setdefault(id(node), streams.LookupCache(load, node.cache_ttl, node.cache_max_rows))
    return Rows(joins.lookup_join(rows, table, node.on, list(node.select) or None, node.type, node.aliases, c.dialect))


# ---- SQL and patterns


def checked(df: DataFrame, schema: Schema | None) -> DataFrame:
    """Rows as a declared schema names and types them; a difference is an error."""
    if schema is None:
        return df
    want = [(k, t.simpleString()) for k, t in schema.fields.items()]
    if sorted(df.dtypes) != sorted(want):
        raise SchemaError(f"declared {sorted(want)}, found {sorted(df.dtypes)}")
    return df.select(*schema.fields)


@lowers(n.Query)
def _query(c, node, ins):
    group = with_bounds(ins[0], node.group_by) if node.group_by else None
    select = dict(node.select) | ({k: k for k in group if k in (grouping.START, grouping.END)} if group else {})
    df = sql.query(c.materialised(ins[0]), select, node.where, group, node.having, node.order_by or None, node.windows, c.dialect)
    return Rows(checked(df, node.output_schema))


@lowers(n.RawSQL)
def _raw_sql(c, node, ins):
    tables = {}
    for k, (i, rows) in enumerate(zip(node.inputs, ins, strict=True)):
        df = c.materialised(rows)
        tables["input" if k == 0 else f"input_{k + 1}"] = df
        tables[i.name or c.names.get(id(i), i.component)] = df
    return Rows(checked(sql.run(c.spark, node.sql, tables), node.output_schema))


@lowers(n.MatchRecognize)
def _match(c, node, ins):
    rows = ins[0]
    return Rows(cep.match_recognize(c.materialised(rows), node.pattern, node.define, node.measures, with_bounds(rows, node.partition_by), node.order_by, node.after, node.types, c.dialect))


@lowers(n.Custom)
def _custom(c, node, ins):
    return Rows(node.apply(*[c.materialised(i) for i in ins]))


@lowers(n.Sink)
def _sink(c, node, ins):
    return Rows(c.materialised(ins[0]))
