"""Components as immutable nodes. An edge always goes from an input to the operator that reads it, so a definition is
a graph of nodes that hold their inputs; ``via`` and the methods named after components build it fluently."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import types as T

from ..operators.sql import Call, WindowSpec
from ..schema import Schema


class DefinitionError(ValueError):
    """A component whose properties contradict its rules."""


@dataclass(frozen=True, eq=False, kw_only=True)
class Node:
    inputs: tuple[Node, ...] = ()
    name: str | None = None
    kind: ClassVar[str] = "transform"

    @property
    def component(self) -> str:
        return type(self).__name__

    def props(self) -> dict[str, Any]:
        """Properties without inputs and name, and without those left at their default."""
        out = {}
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            default = f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else dataclasses.MISSING
            if f.name not in ("inputs", "name") and value != default:
                out[f.name] = value
        return out

    def via(self, node: Node) -> Node:
        """This node as the (further) input of another."""
        return dataclasses.replace(node, inputs=(*node.inputs, self))

    to = via

    def filter(self, condition: str, **more) -> Node:
        return self.via(Filter(condition=condition, **more))

    def map(self, select: dict[str, str], **more) -> Node:
        return self.via(Map(select=select, **more))

    def aggregate(self, group_by: list[str], select: dict[str, str], **more) -> Node:
        return self.via(Aggregate(group_by=tuple(group_by), select=select, **more))

    def tumble(self, size: str, on: str, **more) -> Node:
        return self.via(TumbleWindow(size=size, on=on, **more))

    def slide(self, size: str, slide: str, on: str, **more) -> Node:
        return self.via(SlideWindow(size=size, slide=slide, on=on, **more))

    def session(self, gap: str, on: str, **more) -> Node:
        return self.via(SessionWindow(gap=gap, on=on, **more))

    def sql(self, text: str, **more) -> Node:
        return self.via(RawSQL(sql=text, **more))


# ---- sources

@dataclass(frozen=True, eq=False, kw_only=True)
class Source(Node):
    schema: Schema | None = None
    kind: ClassVar[str] = "source"


@dataclass(frozen=True, eq=False, kw_only=True)
class GeneratorSource(Source):
    rows_per_second: int = 1000
    max_rows: int = 0


@dataclass(frozen=True, eq=False, kw_only=True)
class FileSource(Source):
    path: str
    format: str = "parquet"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True, eq=False, kw_only=True)
class JdbcSource(Source):
    """A table, read by ``partitions`` tasks in ranges of a column where one is named with its bounds."""

    url: str
    table: str
    properties: dict = field(default_factory=dict)
    partition_column: str | None = None
    partitions: int = 1
    lower: str | int | None = None
    upper: str | int | None = None

    def __post_init__(self):
        if self.partition_column and (self.lower is None or self.upper is None):
            raise DefinitionError("partition_column needs lower and upper")


@dataclass(frozen=True, eq=False, kw_only=True)
class KafkaSource(Source):
    topic: str
    bootstrap_servers: str | None = None
    format: str = "json"
    startup_mode: str = "latest-offset"
    consumer_group: str | None = None
    timestamp_ms: int | None = None


@dataclass(frozen=True, eq=False, kw_only=True)
class TableSource(Source):
    """A DataFrame that exists already, or a function of the session that makes it."""

    frame: Any


# ---- sinks

@dataclass(frozen=True, eq=False, kw_only=True)
class Sink(Node):
    kind: ClassVar[str] = "sink"


@dataclass(frozen=True, eq=False, kw_only=True)
class ConsoleSink(Sink):
    max_rows: int = 0


@dataclass(frozen=True, eq=False, kw_only=True)
class MemorySink(Sink):
    """A view of the session, named after the sink; on streams over files in the shared folder, as large as may be."""


@dataclass(frozen=True, eq=False, kw_only=True)
class FileSink(Sink):
    path: str
    format: str = "parquet"
    partition_by: tuple[str, ...] = ()
    single: bool = False


@dataclass(frozen=True, eq=False, kw_only=True)
class UpsertSink(Sink):
    """Parquet files that hold the newest row per key."""

    path: str
    keys: tuple[str, ...] = ()
    order: str | None = None


@dataclass(frozen=True, eq=False, kw_only=True)
class JdbcSink(Sink):
    url: str
    table: str
    upsert_keys: tuple[str, ...] = ()
    properties: dict = field(default_factory=dict)


@dataclass(frozen=True, eq=False, kw_only=True)
class KafkaSink(Sink):
    topic: str
    bootstrap_servers: str | None = None
    format: str = "json"
    key_by: tuple[str, ...] = ()


# ---- transforms

@dataclass(frozen=True, eq=False, kw_only=True)
class Filter(Node):
    condition: str


@dataclass(frozen=True, eq=False, kw_only=True)
class Map(Node):
    select: dict[str, str]
    preserve_order: bool = False


@dataclass(frozen=True, eq=False, kw_only=True)
class FlatMap(Node):
    unnest: str
    into: dict[str, T.DataType] = field(default_factory=dict)


@dataclass(frozen=True, eq=False, kw_only=True)
class Rename(Node):
    columns: dict[str, str]


@dataclass(frozen=True, eq=False, kw_only=True)
class Drop(Node):
    columns: tuple[str, ...]


@dataclass(frozen=True, eq=False, kw_only=True)
class Project(Node):
    columns: tuple[str, ...]


@dataclass(frozen=True, eq=False, kw_only=True)
class Cast(Node):
    columns: dict[str, T.DataType]
    on_error: str = "fail"


@dataclass(frozen=True, eq=False, kw_only=True)
class Coalesce(Node):
    columns: dict[str, str]


@dataclass(frozen=True, eq=False, kw_only=True)
class AddField(Node):
    columns: dict[str, str]
    types: dict[str, T.DataType] = field(default_factory=dict)


@dataclass(frozen=True, eq=False, kw_only=True)
class Union(Node):
    schemas: tuple[Schema, ...] = ()

    def __post_init__(self):
        names = [sorted((n, t.simpleString()) for n, t in s.fields.items()) for s in self.schemas]
        if any(n != names[0] for n in names[1:]):
            raise DefinitionError("union of different schemas")


@dataclass(frozen=True)
class Branch:
    name: str
    condition: str


@dataclass(frozen=True, eq=False, kw_only=True)
class Route(Node):
    """Rows go to their first matching branch, else to the default; ``branch`` and ``default`` are the outputs."""

    branches: tuple[Branch, ...]

    def __post_init__(self):
        if not self.branches:
            raise DefinitionError("a route needs a branch")
        if len({b.name for b in self.branches}) < len(self.branches):
            raise DefinitionError("two branches have one name")

    def branch(self, name: str) -> Node:
        return RouteOutput(inputs=(self,), index=[b.name for b in self.branches].index(name), name=name)

    def default(self) -> Node:
        return RouteOutput(inputs=(self,), index=-1, name="default")


@dataclass(frozen=True, eq=False, kw_only=True)
class RouteOutput(Node):
    index: int


# ---- grouping

@dataclass(frozen=True, eq=False, kw_only=True)
class Aggregate(Node):
    group_by: tuple[str, ...]
    select: dict[str, str]


@dataclass(frozen=True, eq=False, kw_only=True)
class Deduplicate(Node):
    key: tuple[str, ...]
    order: str
    keep: str = "first"
    within: str | None = None

    def __post_init__(self):
        if self.keep not in ("first", "last"):
            raise DefinitionError(f"keep {self.keep!r}")


@dataclass(frozen=True, eq=False, kw_only=True)
class TopN(Node):
    partition_by: tuple[str, ...]
    order_by: dict[str, str]
    n: int = 10
    rank_column: str | None = None


@dataclass(frozen=True, eq=False, kw_only=True)
class OrderBy(Node):
    columns: dict[str, str]


@dataclass(frozen=True, eq=False, kw_only=True)
class Limit(Node):
    n: int


@dataclass(frozen=True, eq=False, kw_only=True)
class WindowNode(Node):
    """``allowed_lateness``: on a stream, aggregates of the window are a changelog with a column op, see streaming.late."""

    on: str
    allowed_lateness: str | None = None
    kind: ClassVar[str] = "window"


@dataclass(frozen=True, eq=False, kw_only=True)
class TumbleWindow(WindowNode):
    size: str


@dataclass(frozen=True, eq=False, kw_only=True)
class SlideWindow(WindowNode):
    size: str
    slide: str


@dataclass(frozen=True, eq=False, kw_only=True)
class SessionWindow(WindowNode):
    gap: str
    key: tuple[str, ...] = ()


# ---- joins; two inputs, left and right

@dataclass(frozen=True, eq=False, kw_only=True)
class TwoInputs(Node):
    kind: ClassVar[str] = "join"


@dataclass(frozen=True, eq=False, kw_only=True)
class Join(TwoInputs):
    on: str
    type: str = "inner"
    aliases: tuple[str, str] = ("l", "r")
    broadcast: str | None = None
    state_ttl: str | None = None


@dataclass(frozen=True, eq=False, kw_only=True)
class IntervalJoin(TwoInputs):
    on: str
    left_ts: str
    right_ts: str
    lower: str | int
    upper: str | int
    type: str = "inner"
    aliases: tuple[str, str] = ("l", "r")


@dataclass(frozen=True, eq=False, kw_only=True)
class TemporalJoin(TwoInputs):
    on: dict[str, str]
    as_of: str
    version: str
    type: str = "inner"
    changelog: str | None = None
    aliases: tuple[str, str] = ("l", "r")


@dataclass(frozen=True, eq=False, kw_only=True)
class LookupJoin(Node):
    """Enrichment from a table: a source node, or a JDBC url with a table's name. ``cache_ttl`` says how old it may be, and
    ``cache_max_rows`` up to how many rows it is kept at all. Each micro-batch is one join, so there are no calls per row
    to make in parallel."""

    table: Any
    on: str
    url: str | None = None
    select: tuple[str, ...] = ()
    type: str = "left"
    cache_ttl: str | None = None
    cache_max_rows: int | None = None
    properties: dict = field(default_factory=dict)
    aliases: tuple[str, str] = ("l", "r")
    kind: ClassVar[str] = "join"


# ---- SQL

@dataclass(frozen=True, eq=False, kw_only=True)
class Query(Node):
    select: dict[str, str | Call]
    where: str | None = None
    group_by: tuple[str, ...] = ()
    having: str | None = None
    order_by: dict[str, str] = field(default_factory=dict)
    windows: dict[str, WindowSpec] = field(default_factory=dict)
    output_schema: Schema | None = None

    def __post_init__(self):
        if not self.select:
            raise DefinitionError("a query selects something")
        if self.having and not self.group_by:
            raise DefinitionError("having needs group_by")


@dataclass(frozen=True, eq=False, kw_only=True)
class RawSQL(Node):
    """A statement over its inputs: the table ``input``, further ones ``input_2`` and so on, and all by their names."""

    sql: str
    output_schema: Schema | None = None


@dataclass(frozen=True, eq=False, kw_only=True)
class MatchRecognize(Node):
    pattern: str
    define: dict[str, str]
    measures: dict[str, str]
    after: str = "MATCH_RECOGNIZED"
    partition_by: tuple[str, ...] = ()
    order_by: str | None = None
    types: dict[str, T.DataType] = field(default_factory=dict)
    kind: ClassVar[str] = "cep"

    def __post_init__(self):
        if not self.pattern.strip() or not self.define or not self.measures:
            raise DefinitionError("pattern, define and measures are needed")


@dataclass(frozen=True, eq=False, kw_only=True)
class Custom(Node):
    """An operator of one's own: a function of the inputs' DataFrames."""

    apply: Callable = field(default=lambda df: df)


# ---- pipelines

@dataclass(frozen=True)
class Checkpoint:
    """State is exactly once in either mode: Spark commits a micro-batch's offsets and state together."""

    interval: str = "10 seconds"
    location: str | None = None
    mode: str = "exactly-once"

    def __post_init__(self):
        if self.mode not in ("exactly-once", "at-least-once"):
            raise DefinitionError(f"checkpoint mode {self.mode!r}")


MODES = ("streaming", "batch")


@dataclass(frozen=True)
class Pipeline:
    """Sinks with all that they read. ``state_ttl`` holds for stream joins and deduplications without one of their own,
    ``restart`` for run_streams, and ``spark`` has session settings."""

    name: str
    sinks: tuple[Node, ...]
    mode: str = "streaming"
    parallelism: int | None = None
    checkpoint: Checkpoint | None = None
    state_backend: str = "rocksdb"
    state_ttl: str | None = None
    restart: Any = None
    output_mode: str = "append"
    integer_division: bool = False
    compat: bool = True
    spark: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.name:
            raise DefinitionError("a pipeline needs a name")
        if self.mode not in MODES:
            raise DefinitionError(f"mode {self.mode!r}; one of {', '.join(MODES)}")
        if self.parallelism is not None and self.parallelism < 1:
            raise DefinitionError("parallelism is at least 1")

    def nodes(self) -> dict[str, Node]:
        return identify(self.sinks)


# ---- trees

def walk(roots: tuple[Node, ...] | list[Node], below: Callable[[Node], list[Node]] | None = None) -> Iterator[Node]:
    """Every node once, inputs (``below``) before those that read them."""
    below = below or sources_of
    seen: set[int] = set()
    open_: set[int] = set()
    stack: list[tuple[Node, bool]] = [(r, False) for r in reversed(roots)]
    while stack:
        node, done = stack.pop()
        if done:
            open_.discard(id(node))
            if id(node) not in seen:
                seen.add(id(node))
                yield node
        elif id(node) not in seen:
            if id(node) in open_:
                raise DefinitionError(f"a cycle through {node.component}")
            open_.add(id(node))
            stack.append((node, True))
            stack += [(i, False) for i in reversed(below(node))]


def sources_of(node: Node) -> list[Node]:
    """Inputs, the table of a lookup among them."""
    extra = [node.table] if isinstance(node, LookupJoin) and isinstance(node.table, Node) else []
    return [*node.inputs, *extra]


def identify(roots) -> dict[str, Node]:
    """Nodes by id: the name or component with other characters as _, and _2 and so on where that is taken."""
    out: dict[str, Node] = {}
    for node in walk(list(roots)):
        base = re.sub(r"[^A-Za-z0-9_]", "_", node.name or node.component).strip("_") or node.component
        key, k = base, 1
        while key in out:
            k += 1
            key = f"{base}_{k}"
        out[key] = node
    return out


def rebuild(roots: list[Node], change: Callable[[Node], Node]) -> list[Node]:
    """The same graph with every node changed, inputs first; shared nodes stay shared."""
    made: dict[int, Node] = {}
    for node in walk(roots):
        inputs = tuple(made[id(i)] for i in node.inputs)
        fresh = node if all(a is b for a, b in zip(inputs, node.inputs, strict=True)) else dataclasses.replace(node, inputs=inputs)
        if isinstance(fresh, LookupJoin) and isinstance(fresh.table, Node):
            fresh = dataclasses.replace(fresh, table=made[id(node.table)])
        made[id(node)] = change(fresh)
    return [made[id(r)] for r in roots]


def find(roots: list[Node], wanted: Callable[[Node], bool]) -> list[Node]:
    return [n for n in walk(roots) if wanted(n)]


def replace(roots: list[Node], wanted: Callable[[Node], bool], by: Callable[[Node], Node]) -> list[Node]:
    return rebuild(roots, lambda n: by(n) if wanted(n) else n)


def wrap(roots: list[Node], wanted: Callable[[Node], bool], around: Callable[[Node], Node]) -> list[Node]:
    """A node that reads the wanted one takes its place."""
    return rebuild(roots, lambda n: n.via(around(n)) if wanted(n) else n)


def rekind(roots: list[Node], wanted: Callable[[Node], bool], to: type[Node]) -> list[Node]:
    """The wanted nodes as another component, with the properties that it shares."""
    names = {f.name for f in dataclasses.fields(to)}
    return rebuild(roots, lambda n: to(**{f.name: getattr(n, f.name) for f in dataclasses.fields(n) if f.name in names}) if wanted(n) else n)
