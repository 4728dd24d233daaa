"""Aggregation, deduplication, top-n and windows over event time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import Dialect, column
from ..schema import duration_ms, interval

START, END = "window_start", "window_end"


@dataclass(frozen=True)
class Span:
    """Half-open event-time windows aligned to the epoch: tumbling (size), sliding (size, slide) or session (gap)."""

    kind: str
    on: str
    size: str | int
    slide: str | int | None = None

    def column(self) -> Column:
        if self.kind == "session":
            return F.session_window(self.on, interval(self.size))
        if self.slide is None:
            return F.window(self.on, interval(self.size))
        return F.window(self.on, interval(self.size), interval(self.slide))

    def __post_init__(self):
        if self.kind not in ("tumble", "slide", "session"):
            raise ValueError(f"window {self.kind!r}")
        if duration_ms(self.size) <= 0 or (self.slide is not None and duration_ms(self.slide) <= 0):
            raise ValueError("a window's size and slide are positive")


def bounded(df: DataFrame, span: Span) -> DataFrame:
    """Rows with window_start and window_end; a row is repeated for each sliding window that holds it.

    Sessions are merged per call without a key here; give keys to ``sessions``.
    """
    if span.kind == "session":
        return sessions(df, span, [])
    return df.withColumn("__w", span.column()).select("*", F.col("__w.start").alias(START), F.col("__w.end").alias(END)).drop("__w")


def sessions(df: DataFrame, span: Span, keys: list[str]) -> DataFrame:
    """Rows of a batch with the bounds of their session: it goes on while a gap is not exceeded, and ends a gap after
    its last row. With keys that is one shuffle and a running count of gaps. Without, sessions come from the session
    aggregation, whose partial merge bounds the shuffle, and rows, which stay where they are, look up theirs."""
    if df.isStreaming:
        raise ValueError("rows of open sessions aren't known on a stream; aggregate them")
    if keys:
        gap, rows = F.expr(f"INTERVAL '{interval(span.size)}'"), Window.partitionBy(*keys).orderBy(span.on)
        fresh = F.when(F.lag(span.on).over(rows) + gap >= F.col(span.on), 0).otherwise(1)
        counted = df.where(F.col(span.on).isNotNull()).withColumn("__fresh", fresh).withColumn("__session", F.sum("__fresh").over(rows.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        whole = Window.partitionBy(*keys, "__session")
        return counted.withColumn(START, F.min(span.on).over(whole)).withColumn(END, F.max(span.on).over(whole) + gap).drop("__fresh", "__session")
    found = df.groupBy(span.column().alias("__w")).agg(F.lit(1).alias("__one")).select(F.col("__w.start").alias(START), F.col("__w.end").alias(END))
    return df.join(found, (F.col(span.on) >= F.col(START)) & (F.col(span.on) < F.col(END)))


def aggregate(df: DataFrame, keys: list[str], select: dict[str, str], span: Span | None = None, dialect: Dialect = Dialect()) -> DataFrame:
    """Keys first (then the window's bounds), then the aggregates; ``k: "k"`` for a key is that key."""
    outputs = {n: e for n, e in select.items() if not (n in keys and e.strip("` ") == n)}
    groups: list[Column | str] = list(keys)
    if span is not None:
        groups.append(span.column().alias("__w"))
    made = [column(e, dialect, df).alias(n) for n, e in outputs.items()]
    out = df.groupBy(*groups).agg(*made) if made else df.select(*groups).distinct()
    if span is None:
        return out
    return out.select(*keys, F.col("__w.start").alias(START), F.col("__w.end").alias(END), *outputs)


def ordering(order: dict[str, str] | str) -> list[Column]:
    """{"column": "ASC" or "DESC"} or "column DESC, other"; nulls come first upwards and last downwards."""
    if isinstance(order, str):
        parts = [p.split() for p in order.split(",")]
        order = {p[0]: p[1] if len(p) > 1 else "ASC" for p in parts}
    for way in order.values():
        if way.upper() not in ("ASC", "DESC"):
            raise ValueError(f"order {way!r}")
    return [F.col(c).desc() if way.upper() == "DESC" else F.col(c).asc() for c, way in order.items()]


def reversed_order(order: dict[str, str] | str) -> dict[str, str]:
    if isinstance(order, str):
        order = {p.split()[0]: (p.split() + ["ASC"])[1] for p in order.split(",")}
    return {c: "ASC" if way.upper() == "DESC" else "DESC" for c, way in order.items()}


def top(df: DataFrame, keys: list[str], order: dict[str, str] | str, n: int = 10, rank_column: str | None = None) -> DataFrame:
    """The first n rows per key. Spark limits groups before the shuffle, so a hot key sends n rows per task."""
    if n <= 0:
        raise ValueError("n is positive")
    rank = rank_column or "__rank"
    window = Window.partitionBy(*keys).orderBy(*ordering(order)) if keys else Window.orderBy(*ordering(order))
    out = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
    return out if rank_column else out.drop(rank)


def orderable(kind: T.DataType) -> bool:
    """Whether Spark can order values of this type: anything but maps, at any depth."""
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def deduplicate(df: DataFrame, keys: list[str], order: dict[str, str] | str, keep: str = "first") -> DataFrame:
    """One row per key, the first or last by order. Spark limits groups before the shuffle, so a hot key sends a row per
    task; of rows that tie, all orderable columns decide, so that the result doesn't depend on partitions."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep {keep!r}")
    by = ordering(order if keep == "first" else reversed_order(order))
    return top_one(df, keys, by)


def top_one(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    ties = [F.col(f"`{f.name}`").asc() for f in df.schema.fields if orderable(f.dataType) and f.name not in keys]
    window = Window.partitionBy(*keys).orderBy(*by, *ties)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")
