"""Windows that go on taking rows after their end: corrections as retractions, and rows that are too late as output.

The changelog has a column ``op``: ``+`` a window's result, ``-`` one that no longer holds, ``late`` a row that came after
all lateness, as the result that it would have made alone. A window's first result comes once the watermark passes its
end; a row within the allowed lateness corrects it. Summing up ``+`` and ``-`` gives the windows as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import Dialect, column
from ..operators.grouping import END, START, Span
from ..schema import duration_ms
from .state import use_rocksdb

CALL = re.compile(r"\s*(COUNT|SUM|MIN|MAX|AVG)\s*\((.*)\)\s*", re.IGNORECASE | re.DOTALL)
OP = "op"


@dataclass
class Total:
    """What all five functions need of the values that came: nulls don't count."""

    n: int = 0
    total: float | int = 0
    low: float | int | None = None
    high: float | int | None = None

    def add(self, other: Total) -> None:
        if other.n:
            self.low = other.low if self.low is None else min(self.low, other.low)
            self.high = other.high if self.high is None else max(self.high, other.high)
            self.n, self.total = self.n + other.n, self.total + other.total

    def result(self, func: str):
        if func == "COUNT":
            return self.n
        if not self.n:
            return None
        return {"SUM": self.total, "AVG": self.total / self.n, "MIN": self.low, "MAX": self.high}[func]


@dataclass
class Open:
    """A window in the state; said: whether its result went out, and what that was."""

    end: int
    totals: list[Total]
    said: bool = False
    result: list = field(default_factory=list)


class LateTotals(StatefulProcessor):
    def __init__(self, span: Span, lateness: int, funcs: list[str], kinds: list[str], columns: list[str]):
        self.kind, self.size = span.kind, duration_ms(span.size)
        self.slide = duration_ms(span.slide) if span.slide is not None else self.size
        self.lateness, self.funcs, self.kinds, self.columns = lateness, funcs, kinds, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        results = [{"COUNT": "bigint", "AVG": "double"}.get(f, k) for f, k in zip(self.funcs, self.kinds, strict=True)]
        fields = [f"n{i} bigint, t{i} {k}, l{i} {k}, h{i} {k}, r{i} {r}" for i, (k, r) in enumerate(zip(self.kinds, results, strict=True))]
        self.windows = handle.getMapState("windows", "start bigint", ", ".join(["ending bigint", "said boolean", *fields]))

    def read(self) -> dict[int, Open]:
        out = {}
        for (start,), value in self.windows.iterator():
            parts = [value[2 + 5 * i : 7 + 5 * i] for i in range(len(self.funcs))]
            out[start] = Open(value[0], [Total(*p[:4]) for p in parts], value[1], [p[4] for p in parts])
        return out

    def write(self, start: int, w: Open) -> None:
        results = w.result or [None] * len(w.totals)
        flat = [x for t, r in zip(w.totals, results, strict=True) for x in (t.n, t.total, t.low, t.high, r)]
        self.windows.updateValue((start,), (w.end, w.said, *flat))

    def row(self, key: tuple, op: str, start: int, end: int, result: list) -> tuple:
        return (*key, op, pd.Timestamp(start, unit="ms"), pd.Timestamp(end, unit="ms"), *result)

    def results(self, totals: list[Total]) -> list:
        return [t.result(f) for t, f in zip(totals, self.funcs, strict=True)]

    def places(self, at: int) -> list[tuple[int, int]]:
        """Windows of a row, whether they are open or not."""
        if self.kind == "session":
            return [(at, at + self.size)]
        last = at - at % self.slide
        return [(s, s + self.size) for s in range(last, at - self.size, -self.slide)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, live, out, changed = timerValues.getCurrentWatermarkInMs(), self.read(), [], set()
        for pdf in rows:
            # COUNT(*) has no column; names that begin with _ would be lost on the way
            values = [pdf[f"row_arg{i}"].tolist() if f"row_arg{i}" in pdf else [1] * len(pdf) for i in range(len(self.funcs))]
            for at, *row in zip(pdf["row_at"].tolist(), *values, strict=True):
                # whole numbers come as floats where some are missing
                row = [None if v is None or v != v else int(v) if k == "bigint" else v for v, k in zip(row, self.kinds, strict=True)]
                ones = [Total() if v is None else Total(1, v, v, v) for v in row]
                late = []
                for start, end in self.places(at):
                    if self.kind == "session":
                        start, end, more = self.joined(key, start, end, live)
                        out += more
                    if start not in live and mark > 0 and end + self.lateness <= mark:
                        late.append(self.row(key, "late", start, end, self.results(ones)))
                        continue
                    w = live.setdefault(start, Open(end, [Total() for _ in self.funcs]))
                    w.end = max(w.end, end)
                    for total, one in zip(w.totals, ones, strict=True):
                        total.add(one)
                    changed.add(start)
                # of sliding windows, those still open have the row
                out += late if len(late) == len(self.places(at)) else []
        for start in sorted(changed & live.keys()):
            w = live[start]
            if mark > 0 and w.end <= mark:
                out += self.corrected(key, start, w)
            self.write(start, w)
            self.handle.registerTimer(w.end)
            self.handle.registerTimer(w.end + self.lateness)
        yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def joined(self, key, start: int, end: int, live: dict[int, Open]) -> tuple[int, int, list]:
        """A session with all that it touches; results of those that end in it are taken back."""
        touched, out = [s for s, w in live.items() if s <= end and start <= w.end], []
        if not touched:
            return start, end, out
        whole = Open(max(end, *(live[s].end for s in touched)), [Total() for _ in self.funcs])
        for s in touched:
            w = live.pop(s)
            if w.said:
                out.append(self.row(key, "-", s, w.end, w.result))
            for total, more in zip(whole.totals, w.totals, strict=True):
                total.add(more)
            self.windows.removeKey((s,))
        first = min(start, *touched)
        live[first] = whole
        return first, whole.end, out

    def corrected(self, key, start: int, w: Open) -> list[tuple]:
        now = self.results(w.totals)
        if w.said and now == w.result:
            return []
        old = [self.row(key, "-", start, w.end, w.result)] if w.said else []
        w.said, w.result = True, now
        return [*old, self.row(key, "+", start, w.end, now)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        for start, w in sorted(self.read().items()):
            if w.end <= mark and not w.said:
                out += self.corrected(key, start, w)
                self.write(start, w)
            if w.end + self.lateness <= mark:
                self.windows.removeKey((start,))
        yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def late_aggregate(df: DataFrame, keys: list[str], span: Span, select: dict[str, str], lateness: str, dialect: Dialect = Dialect()) -> DataFrame:
    """Changelog of a stream with a watermark: op, keys, window bounds and the aggregates, which are COUNT, SUM, MIN, MAX
    or AVG of a number. Without keys all rows are one key."""
    use_rocksdb(df.sparkSession)
    outputs = {n: e for n, e in select.items() if not (n in keys and e.strip("` ") == n)}
    funcs, kinds, made, fields = [], [], [], []
    for k, (name, text) in enumerate(outputs.items()):
        m = CALL.fullmatch(text)
        if not m:
            raise ValueError(f"with lateness an aggregate is COUNT, SUM, MIN, MAX or AVG, not {text!r}")
        value = F.lit(1) if m[2].strip() == "*" else column(m[2], dialect, df)
        func, of = m[1].upper(), df.select(value.alias("x")).schema["x"].dataType
        whole = isinstance(of, T.IntegralType) or func == "COUNT"
        if func == "COUNT":
            value = F.when(value.isNotNull(), 1)
        funcs.append(func)
        kinds.append("bigint" if whole else "double")
        if m[2].strip() != "*":
            made.append(value.cast(kinds[-1]).alias(f"row_arg{k}"))
        fields.append(T.StructField(name, T.LongType() if func == "COUNT" or whole and func != "AVG" else T.DoubleType()))
    by = keys or ["__all"]
    source = df if keys else df.withColumn("__all", F.lit(0))
    stream = source.where(F.col(span.on).isNotNull()).select(*by, F.unix_millis(F.col(span.on).cast("timestamp")).alias("row_at"), *made)
    bounds = [T.StructField(c, T.TimestampType()) for c in (START, END)]
    schema = T.StructType([*(T.StructField(k, stream.schema[k].dataType) for k in by), T.StructField(OP, T.StringType()), *bounds, *fields])
    processor = LateTotals(span, duration_ms(lateness), funcs, kinds, schema.names)
    out = stream.groupBy(*by).transformWithStateInPandas(processor, schema, "Update", "EventTime")
    return out.select(OP, *keys, START, END, *outputs)
