"""Stateful stream operators: windows with late output and retraction, ordered deduplication, and custom processors.

They are ``StatefulProcessor`` classes for transformWithStateInPandas: state is keyed, lives in RocksDB on executors,
and is snapshotted with the checkpoint. Timers on the watermark free it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import duration_ms, interval

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """transformWithState runs on this store only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def timed(df: DataFrame, column: str) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks ask for."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


class LateWindows(StatefulProcessor):
    """Counts and sums per key and tumbling window. Rows whose window ended more than the lateness ago go out as
    ``late``; a window that changes after it was emitted goes out as a pair ``-`` (old) and ``+`` (new)."""

    def __init__(self, size_ms: int, lateness_ms: int, ts: str, value: str | None):
        self.size, self.lateness, self.ts, self.value_column = size_ms, lateness_ms, ts, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # per window: rows and sum now, and what was last emitted (-1 rows: nothing yet)
        self.windows = handle.getMapState("windows", "start bigint", "n bigint, total double, said_n bigint, said_total double")

    def row(self, key, op, start, n, total, value=None) -> dict:
        return {"key": key, "op": op, "window_start": pd.Timestamp(start, unit="ms"), "window_end": pd.Timestamp(start + self.size, unit="ms"), "n": n, "total": total, "late_value": value}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, out, changed = timerValues.getCurrentWatermarkInMs(), [], set()
        for pdf in rows:
            times = pdf[self.ts].tolist()
            values = pdf[self.value_column].astype("float64").tolist() if self.value_column else [0.0] * len(pdf)
            for at, value in zip(times, values, strict=True):
                start = at - at % self.size
                if mark > 0 and start + self.size + self.lateness <= mark:
                    out.append(self.row(key[0], "late", start, 1, value, value))
                    continue
                state = self.windows.getValue((start,)) if self.windows.containsKey((start,)) else (0, 0.0, -1, 0.0)
                self.windows.updateValue((start,), (state[0] + 1, state[1] + value, state[2], state[3]))
                self.handle.registerTimer(start + self.size)
                self.handle.registerTimer(start + self.size + self.lateness)
                if mark > 0 and start + self.size <= mark:
                    changed.add(start)
        # a window that had ended is corrected once per micro-batch
        for start in sorted(changed):
            out += self.emit(key[0], start)
        yield pd.DataFrame(out, columns=OUT)

    def emit(self, key, start) -> list[dict]:
        n, total, said_n, said_total = self.windows.getValue((start,))
        if (n, total) == (said_n, said_total):
            return []
        self.windows.updateValue((start,), (n, total, n, total))
        old = [self.row(key, "-", start, said_n, said_total)] if said_n >= 0 else []
        return [*old, self.row(key, "+", start, n, total)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        for (start,) in sorted(self.windows.keys()):
            if start + self.size <= mark:
                out += self.emit(key[0], start)
            if start + self.size + self.lateness <= mark:
                self.windows.removeKey((start,))
        yield pd.DataFrame(out, columns=OUT)

    def close(self) -> None:
        pass


OUT = ["key", "op", "window_start", "window_end", "n", "total", "late_value"]


def late_windows(df: DataFrame, key: str, ts: str, size: str, lateness: str, delay: str = "0 seconds", value: str | None = None) -> DataFrame:
    """A changelog of tumbling windows with rows op = + and -, and late for rows that came after all lateness."""
    use_rocksdb(df.sparkSession)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("op", T.StringType()), T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("late_value", T.DoubleType())])
    # the processor gets event time as a plain column: Spark drops late rows by the watermark's own column, but here they
    # are output
    stream = timed(df, ts).withWatermark(ts, interval(delay)).withColumn("at_ms", F.unix_millis(ts)).drop(ts)
    return stream.groupBy(key).transformWithStateInPandas(LateWindows(duration_ms(size), duration_ms(lateness), "at_ms", value), schema, "Update", "EventTime")


class Latest(StatefulProcessor):
    """The first or last row per key by an order column; a row goes out whenever it replaces the one before. State
    older than the time to live is forgotten."""

    def __init__(self, order: str, keep: str, columns: list[str], state: str, ttl_ms: int | None):
        self.order, self.keep, self.columns, self.state, self.ttl = order, keep, columns, state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.state, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, fresh = (self.held.get() if self.held.exists() else None), False
        place = self.columns.index(self.order)
        for pdf in rows:
            for row in pdf[self.columns].itertuples(index=False, name=None):
                now, old = row[place], best[place] if best is not None else None
                # times come back from state without a zone, in UTC
                now, old = (x.tz_localize(None) if getattr(x, "tzinfo", None) else pd.Timestamp(x) if hasattr(x, "isoformat") else x for x in (now, old))
                if best is None or (now > old if self.keep == "last" else now < old):
                    best, fresh = row, True
        if fresh:
            self.held.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in best))
            yield pd.DataFrame([best], columns=self.columns)
        else:
            yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def deduplicate_stream(df: DataFrame, keys: list[str], order: str, keep: str = "first", within: str | None = None) -> DataFrame:
    """Updates of the row to keep per key, by order and not by arrival; ``within`` is the state's time to live."""
    use_rocksdb(df.sparkSession)
    state = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    processor = Latest(order, keep, df.columns, state, duration_ms(within) if within else None)
    return df.groupBy(*keys).transformWithStateInPandas(processor, df.schema, "Update", "ProcessingTime" if within else "None")


def deduplicate_within(df: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """The first row to arrive per key; a key is forgotten once the watermark has passed it by ``within``."""
    return timed(df, ts).withWatermark(ts, interval(within)).dropDuplicatesWithinWatermark(keys)


class Folded(StatefulProcessor):
    """Reducing state: one value per key, folded over its rows. ``step`` takes the value (None at first) and a frame of
    rows, and gives the new value and the rows to emit."""

    def __init__(self, step: Callable, state: str, columns: list[str]):
        self.step, self.state, self.columns = step, state, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value = self.value.get() if self.value.exists() else None
        for pdf in rows:
            value, out = self.step(key, value, pdf)
            if len(out):
                yield out[self.columns]
        if value is not None:
            self.value.update(value)

    def close(self) -> None:
        pass


def fold(df: DataFrame, keys: list[str], step: Callable, state: str, schema: T.StructType) -> DataFrame:
    """A custom stateful operator from one function."""
    use_rocksdb(df.sparkSession)
    return df.groupBy(*keys).transformWithStateInPandas(Folded(step, state, schema.names), schema, "Update", "None")
