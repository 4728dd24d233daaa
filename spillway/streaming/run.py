"""Running streams: triggers, checkpoints, restarts, sinks per micro-batch, and progress."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.sql import run as run_sql
from ..schema import duration_ms, interval
from ..storage import new_root, remove

MODES = ("append", "update", "complete")


@dataclass(frozen=True)
class Restart:
    """fixed-delay: up to ``attempts`` restarts, ``delay`` apart. failure-rate: while at most ``attempts`` failures fall
    within ``window``. no-restart: the first failure is final."""

    kind: str = "no-restart"
    attempts: int = 3
    delay: str = "10 seconds"
    window: str = "5 minutes"

    def __post_init__(self):
        if self.kind not in ("fixed-delay", "failure-rate", "no-restart"):
            raise ValueError(f"restart strategy {self.kind!r}")


@dataclass
class Supervisor:
    """Starts a query again after failures. It resumes from its checkpoint, so nothing is lost or counted twice."""

    start: Callable[[], StreamingQuery]
    restart: Restart = field(default_factory=Restart)
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic

    def run(self) -> int:
        """Until the query ends well; the number of restarts."""
        failures: deque[float] = deque()
        restarts = 0
        while True:
            try:
                self.start().awaitTermination()
                return restarts
            except Exception:
                failures.append(self.clock())
                if self.restart.kind == "no-restart":
                    raise
                if self.restart.kind == "failure-rate":
                    while failures and failures[0] < self.clock() - duration_ms(self.restart.window) / 1000:
                        failures.popleft()
                if len(failures) > self.restart.attempts:
                    raise
                restarts += 1
                self.sleep(duration_ms(self.restart.delay) / 1000)


def trigger(options: str | None) -> dict:
    """"available-now", "once", or an interval; None: as fast as possible."""
    if options is None:
        return {"processingTime": "0 seconds"}
    if options in ("available-now", "once"):
        return {"availableNow": True}
    return {"processingTime": interval(options)}


def start(df: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None, mode: str = "append", every: str | None = "available-now", name: str | None = None, form: str | None = None, options: dict | None = None) -> StreamingQuery:
    """One query into a function of (micro-batch, its number), which may come again with the same number after a
    failure, or into a format of Spark's (memory, parquet, console, kafka)."""
    if mode not in MODES:
        raise ValueError(f"output mode {mode!r}")
    writer = df.writeStream.outputMode(mode).trigger(**trigger(every))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if sink is not None:
        return writer.foreachBatch(sink).start()
    return writer.format(form or "memory").options(**(options or {})).start()


class Kept:
    """For ``start``: a table that micro-batches add to, in files of the shared folder; no row comes to the driver. A
    batch that comes again replaces what it added before. ``whole``: each batch is the whole result, as in complete mode;
    the one before it stays for those who still read it. With the schema the table is there, empty, before any batch."""

    def __init__(self, spark: SparkSession, name: str, whole: bool = False, schema: T.StructType | None = None):
        self.spark, self.name, self.whole, self.batches = spark, name, whole, []
        root = new_root(spark, "stream")
        self.rows, self.checkpoint = f"{root}/rows", f"{root}/checkpoint"
        if schema is not None:
            spark.createDataFrame([], schema).createOrReplaceTempView(name)

    def __call__(self, df: DataFrame, batch: int) -> None:
        # files have neither repeated names nor columns without a type
        void = [isinstance(f.dataType, T.NullType) for f in df.schema]
        plain = df.toDF(*(f"c{k}" for k in range(len(void))))
        plain = plain.select(*[F.col(c).cast("string") if v else F.col(c) for c, v in zip(plain.columns, void, strict=True)])
        plain.write.mode("overwrite").parquet(f"{self.rows}/{batch}")
        self.batches = [*(b for b in self.batches if b != batch), batch]
        read = self.spark.read.schema(plain.schema).option("recursiveFileLookup", "true").parquet(f"{self.rows}/{batch}" if self.whole else self.rows)
        read = read.select(*[F.lit(None).alias(c) if v else F.col(c) for c, v in zip(read.columns, void, strict=True)])
        read.toDF(*df.columns).createOrReplaceTempView(self.name)
        while self.whole and len(self.batches) > 2:
            remove(self.spark, f"{self.rows}/{self.batches.pop(0)}")


def collect(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a finite stream gives, as a table in files of the shared folder."""
    kept = Kept(df.sparkSession, name, mode == "complete", df.schema)
    query = start(df, kept, checkpoint or kept.checkpoint, mode, name=name)
    query.awaitTermination()
    # nothing resumes from here
    remove(df.sparkSession, kept.checkpoint)
    return df.sparkSession.table(name)


def micro_batch_sql(sql: str, sink: Callable[[DataFrame, int], None], view: str = "input") -> Callable[[DataFrame, int], None]:
    """For ``start``: runs a statement over each micro-batch, which is the table ``input``, and passes rows on."""

    def run(df: DataFrame, batch: int) -> None:
        sink(run_sql(df.sparkSession, sql, {view: df}), batch)

    return run


def routed(branches: Callable[[DataFrame], list[DataFrame]], sinks: list[Callable[[DataFrame, int], None] | None]) -> Callable[[DataFrame, int], None]:
    """For ``start``: one read of the source feeds all branches; None drops a branch's rows."""

    def run(df: DataFrame, batch: int) -> None:
        kept = df.persist()
        try:
            for branch, sink in zip(branches(kept), sinks, strict=True):
                if sink is not None:
                    sink(branch, batch)
        finally:
            kept.unpersist()

    return run


class LookupCache:
    """A static table that is read again when older than its time to live; an older one counts as a miss. A table of
    more than ``max_rows`` rows isn't kept: it is read each time. Call it for each micro-batch."""

    def __init__(self, load: Callable[[], DataFrame], ttl: str, max_rows: int | None = None, clock: Callable[[], float] = time.monotonic):
        self.load, self.ttl, self.max_rows, self.clock = load, duration_ms(ttl) / 1000, max_rows, clock
        self.table, self.at, self.loads = None, 0.0, 0

    def __call__(self) -> DataFrame:
        if self.table is not None and self.clock() - self.at < self.ttl:
            return self.table
        if self.table is not None:
            self.table.unpersist()
            self.table = None
        table = self.load()
        self.loads += 1
        if self.max_rows is not None and table.limit(self.max_rows + 1).count() > self.max_rows:
            return table
        self.table, self.at = table.persist(), self.clock()
        return self.table


class Metrics(StreamingQueryListener):
    """Rows, batches, latency and watermark of each query, and its failure, from Spark's progress events."""

    #: Upper ends of the latency buckets, in milliseconds: a micro-batch takes tens of them at least.
    BUCKETS = (20, 50, 100, 200, 500, 1_000, 2_000, 5_000, 20_000, 60_000)

    def __init__(self):
        self.queries: dict[str, dict] = {}

    def of(self, run: str) -> dict:
        return self.queries.setdefault(run, {"rows": 0, "batches": 0, "latency": dict.fromkeys((*self.BUCKETS, float("inf")), 0), "watermark": None, "error": None, "ended": False})

    def onQueryStarted(self, event) -> None:
        self.of(str(event.id))

    def onQueryProgress(self, event) -> None:
        said, p = self.of(str(event.progress.id)), event.progress
        said["rows"] += p.numInputRows
        said["batches"] += 1
        took = p.batchDuration
        said["latency"][next((b for b in self.BUCKETS if took <= b), float("inf"))] += 1
        said["watermark"] = dict(p.eventTime or {}).get("watermark", said["watermark"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.of(str(event.id)).update(error=event.exception, ended=True)


def configure(spark: SparkSession, state: str = "rocksdb", watermark: str = "min", parallelism: int | None = None) -> None:
    """Session settings of a pipeline: state store, policy for several watermarks (max keeps an idle input from holding
    the others back), shuffle partitions (fixed by a checkpoint once it exists)."""
    stores = {"rocksdb": "RocksDBStateStoreProvider", "pebble": "RocksDBStateStoreProvider", "memory": "HDFSBackedStateStoreProvider"}
    if state not in stores:
        raise ValueError(f"state backend {state!r}; one of {', '.join(stores)}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", f"org.apache.spark.sql.execution.streaming.state.{stores[state]}")
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", watermark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if parallelism:
        spark.conf.set("spark.sql.shuffle.partitions", str(parallelism))
