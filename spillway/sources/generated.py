"""Generated rows: a sequence shaped by a schema, and event streams of public benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Schema
from .external import stream_path

DEFAULT_RATE = 1000


def generated_column(name: str, kind: T.DataType, i: Column) -> Column:
    """Value of row i: the number itself, i * 1.1, "name_i", whether i is even, or the time plus i milliseconds; null
    for other types."""
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return i.cast(kind)
    if isinstance(kind, T.DoubleType):
        return i.cast("double") * F.lit(1.1)
    if isinstance(kind, T.StringType):
        return F.concat(F.lit(f"{name}_"), i.cast("string"))
    if isinstance(kind, T.BooleanType):
        return i % 2 == 0
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_millis(F.unix_millis(F.current_timestamp()) + i).cast(kind)
    return F.lit(None).cast(kind)


def generate(spark: SparkSession, schema: Schema, rows_per_second: int = DEFAULT_RATE, max_rows: int = 0, streaming: bool = False) -> DataFrame:
    """Rows 0, 1, ... of a schema. A batch needs max_rows; a stream makes rows_per_second (below 1: the default) and,
    with max_rows, only so many."""
    rate = rows_per_second if rows_per_second > 0 else DEFAULT_RATE
    if streaming:
        base = spark.readStream.format("rate").option("rowsPerSecond", rate).load().select("value")
        if max_rows:
            base = base.where(F.col("value") < max_rows)
    else:
        if max_rows <= 0:
            raise ValueError("a batch of generated rows needs max_rows")
        base = spark.range(max_rows).select(F.col("id").alias("value"))
    made = base.select(*[generated_column(n, t, F.col("value")).alias(n) for n, t in schema.fields.items()])
    return schema.watermarked(made)


# Event types of the ad benchmark and their weights in a hundred.
AD_EVENTS = (("view", 80), ("click", 15), ("purchase", 5))
STATES = ("OR", "ID", "CA", "WA", "NY", "TX")


def draw(i: Column, salt: int, n: int) -> Column:
    """A number below n that only i and salt decide."""
    return F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n))


def ad_events(spark: SparkSession, rows: int, campaigns: int = 100, seed: int = 42, start_ms: int = 1_704_067_200_000) -> DataFrame:
    """Ad events, a millisecond apart: ad_id, ad_type, event_type (weighted), event_time, ip_address."""
    i = F.col("id")
    u, kind, edge = draw(i, seed, 100), F.lit(None).cast("string"), 100
    for name, weight in reversed(AD_EVENTS):
        kind = F.when(u < edge, F.lit(name)).otherwise(kind)
        edge -= weight
    ad = draw(i, seed + 1, campaigns * 10)
    return spark.range(rows).select(
        F.concat(F.lit("ad_"), ad).alias("ad_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("banner", "modal", "mail")]), (draw(i, seed + 2, 3) + 1).cast("int")).alias("ad_type"),
        kind.alias("event_type"),
        (F.lit(start_ms) + i).alias("event_time"),
        F.concat_ws(".", F.lit("10"), draw(i, seed + 3, 256), draw(i, seed + 4, 256), draw(i, seed + 5, 256)).alias("ip_address"),
    )


def auction_events(spark: SparkSession, rows: int, seed: int = 42, disorder_ms: int = 4_000, start_ms: int = 1_704_067_200_000) -> dict[str, DataFrame]:
    """Persons, auctions and bids of an online auction, 5, 10 and 85 in a hundred, with bounded disorder in time."""
    i = F.col("id")
    base = spark.range(rows).select(i, draw(i, seed, 100).alias("u"), F.timestamp_millis(F.lit(start_ms) + i * 10 - draw(i, seed + 1, disorder_ms)).cast("timestamp_ntz").alias("ts"))
    people, auctions = max(1, rows // 20), max(1, rows // 10)
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (draw(i, seed + 2, len(STATES)) + 1).cast("int"))
    return {
        "person": base.where("u < 5").select(i.alias("id"), F.concat(F.lit("person_"), i).alias("name"), state.alias("state"), "ts"),
        "auction": base.where("u >= 5 AND u < 15").select(i.alias("id"), draw(i, seed + 3, people).alias("seller"), draw(i, seed + 4, 10).alias("category"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires"), "ts"),
        "bid": base.where("u >= 15").select(draw(i, seed + 5, auctions).alias("auction"), draw(i, seed + 6, people).alias("bidder"), (draw(i, seed + 7, 10_000) + 1).alias("price"), "ts"),
    }


TPCH_STREAMS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def table_streams(spark: SparkSession, folder: str, tables=TPCH_STREAMS) -> dict[str, DataFrame]:
    """Tables as append-only streams: each file that arrives is read once."""
    return {t: spark.readStream.schema(spark.read.parquet(f"{folder}/{t}.parquet").schema).parquet(stream_path(spark, f"{folder}/{t}.parquet")) for t in tables}
