"""Sinks for batches, and for each micro-batch of a stream."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.external import encode, kafka_available

# ---- console


def cell(value, kind: T.DataType) -> str:
    """NULL, four decimals for floats, lower-case booleans."""
    if value is None:
        return "NULL"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"{value:.4f}" if math.isfinite(value) else str(value)
    if isinstance(kind, T.BooleanType):
        return str(value).lower()
    return str(value)


def console_table(df: DataFrame, max_rows: int = 0) -> str:
    """Rows as a table with columns as wide as their widest cell; beyond max_rows only their number. All rows come to
    the driver if max_rows is 0, so leave that to small results."""
    rows = df.limit(max_rows).collect() if max_rows > 0 else df.collect()
    more = df.count() - len(rows) if max_rows > 0 and len(rows) == max_rows else 0
    cells = [[cell(v, f.dataType) for v, f in zip(row, df.schema.fields, strict=True)] for row in rows]
    widths = [max([len(c), *(len(r[k]) for r in cells)]) for k, c in enumerate(df.columns)]
    line = lambda values: "| " + " | ".join(v.ljust(w) for v, w in zip(values, widths, strict=True)) + " |"
    out = [line(df.columns), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, cells)]
    if more:
        out.append(f"... ({more} more rows)")
    return "\n".join(out)


def write_console(df: DataFrame, max_rows: int = 0, out: Callable[[str], None] = print) -> None:
    out(console_table(df, max_rows))


# ---- files


def write_files(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None, single: bool = False, mode: str = "overwrite") -> None:
    """Files below path, in Hive folders per partition value, or one file (for small results). Rows of a partition are
    brought together first, split where they are many, so that tasks don't each open every folder."""
    if single:
        df = df.coalesce(1)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(form)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def upsert_files(df: DataFrame, path: str, keys: list[str], order: str | None = None) -> None:
    """Newest row per key of what is there and what comes, written beside and then swapped in; repeating it changes
    nothing. ``order`` says which of two rows is newer; without it the coming one."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    coming = df.withColumn("__new", F.lit(1))
    if store.exists(where):
        coming = spark.read.parquet(path).withColumn("__new", F.lit(0)).unionByName(coming)
    from ..operators.grouping import top_one

    by = [F.col(order).desc()] if order else []
    rows = top_one(coming, keys, [*by, F.col("__new").desc()]).drop("__new")
    beside, old = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path + ".old")
    rows.write.mode("overwrite").parquet(path + ".new")
    if store.exists(where):
        store.delete(old, True)
        store.rename(where, old)
    store.rename(beside, where)
    store.delete(old, True)


# ---- JDBC


def write_jdbc(df: DataFrame, url: str, table: str, upsert_keys: list[str] | None = None, properties: dict | None = None) -> None:
    """Appends; or, with keys, replaces rows of equal keys. An upsert goes through a staging table and one MERGE in the
    database, so that a repeated batch leaves the same rows."""
    properties = dict(properties or {})
    writer = lambda frame, name, mode: frame.write.format("jdbc").option("url", url).option("dbtable", name).options(**properties).mode(mode).save()
    if not upsert_keys:
        writer(df, table, "append")
        return
    staging = f"{table}_STAGING"
    from ..operators.grouping import top_one

    writer(top_one(df, upsert_keys, []), staging, "overwrite")
    rest = [c for c in df.columns if c not in upsert_keys]
    q = lambda c: f'"{c}"'
    on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in upsert_keys)
    update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{q(c)} = s.{q(c)}' for c in rest)} " if rest else ""
    merge = f"MERGE INTO {table} t USING {staging} s ON {on} {update}WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, df.columns))}) VALUES ({', '.join(f's.{q(c)}' for c in df.columns)})"
    execute(df, url, [merge, f"DROP TABLE {staging}"], properties)


def execute(df: DataFrame, url: str, statements: list[str], properties: dict | None = None) -> None:
    """Statements in one transaction on the driver."""
    jvm = df.sparkSession.sparkContext._jvm
    said = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        if k in ("user", "password"):
            said.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, said)
    try:
        connection.setAutoCommit(False)
        for text in statements:
            statement = connection.createStatement()
            statement.executeUpdate(text)
            statement.close()
        connection.commit()
    finally:
        connection.close()


# ---- Kafka


def write_kafka(df: DataFrame, topic: str, servers: str, key_by: list[str] | None = None, form: str = "json") -> None:
    if not kafka_available(df.sparkSession):
        raise RuntimeError("the Kafka connector (spark-sql-kafka-0-10) isn't on the class path")
    encode(df, key_by, form).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def with_sequence(records: DataFrame, batch: int) -> DataFrame:
    """Records with headers batch and sequence, by which a reader can drop repeats of an at-least-once delivery."""
    ordered = records.withColumn("__n", F.monotonically_increasing_id())
    headers = F.array(
        F.struct(F.lit("batch").alias("key"), F.lit(str(batch)).cast("binary").alias("value")),
        F.struct(F.lit("sequence").alias("key"), F.col("__n").cast("string").cast("binary").alias("value")),
    )
    return ordered.withColumn("headers", headers).drop("__n")
