"""Files, JDBC tables and Kafka topics. What decodes and encodes records is plain column functions, so that it works,
and is tested, without a broker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Schema

FILES = ("parquet", "orc", "json", "csv", "text")


def read_files(spark: SparkSession, path: str | list[str], form: str = "parquet", schema: Schema | None = None, streaming: bool = False, options: dict | None = None) -> DataFrame:
    """Rows of files. Filters, columns and partitions reach the scan. A stream of parquet or orc may leave its schema to
    the files that are there; other streams need one."""
    if form not in FILES:
        raise ValueError(f"format {form!r}; one of {', '.join(FILES)}")
    options = dict(options or {})
    if not streaming:
        reader = spark.read.format(form).options(**options)
        if schema:
            reader = reader.schema(schema.struct())
        return reader.load(path)
    struct = schema.struct() if schema else spark.read.format(form).options(**options).load(path).schema if form in ("parquet", "orc") else None
    if struct is None:
        raise ValueError(f"a stream of {form} files needs a schema")
    rows = spark.readStream.format(form).options(**options).schema(struct).load(stream_path(spark, path))
    return schema.watermarked(rows) if schema else rows


def stream_path(spark: SparkSession, path: str) -> str:
    """File streams read folders or patterns: a path that is one file becomes a pattern that fits it alone."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    single = store.exists(where) and store.getFileStatus(where).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, partitions: int = 1, bounds: tuple | None = None, properties: dict | None = None) -> DataFrame:
    """A whole table, by ranges of a column in parallel where one is named. Filters and columns go to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition_column:
        if bounds is None:
            raise ValueError("partitions need the bounds of their column")
        reader = reader.options(partitionColumn=partition_column, numPartitions=partitions, lowerBound=bounds[0], upperBound=bounds[1])
    return reader.load()


# ---- records of topics

DECODERS = ("json", "csv", "avro", "protobuf")


def decode(raw: DataFrame, schema: Schema, form: str = "json", value: str = "value", options: dict | None = None) -> DataFrame:
    """Rows of binary or string records. Missing keys are null, numbers in string columns become their text, records
    that can't be read are left out."""
    text = F.col(value).cast("string")
    options = {k: str(v) for k, v in (options or {}).items()}
    if form == "json":
        # a corrupt record leaves all columns null and its text in the extra one
        struct = schema.struct().add("__corrupt", "string")
        parsed = F.from_json(text, struct, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt", **options})
    elif form == "csv":
        struct = schema.struct().add("__corrupt", "string")
        parsed = F.from_csv(text, struct.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt", **options})
    elif form == "avro":
        from pyspark.sql.avro.functions import from_avro

        parsed = from_avro(F.col(value), options.pop("jsonFormatSchema"), options)
        return raw.select(parsed.alias("r")).where("r IS NOT NULL").select(*[f"r.`{c}`" for c in schema.fields])
    elif form == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf

        parsed = from_protobuf(F.col(value), options.pop("messageName"), options.pop("descFilePath"), options)
        return raw.select(parsed.alias("r")).where("r IS NOT NULL").select(*[f"r.`{c}`" for c in schema.fields])
    else:
        raise ValueError(f"format {form!r}; one of {', '.join(DECODERS)}")
    rows = raw.where(text.isNotNull()).select(parsed.alias("r")).where("r IS NOT NULL AND r.__corrupt IS NULL")
    return rows.select(*[F.col(f"r.`{c}`").alias(c) for c in schema.fields])


def encode(df: DataFrame, key_by: list[str] | None = None, form: str = "json") -> DataFrame:
    """key and value of records: typed JSON with nulls kept, or a CSV line; the key is a JSON object of its columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if form == "json":
        value: Column = F.to_json(whole, {"ignoreNullFields": "false"})
    elif form == "csv":
        value = F.to_csv(whole)
    else:
        raise ValueError(f"format {form!r}; json or csv")
    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in key_by]), {"ignoreNullFields": "false"}) if key_by else F.lit(None).cast("string")
    return df.select(key.alias("key"), value.alias("value"))


STARTS = {"earliest": "earliest", "latest": "latest", "earliest-offset": "earliest", "latest-offset": "latest"}


def kafka_options(topic: str, servers: str, startup: str = "latest-offset", group: str | None = None, timestamp_ms: int | None = None, max_per_trigger: int | None = None) -> dict[str, str]:
    """Reader options. Unknown starts, the group's offsets among them, begin at the earliest; a restart always resumes
    from the checkpoint."""
    options = {"subscribe": topic, "kafka.bootstrap.servers": servers}
    if startup == "timestamp":
        if timestamp_ms is None:
            raise ValueError("a start by time needs timestamp_ms")
        options |= {"startingTimestamp": str(timestamp_ms), "startingOffsetsByTimestampStrategy": "latest"}
    else:
        options["startingOffsets"] = STARTS.get(startup, "earliest")
    if group:
        options["kafka.group.id"] = group
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def kafka_available(spark: SparkSession) -> bool:
    """Whether the connector's package is on the class path."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
    except Exception:  # what the gateway raises depends on the class loader
        return False
    return True


def read_kafka(spark: SparkSession, schema: Schema, topic: str, servers: str, form: str = "json", streaming: bool = True, startup: str = "latest-offset", group: str | None = None, timestamp_ms: int | None = None, decode_options: dict | None = None) -> DataFrame:
    if not kafka_available(spark):
        raise RuntimeError("the Kafka connector (spark-sql-kafka-0-10) isn't on the class path")
    reader = spark.readStream if streaming else spark.read
    options = kafka_options(topic, servers, startup if streaming else "earliest", group, timestamp_ms)
    rows = decode(reader.format("kafka").options(**options).load(), schema, form, options=decode_options)
    return schema.watermarked(rows)
