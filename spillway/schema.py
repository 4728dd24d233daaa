"""Types of columns and schemas of sources, with event-time watermark and primary key."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema that contradicts itself or data that contradict it."""


class Field:
    """Builders of column types. A type is Spark's own; lengths of VARCHAR and CHAR are not enforced."""

    BOOLEAN, TINYINT, SMALLINT, INT, BIGINT = T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType
    FLOAT, DOUBLE, STRING, DATE, BYTES = T.FloatType, T.DoubleType, T.StringType, T.DateType, T.BinaryType
    TIME = T.LongType

    @staticmethod
    def DECIMAL(precision: int, scale: int) -> T.DataType:
        return T.DecimalType(precision, scale)

    @staticmethod
    def TIMESTAMP(precision: int = 3) -> T.DataType:
        return T.TimestampNTZType()

    @staticmethod
    def TIMESTAMP_LTZ(precision: int = 3) -> T.DataType:
        return T.TimestampType()

    @staticmethod
    def VARCHAR(length: int) -> T.DataType:
        return T.StringType()

    CHAR = VARCHAR

    @staticmethod
    def ARRAY(of: T.DataType) -> T.DataType:
        return T.ArrayType(of)

    @staticmethod
    def MAP(key: T.DataType, value: T.DataType) -> T.DataType:
        return T.MapType(key, value)

    @staticmethod
    def ROW(fields: dict[str, T.DataType]) -> T.DataType:
        return T.StructType([T.StructField(k, t) for k, t in fields.items()])


UNITS = {"MILLISECOND": 1, "SECOND": 1_000, "MINUTE": 60_000, "HOUR": 3_600_000, "DAY": 86_400_000, "WEEK": 604_800_000}
DURATION = re.compile(r"\s*(?:INTERVAL\s+)?'?\s*([+-]?\d+)\s*'?\s*([A-Za-z]+?)S?\s*", re.IGNORECASE)


def duration_ms(text: str | int) -> int:
    """Milliseconds of "5 MINUTE", "1 hour", "INTERVAL '5' SECOND"; a number is milliseconds already."""
    if isinstance(text, int):
        return text
    m = DURATION.fullmatch(text)
    if not m or m[2].upper() not in UNITS:
        raise SchemaError(f"not a duration: {text!r}")
    return int(m[1]) * UNITS[m[2].upper()]


def interval(text: str | int) -> str:
    """The same as Spark spells it."""
    ms = duration_ms(text)
    return f"{ms // 1000} seconds" if ms % 1000 == 0 else f"{ms} milliseconds"


@dataclass(frozen=True)
class Watermark:
    """Event-time column and how far it lags: an expression such as ``ts - INTERVAL '5' SECOND``."""

    column: str
    expression: str

    @property
    def delay(self) -> str:
        m = re.fullmatch(rf"\s*`?{re.escape(self.column)}`?\s*(?:-\s*(.+))?", self.expression, re.IGNORECASE)
        if not m:
            raise SchemaError(f"watermark must be {self.column} - interval, not {self.expression!r}")
        return interval(m[1]) if m[1] else "0 seconds"


@dataclass(frozen=True)
class Schema:
    fields: dict[str, T.DataType]
    watermark: Watermark | None = None
    primary_key: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not self.fields:
            raise SchemaError("a schema needs fields")
        for name, kind in self.fields.items():
            if not isinstance(kind, T.DataType):
                raise SchemaError(f"field {name!r} has no known type: {kind!r}")
        if self.watermark and self.watermark.column not in self.fields:
            raise SchemaError(f"watermark column {self.watermark.column!r} is not a field")
        if missing := [c for c in self.primary_key if c not in self.fields]:
            raise SchemaError(f"primary key columns {missing} are not fields")

    def struct(self) -> T.StructType:
        """All columns are nullable."""
        return T.StructType([T.StructField(k, t, True) for k, t in self.fields.items()])

    def watermarked(self, df: DataFrame) -> DataFrame:
        """A stream with its watermark; batches stay as they are. Event time becomes TIMESTAMP, which Spark asks for."""
        if not df.isStreaming or not self.watermark:
            return df
        column = self.watermark.column
        if df.schema[column].dataType == T.TimestampNTZType():
            df = df.withColumn(column, F.col(column).cast("timestamp"))
        return df.withWatermark(column, self.watermark.delay)
