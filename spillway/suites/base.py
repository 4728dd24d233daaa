"""Registration of queries and helpers to define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import Dialect
from ..plans.compile import Compiler
from ..plans.nodes import FileSource, Node

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def source(sf_dir: str, table: str, **more) -> FileSource:
    return FileSource(path=f"{sf_dir}/{table}.parquet", name=table, **more)


def frame(spark: SparkSession, node: Node, dialect: Dialect = Dialect()) -> DataFrame:
    return Compiler(spark, dialect=dialect).frame(node)


def query(sql: str | None, dialect: Dialect = Dialect()):
    """Registers a function of the tables' folder that gives a node, or of (spark, folder) that gives a frame."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return frame(spark, f(sf_dir), dialect) if f.__code__.co_argcount == 1 else f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register
