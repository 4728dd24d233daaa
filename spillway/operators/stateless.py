"""Projection, filter, set and routing operators. Each is one Catalyst projection or filter; none shuffles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import Dialect, column, condition

ROUTE = "_route"


def where(df: DataFrame, text: str, dialect: Dialect = Dialect()) -> DataFrame:
    """Rows for which the condition is true; false and unknown ones go."""
    return df.where(condition(df, text, dialect))


def project(df: DataFrame, select: dict[str, str], dialect: Dialect = Dialect(), preserve_order: bool = False) -> DataFrame:
    """Exactly these columns, all over the input row; sorted by name unless the given order is asked for."""
    items = select.items() if preserve_order else sorted(select.items())
    return df.select(*[column(e, dialect, df).alias(n) for n, e in items])


def pick(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """An ordered subset of columns; a missing one is an error."""
    columns = list(columns)
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def unnest(df: DataFrame, name: str, into: dict[str, T.DataType] | None = None) -> DataFrame:
    """One row per element, which takes the list's place; rows with a null or empty list go. ``into`` renames and casts
    the element; with several names, the fields of an element that is a struct."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.ArrayType, T.MapType)):
        raise TypeError(f"{name!r} is {kind.simpleString()}, not a list")
    element = "__element"
    if isinstance(kind, T.MapType):
        df, source = df.withColumn(element, F.explode(F.map_entries(F.col(f"`{name}`")))), element
    else:
        df, source = df.withColumn(element, F.explode(F.col(f"`{name}`"))), element
    if not into:
        said = [F.col(source).alias(name)]
    elif len(into) == 1:
        ((alias, to),) = into.items()
        said = [F.col(source).cast(to).alias(alias)]
    else:
        said = [F.col(source)[alias].cast(to).alias(alias) for alias, to in into.items()]
    out: list[Column] = []
    for c in df.columns:
        out += said if c == name else [] if c == element else [F.col(f"`{c}`")]
    return df.select(*out)


def rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """All at once, so that names can be swapped; unknown names are ignored."""
    return df.select(*[F.col(f"`{c}`").alias(columns.get(c, c)) for c in df.columns])


def drop(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Unknown names are ignored."""
    return df.drop(*columns)


def cast(df: DataFrame, columns: dict[str, T.DataType], on_error: str = "fail") -> DataFrame:
    """Types of columns. A value that can't be converted fails the query, or (on_error "null") becomes null."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise KeyError(f"no columns {unknown}")
    how = (lambda c, t: c.try_cast(t)) if on_error == "null" else (lambda c, t: c.cast(t))
    return df.select(*[how(F.col(f"`{c}`"), columns[c]).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def fill(df: DataFrame, columns: dict[str, str], dialect: Dialect = Dialect()) -> DataFrame:
    """Null values of a column become its default expression."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), column(e, dialect, df)) for c, e in columns.items()})


def add(df: DataFrame, columns: dict[str, str], types: dict[str, T.DataType] | None = None, dialect: Dialect = Dialect()) -> DataFrame:
    """Columns appended after the input's, each over the input row."""
    if known := [c for c in columns if c in df.columns]:
        raise ValueError(f"columns {known} exist already")
    made = {c: column(e, dialect, df) for c, e in columns.items()}
    return df.select("*", *[(x.cast(types[c]) if types and c in types else x).alias(c) for c, x in made.items()])


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows, duplicates too. Names and types must be the same, in any order."""
    first, *rest = frames
    for other in rest:
        if sorted(first.dtypes) != sorted(other.dtypes):
            raise TypeError(f"union of different rows: {sorted(first.dtypes)} and {sorted(other.dtypes)}")
        first = first.unionByName(other)
    return first


def route_column(df: DataFrame, conditions: list[str], dialect: Dialect = Dialect()) -> Column:
    """Number of the first branch whose condition is true; -1 for the default."""
    out = F.lit(-1)
    for k in reversed(range(len(conditions))):
        out = F.when(condition(df, conditions[k], dialect), F.lit(k)).otherwise(out)
    return out


def route(df: DataFrame, conditions: list[str], dialect: Dialect = Dialect()) -> list[DataFrame]:
    """One frame per branch and, last, the rows that match none. A row goes to its first match only."""
    if not conditions:
        raise ValueError("a route needs a branch")
    tagged = df.withColumn(ROUTE, route_column(df, conditions, dialect))
    return [tagged.where(F.col(ROUTE) == k).drop(ROUTE) for k in [*range(len(conditions)), -1]]
