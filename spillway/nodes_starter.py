"""The pipeline that ``python -m spillway new`` writes."""

from __future__ import annotations

from .plans import nodes as n
from .schema import Field, Schema


def pipeline() -> n.Pipeline:
    numbers = n.GeneratorSource(schema=Schema({"id": Field.BIGINT(), "name": Field.STRING()}), max_rows=100, name="numbers")
    return n.Pipeline("starter", (numbers.filter("id >= 50").map({"id": "id", "upper": "UPPER(name)"}).to(n.ConsoleSink(max_rows=10)),), mode="batch")
