"""Command line: write a starter pipeline, show or run a plan document.

    python -m spillway new FILE
    python -m spillway inspect PLAN [table|json|mermaid]
    python -m spillway run PLAN
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from . import nodes_starter
from .plans.document import describe, from_document, to_document
from .plans.validate import validate


def main(args: list[str]) -> int:
    if args[:1] == ["new"] and len(args) == 2:
        target = Path(args[1])
        if target.exists():
            print(f"{target} is there already", file=sys.stderr)
            return 1
        target.write_text(json.dumps(to_document(nodes_starter.pipeline()), indent=2))
        return 0
    if args[:1] not in (["inspect"], ["run"]) or len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    pipeline = from_document(Path(args[1]).read_text())
    found = validate(pipeline)
    for d in found:
        print(f"{d.level}: {d.node}: {d.message}", file=sys.stderr)
    if any(d.level == "error" for d in found):
        return 1
    if args[0] == "inspect":
        print(describe(pipeline, *args[2:3]))
        return 0
    from pyspark.sql import SparkSession

    from .plans.execute import run_batch, run_streams

    spark = SparkSession.builder.appName(pipeline.name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if pipeline.mode == "batch":
        run_batch(spark, pipeline)
    else:
        run_streams(spark, pipeline)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
