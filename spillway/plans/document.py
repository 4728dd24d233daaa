"""Plans as JSON documents and as tables and diagrams for people."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from ..operators.sql import Call, WindowSpec
from ..schema import Schema, Watermark
from . import nodes as n

VERSION = 1


def shuffle_of(node: n.Node) -> tuple[str, list[str]]:
    """How rows reach a node, as the definition has it; Spark's optimiser may do better."""
    if isinstance(node, n.Aggregate):
        return "HASH", list(node.group_by)
    if isinstance(node, n.Deduplicate):
        return "HASH", list(node.key)
    if isinstance(node, (n.TopN, n.MatchRecognize)):
        return "HASH", list(node.partition_by)
    if isinstance(node, (n.Join, n.IntervalJoin)):
        return ("BROADCAST", []) if getattr(node, "broadcast", None) else ("HASH", [])
    if isinstance(node, n.TemporalJoin):
        return "HASH", list(node.on)
    return "FORWARD", []


def plain(value):
    """JSON of a property; what has none is named by its type."""
    if isinstance(value, T.DataType):
        return {"type": value.jsonValue()}
    if isinstance(value, Schema):
        out = {"fields": {k: t.jsonValue() for k, t in value.fields.items()}}
        if value.watermark:
            out["watermark"] = {"column": value.watermark.column, "expression": value.watermark.expression}
        return {"schema": out | {"primary_key": list(value.primary_key)}}
    if isinstance(value, n.Branch):
        return {"branch": [value.name, value.condition]}
    if isinstance(value, WindowSpec):
        return {"window": {"partition_by": list(value.partition_by), "order_by": value.order_by, "rows": value.rows, "range": value.range}}
    if isinstance(value, Call):
        return {"call": {"func": value.func, "args": list(value.args), "over": plain(value.over) if value.over else None, "window": value.window}}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    return {"opaque": type(value).__name__}


def rich(value):
    if isinstance(value, list):
        return tuple(rich(v) for v in value)
    if not isinstance(value, dict):
        return value
    if set(value) == {"type"}:
        return T.StructType.fromJson({"fields": [{"name": "x", "type": value["type"], "nullable": True, "metadata": {}}]}).fields[0].dataType
    if set(value) == {"schema"}:
        s = value["schema"]
        return Schema({k: rich({"type": t}) for k, t in s["fields"].items()}, Watermark(**s["watermark"]) if "watermark" in s else None, tuple(s["primary_key"]))
    if set(value) == {"branch"}:
        return n.Branch(*value["branch"])
    if set(value) == {"window"}:
        w = value["window"]
        return WindowSpec(tuple(w["partition_by"]), w["order_by"], *(tuple(w[k]) if w[k] else None for k in ("rows", "range")))
    if set(value) == {"call"}:
        c = value["call"]
        return Call(c["func"], tuple(c["args"]), rich(c["over"]) if c["over"] else None, c["window"])
    if set(value) == {"opaque"}:
        raise n.DefinitionError(f"a {value['opaque']} can't be read back from a document")
    return {k: rich(v) for k, v in value.items()}


def to_document(pipeline: n.Pipeline) -> dict:
    nodes = n.identify(pipeline.sinks)
    names = {id(x): k for k, x in nodes.items()}
    operators, edges = [], []
    for key, node in nodes.items():
        props = node.props()
        table = props.pop("table", None) if isinstance(node, n.LookupJoin) else None
        if isinstance(table, n.Node):
            props["table"] = {"node": names[id(table)]}
        elif table is not None:
            props["table"] = table
        operators.append({"id": key, "component": node.component, "name": node.name, "props": {k: plain(v) for k, v in props.items()}})
        kind, keys = shuffle_of(node)
        edges += [{"from": names[id(i)], "to": key, "port": port, "shuffle": kind, "keys": keys} for port, i in enumerate(node.inputs)]
    config = {"mode": pipeline.mode, "parallelism": pipeline.parallelism, "state_backend": pipeline.state_backend, "output_mode": pipeline.output_mode}
    return {"version": VERSION, "name": pipeline.name, "config": config, "operators": operators, "edges": edges, "sinks": [names[id(s)] for s in pipeline.sinks]}


def from_document(document: dict | str) -> n.Pipeline:
    document = json.loads(document) if isinstance(document, str) else document
    made: dict[str, n.Node] = {}
    inputs: dict[str, list] = {}
    for e in document["edges"]:
        inputs.setdefault(e["to"], []).append((e["port"], e["from"]))
    for o in document["operators"]:
        kind = getattr(n, o["component"], None)
        if not (isinstance(kind, type) and issubclass(kind, n.Node)):
            raise n.DefinitionError(f"component {o['component']!r}")
        props = {k: made[v["node"]] if k == "table" and isinstance(v, dict) and "node" in v else rich(v) for k, v in o["props"].items()}
        made[o["id"]] = kind(inputs=tuple(made[f] for _, f in sorted(inputs.get(o["id"], []))), name=o["name"], **props)
    return n.Pipeline(document["name"], tuple(made[s] for s in document["sinks"]), **document["config"])


def describe(pipeline: n.Pipeline, form: str = "table") -> str:
    """table, json or mermaid."""
    document = to_document(pipeline)
    if form == "json":
        return json.dumps(document, indent=2, sort_keys=True)
    if form == "mermaid":
        shape = lambda o: f'{o["id"]}["{o["component"]}{": " + o["name"] if o["name"] else ""}"]'
        arrow = lambda e: f'{e["from"]} -->{"" if e["shuffle"] == "FORWARD" else "|" + e["shuffle"] + " " + ",".join(e["keys"]) + "|"} {e["to"]}'
        return "\n".join(["graph LR", *(f"  {shape(o)}" for o in document["operators"]), *(f"  {arrow(e)}" for e in document["edges"])])
    if form != "table":
        raise ValueError(f"form {form!r}; table, json or mermaid")
    head = ["id", "component", "inputs", "shuffle", "properties"]
    rows = []
    for o in document["operators"]:
        own = [e for e in document["edges"] if e["to"] == o["id"]]
        rows.append([o["id"], o["component"], ", ".join(e["from"] for e in own), ", ".join(sorted({f"{e['shuffle']}({', '.join(e['keys'])})" if e["keys"] else e["shuffle"] for e in own})), json.dumps(o["props"], ensure_ascii=False)])
    widths = [max(len(r[k]) for r in [head, *rows]) for k in range(len(head))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [head, *rows])
