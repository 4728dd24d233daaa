"""Checks of a definition before anything runs."""

from __future__ import annotations

from dataclasses import dataclass

from .nodes import DefinitionError, Join, LookupJoin, Node, Pipeline, Route, RouteOutput, Sink, Source, TwoInputs, Union, identify


@dataclass(frozen=True)
class Diagnostic:
    level: str
    node: str
    message: str


#: Inputs that a component takes: least and most.
def arity(node: Node) -> tuple[int, int | None]:
    if isinstance(node, Source):
        return 0, 0
    if isinstance(node, TwoInputs):
        return 2, 2
    if isinstance(node, Union):
        return 1, None
    if node.component in ("RawSQL", "Custom"):
        return 1, None
    return 1, 1


def validate(pipeline: Pipeline, declared: list[Node] | None = None) -> list[Diagnostic]:
    """Errors and warnings. ``declared`` are further nodes of the program: sources among them that no sink reads, and
    operators without a sink, are reported."""
    out: list[Diagnostic] = []
    if not pipeline.sinks:
        return [Diagnostic("error", pipeline.name, "a pipeline needs a sink")]
    try:
        nodes = identify(pipeline.sinks)
    except DefinitionError as e:
        return [Diagnostic("error", pipeline.name, str(e))]
    names = {id(n): k for k, n in nodes.items()}
    for key, node in nodes.items():
        least, most = arity(node)
        if len(node.inputs) < least or most is not None and len(node.inputs) > most:
            what = f"{least}" if least == most else f"{least} or more"
            out.append(Diagnostic("error", key, f"{node.component} takes {what} inputs and has {len(node.inputs)}"))
        for i in node.inputs:
            if isinstance(i, Sink):
                out.append(Diagnostic("error", names[id(i)], f"a sink is read by {key}"))
            if isinstance(i, Route) and not isinstance(node, RouteOutput):
                out.append(Diagnostic("error", key, "a route is read through its branches"))
        if isinstance(node, Join) and pipeline.mode == "streaming" and node.type in ("left", "right", "full") and not node.state_ttl:
            out.append(Diagnostic("warning", key, "an outer join of streams keeps state without bound: give state_ttl, or an interval join"))
        if isinstance(node, LookupJoin) and not isinstance(node.table, Node) and not node.url:
            out.append(Diagnostic("error", key, "a lookup needs a source node, or a url with a table"))
    for sink in pipeline.sinks:
        if not isinstance(sink, Sink):
            out.append(Diagnostic("error", names[id(sink)], f"{sink.component} is no sink"))
    read = {id(n) for n in nodes.values()}
    for node in declared or []:
        if id(node) not in read:
            word = "is read by nothing" if isinstance(node, Source) else "reaches no sink"
            out.append(Diagnostic("error" if isinstance(node, Source) else "warning", node.name or node.component, f"{node.component} {word}"))
    return out


def require_valid(pipeline: Pipeline, declared: list[Node] | None = None) -> None:
    if errors := [d for d in validate(pipeline, declared) if d.level == "error"]:
        raise DefinitionError("; ".join(f"{d.node}: {d.message}" for d in errors))
