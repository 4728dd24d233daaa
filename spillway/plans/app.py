"""Applications: configuration, environments, and plugins around pipelines."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from . import nodes as n
from .validate import Diagnostic, validate


@dataclass(frozen=True)
class AppConfig:
    """Settings of an application; ``environments`` override them by name, those under * first. ``batch_size`` bounds the
    rows of a batch that goes to Python, ``spark`` has session settings."""

    bootstrap_servers: str | None = None
    parallelism: int | None = None
    batch_size: int | None = None
    checkpoint: n.Checkpoint | None = None
    state_backend: str | None = None
    spark: dict[str, str] = field(default_factory=dict)
    environments: dict[str, dict[str, Any]] = field(default_factory=dict)

    def __post_init__(self):
        if self.batch_size is not None and self.batch_size <= 0:
            raise n.DefinitionError("batch_size is positive")

    def resolve(self, environment: str | None = None) -> AppConfig:
        if environment is not None and environment not in self.environments and "*" not in self.environments:
            raise n.DefinitionError(f"environment {environment!r}")
        merged: dict[str, Any] = {}
        for key in ("*", environment):
            for k, v in self.environments.get(key, {}).items():
                merged[k] = {**merged[k], **v} if isinstance(v, dict) and isinstance(merged.get(k), dict) else v
        if "spark" in merged:
            merged["spark"] = {**self.spark, **merged["spark"]}
        return dataclasses.replace(self, **merged)


@dataclass(frozen=True)
class Plugin:
    """Adds components, changes trees, checks pipelines, and acts before and after synthesis. ``before`` and ``after``
    name plugins that it precedes or follows."""

    name: str
    components: dict[type, Callable] = field(default_factory=dict)
    transform: Callable[[list[n.Node]], list[n.Node]] | None = None
    validate: Callable[[n.Pipeline], list[Diagnostic]] | None = None
    before_synth: Callable[[n.Pipeline], None] | None = None
    after_synth: Callable[[n.Pipeline], None] | None = None
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


def ordered(plugins: list[Plugin]) -> list[Plugin]:
    """In the given order, as far as before and after allow."""
    if len({p.name for p in plugins}) < len(plugins):
        raise n.DefinitionError("two plugins have one name")
    waits = {p.name: {a for a in p.after if any(q.name == a for q in plugins)} | {q.name for q in plugins if p.name in q.before} for p in plugins}
    out: list[Plugin] = []
    while len(out) < len(plugins):
        done = {p.name for p in out}
        ready = next((p for p in plugins if p.name not in done and waits[p.name] <= done), None)
        if ready is None:
            raise n.DefinitionError("plugins wait for each other")
        out.append(ready)
    return out


def synthesise(pipeline: n.Pipeline, config: AppConfig | None = None, environment: str | None = None, plugins: list[Plugin] | None = None) -> n.Pipeline:
    """The pipeline as it runs: settings that it doesn't make itself come from the configuration, servers reach Kafka
    nodes, plugins change the tree; errors raise."""
    from .compile import LOWERING

    said = (config or AppConfig()).resolve(environment)
    order = ordered(plugins or [])
    for p in order:
        for kind, lower in p.components.items():
            if LOWERING.get(kind, lower) is not lower:
                raise n.DefinitionError(f"{kind.__name__} is lowered by two plugins")
            LOWERING[kind] = lower
        if p.before_synth:
            p.before_synth(pipeline)
    roots = list(pipeline.sinks)
    if said.bootstrap_servers:
        kafka = (n.KafkaSource, n.KafkaSink)
        roots = n.replace(roots, lambda x: isinstance(x, kafka) and x.bootstrap_servers is None, lambda x: dataclasses.replace(x, bootstrap_servers=said.bootstrap_servers))
    for p in order:
        roots = p.transform(roots) if p.transform else roots
    changes: dict[str, Any] = {"sinks": tuple(roots)}
    if pipeline.parallelism is None and said.parallelism:
        changes["parallelism"] = said.parallelism
    if pipeline.checkpoint is None and said.checkpoint:
        changes["checkpoint"] = said.checkpoint
    batch = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(said.batch_size)} if said.batch_size else {}
    if settings := {**batch, **said.spark, **pipeline.spark}:
        changes["spark"] = settings
    if said.state_backend and pipeline.state_backend == "rocksdb":
        changes["state_backend"] = said.state_backend
    made = dataclasses.replace(pipeline, **changes)
    found = [*validate(made), *(d for p in order if p.validate for d in p.validate(made))]
    if errors := [d for d in found if d.level == "error"]:
        raise n.DefinitionError("; ".join(f"{d.node}: {d.message}" for d in errors))
    for p in order:
        if p.after_synth:
            p.after_synth(made)
    return made
