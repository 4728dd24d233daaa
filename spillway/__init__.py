"""Declarative data pipelines on Spark: typed sources, composable operators, batch and streaming from one definition."""

from importlib import import_module

# names are imported when they are first used, so that Python workers that unpickle a function load little
_PLACES = {
    "schema": "Field Schema SchemaError Watermark",
    "operators.sql": "Call WindowSpec",
    "plans.app": "AppConfig Plugin synthesise",
    "plans.compile": "Compiler",
    "plans.document": "describe from_document to_document",
    "plans.execute": "run_batch run_streams start_streams",
    "plans.nodes": "AddField Aggregate Branch Cast Checkpoint Coalesce ConsoleSink Custom Deduplicate DefinitionError Drop FileSink FileSource Filter "
    "FlatMap GeneratorSource IntervalJoin JdbcSink JdbcSource Join KafkaSink KafkaSource Limit LookupJoin Map MatchRecognize MemorySink Node "
    "OrderBy Pipeline Project Query RawSQL Rename Route SessionWindow SlideWindow TableSource TemporalJoin TopN TumbleWindow Union UpsertSink",
    "plans.validate": "Diagnostic validate",
    "streaming.run": "Restart Supervisor",
}
_WHERE = {name: place for place, names in _PLACES.items() for name in names.split()}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
