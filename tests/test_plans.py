import dataclasses
import json

import pytest

import spillway as sp
from spillway.operators.grouping import END, START
from spillway.plans import nodes as n
from spillway.plans.compile import Compiler
from spillway.plans.document import describe
from spillway.schema import Field, Schema, SchemaError, Watermark

RIDES = Schema({"ride": Field.BIGINT(), "line": Field.STRING(), "fare": Field.DECIMAL(8, 2), "boarded": Field.TIMESTAMP(6)}, Watermark("boarded", "boarded - INTERVAL '2' MINUTE"), ("ride", "line"))
SEQUENCE = Schema({"id": Field.BIGINT(), "name": Field.STRING()})


def generated(rows=100):
    return n.GeneratorSource(schema=SEQUENCE, max_rows=rows, name="numbers")


def table(spark, rows, columns, **more):
    return n.TableSource(frame=spark.createDataFrame(rows, columns), **more)


def test_generator_to_console(spark, capsys):
    out = generated().filter("id >= 50").map({"double": "id * 2", "upper": "UPPER(name)"}).to(n.ConsoleSink(max_rows=2))
    sp.run_batch(spark, sp.Pipeline("numbers", (out,), mode="batch"))
    assert capsys.readouterr().out.splitlines() == ["| double | upper   |", "|--------|---------|", "| 100    | NAME_50 |", "| 102    | NAME_51 |", "... (48 more rows)"]


def test_generator_values(spark):
    schema = Schema({"id": Field.BIGINT(), "value": Field.DOUBLE(), "label": Field.STRING(), "flag": Field.BOOLEAN(), "small": Field.INT(), "other": Field.DATE(), "ts": Field.TIMESTAMP()})
    rows = Compiler(spark).frame(n.GeneratorSource(schema=schema, max_rows=10)).orderBy("id").collect()
    assert [tuple(r)[:6] for r in rows] == [(k, k * 1.1, f"label_{k}", k % 2 == 0, k, None) for k in range(10)] and rows[0]["ts"] is not None
    with pytest.raises(ValueError):
        Compiler(spark).frame(n.GeneratorSource(schema=schema))


def test_shared_nodes_are_lowered_once(spark):
    c, calls = Compiler(spark), []
    shared = n.TableSource(frame=lambda s: calls.append(1) or s.range(3))
    both = n.Union(inputs=(shared.filter("id > 0"), shared.filter("id > 1")))
    assert c.frame(both).count() == 3 and calls == [1]


def test_route_outputs(spark):
    route = table(spark, [("tram", 3), ("bus", 8), (None, 1), ("bus", 2)], "line string, stops int").via(n.Route(branches=(n.Branch("short", "stops < 3"), n.Branch("buses", "line = 'bus'"))))
    c = Compiler(spark)
    assert [sorted(r["stops"] for r in c.frame(x).collect()) for x in (route.branch("buses"), route.branch("short"), route.default())] == [[8], [1, 2], [3]]
    for bad in (lambda: n.Route(branches=()), lambda: n.Route(branches=(n.Branch("a", "1"), n.Branch("a", "2")))):
        with pytest.raises(n.DefinitionError):
            bad()


def test_window_keeps_through_stateless_nodes(spark, sf_dir):
    events = n.FileSource(path=f"{sf_dir}/events.parquet")
    after = events.tumble("1 day", "ts").filter("event_type = 'view'").aggregate(["user_id"], {"n": "COUNT(*)"})
    before = events.filter("event_type = 'view'").tumble("1 day", "ts").aggregate(["user_id"], {"n": "COUNT(*)"})
    c = Compiler(spark)
    assert c.frame(after).columns == ["user_id", START, END, "n"]
    assert c.frame(after).exceptAll(c.frame(before)).isEmpty()
    assert {START, END} <= set(c.frame(events.tumble("1 day", "ts").to(n.ConsoleSink())).columns)
    with pytest.raises(n.DefinitionError):
        c.frame(events.tumble("1 day", "ts").map({"x": "user_id"}).aggregate(["x"], {"n": "COUNT(*)"}))


def test_query_and_raw_sql_schemas(spark):
    rows = table(spark, [(1, 2.0)], "a bigint, b double", name="things")
    ok = Schema({"b": Field.DOUBLE(), "a": Field.BIGINT()})
    assert Compiler(spark).frame(rows.sql("SELECT a, b FROM things", output_schema=ok)).columns == ["b", "a"]
    with pytest.raises(SchemaError):
        Compiler(spark).frame(rows.sql("SELECT a FROM input", output_schema=ok))
    both = n.RawSQL(sql="SELECT x.a FROM input x JOIN input_2 y ON x.a = y.a", inputs=(rows, rows))
    assert Compiler(spark).frame(both).collect() == [(1,)]
    for bad in (lambda: n.Query(select={}), lambda: n.Query(select={"a": "a"}, having="a > 1")):
        with pytest.raises(n.DefinitionError):
            bad()


def test_validation():
    source, sink = generated(), n.ConsoleSink()
    good = sp.Pipeline("p", (source.filter("id > 1").to(sink),), mode="batch")
    assert sp.validate(good) == []
    errors = lambda p, declared=None: [d.message for d in sp.validate(p, declared) if d.level == "error"]
    assert "takes 1 inputs and has 0" in errors(sp.Pipeline("p", (sink,)))[0]
    assert errors(sp.Pipeline("p", ()))
    assert "is no sink" in errors(sp.Pipeline("p", (source,)))[0]
    assert "takes 2 inputs" in errors(sp.Pipeline("p", (source.via(n.Join(on="true")).to(sink),)))[0]
    assert errors(good, [generated()]) == ["GeneratorSource is read by nothing"]
    assert [d.level for d in sp.validate(good, [source.filter("id > 2")])] == ["warning"]
    outer = n.Join(inputs=(source, generated()), on="l.id = r.id", type="left").to(sink)
    assert [d.level for d in sp.validate(sp.Pipeline("p", (outer,)))] == ["warning"]
    looped = n.Filter(condition="true")
    object.__setattr__(looped, "inputs", (looped,))
    assert "cycle" in errors(sp.Pipeline("p", (looped.to(sink),)))[0]
    for bad in ({"name": ""}, {"mode": "sometimes"}, {"parallelism": 0}):
        with pytest.raises(n.DefinitionError):
            sp.Pipeline(**{"name": "p", "sinks": (sink,), **bad})
    with pytest.raises(n.DefinitionError):
        n.Union(schemas=(RIDES, SEQUENCE))


def sample():
    rides = n.KafkaSource(topic="rides", schema=RIDES, name="rides")
    counts = rides.filter("fare > 0").tumble("20 MINUTE", "boarded").aggregate(["line"], {"riders": "COUNT(*)"})
    top = counts.via(n.TopN(partition_by=("line",), order_by={"riders": "DESC"}, n=2))
    ranked = rides.via(n.Query(select={"ride": "ride", "place": sp.Call("rank", over=sp.WindowSpec(("line",), {"fare": "DESC"}))}))
    dim = n.JdbcSource(url="jdbc:x", table="tickets", name="dim", partition_column="ride", partitions=3, lower=0, upper=90)
    looked = ranked.via(n.LookupJoin(table=dim, on="l.ride = r.ride"))
    cast = looked.via(n.Cast(columns={"ride": Field.ARRAY(Field.DECIMAL(5, 1))}))
    return sp.Pipeline("sample", (top.to(n.KafkaSink(topic="out", key_by=("line",))), cast.to(n.ConsoleSink())), parallelism=4)


def test_document_round_trip():
    document = sp.to_document(sample())
    again = sp.to_document(sp.from_document(json.dumps(document)))
    assert again == json.loads(json.dumps(document))
    hashed = {e["to"]: (e["shuffle"], e["keys"]) for e in document["edges"]}
    assert hashed["Aggregate"] == ("HASH", ["line"]) and hashed["Filter"] == ("FORWARD", [])
    with pytest.raises(n.DefinitionError):
        sp.from_document({**document, "operators": [{"id": "x", "component": "os", "name": None, "props": {}}], "edges": [], "sinks": []})


def test_describe():
    text = describe(sample())
    assert "TopN" in text and "HASH(line)" in text
    assert describe(sample(), "mermaid").startswith("graph LR") and "rides --> Filter" in describe(sample(), "mermaid")
    assert json.loads(describe(sample(), "json"))["name"] == "sample"
    with pytest.raises(ValueError):
        describe(sample(), "svg")


def test_ids():
    a, b = n.Filter(condition="true", name="my filter!"), n.Filter(condition="true", name="my filter!")
    source = generated()
    nodes = n.identify([source.via(a).to(n.ConsoleSink()), source.via(b).to(n.ConsoleSink())])
    assert list(nodes) == ["numbers", "my_filter", "ConsoleSink", "my_filter_2", "ConsoleSink_2"]


def test_tree_helpers():
    out = generated().filter("id > 1").to(n.ConsoleSink())
    assert [x.component for x in n.walk([out])] == ["GeneratorSource", "Filter", "ConsoleSink"]
    (changed,) = n.replace([out], lambda x: isinstance(x, n.Filter), lambda x: dataclasses.replace(x, condition="id > 2"))
    assert changed.inputs[0].condition == "id > 2" and out.inputs[0].condition == "id > 1"
    (wrapped,) = n.wrap([out], lambda x: isinstance(x, n.GeneratorSource), lambda x: n.Limit(n=5))
    assert [x.component for x in n.walk([wrapped])] == ["GeneratorSource", "Limit", "Filter", "ConsoleSink"]
    (memory,) = n.rekind([out], lambda x: isinstance(x, n.ConsoleSink), n.MemorySink)
    assert isinstance(memory, n.MemorySink) and n.find([memory], lambda x: isinstance(x, n.Filter))


def test_config_and_plugins(spark):
    pipeline = sample()
    config = sp.AppConfig(bootstrap_servers="a:1", parallelism=9, environments={"*": {"spark": {"x": "1"}}, "prod": {"bootstrap_servers": "b:2", "spark": {"y": "2"}}})
    made = sp.synthesise(pipeline, config, "prod")
    assert {x.bootstrap_servers for x in n.find(list(made.sinks), lambda x: isinstance(x, (n.KafkaSource, n.KafkaSink)))} == {"b:2"}
    assert made.parallelism == 4 and config.resolve("prod").spark == {"x": "1", "y": "2"}
    with pytest.raises(n.DefinitionError):
        sp.AppConfig(batch_size=0)
    with pytest.raises(n.DefinitionError):
        sp.AppConfig(environments={"dev": {}}).resolve("prod")

    calls = []

    @dataclasses.dataclass(frozen=True, eq=False, kw_only=True)
    class Twice(n.Node):
        pass

    from spillway.plans.compile import Rows

    components = sp.Plugin("components", components={Twice: lambda c, node, ins: Rows(ins[0].df.union(ins[0].df))}, after_synth=lambda p: calls.append("after"))
    doubling = sp.Plugin("doubling", transform=lambda roots: n.wrap(roots, lambda x: isinstance(x, n.GeneratorSource), lambda x: Twice()), before=("components",), before_synth=lambda p: calls.append("before"))
    out = sp.synthesise(sp.Pipeline("p", (generated(3).to(n.ConsoleSink()),), mode="batch"), plugins=[components, doubling])
    assert Compiler(spark).frame(out.sinks[0]).count() == 6 and calls == ["before", "after"]
    strict = sp.Plugin("strict", validate=lambda p: [sp.Diagnostic("error", p.name, "never")])
    with pytest.raises(n.DefinitionError, match="never"):
        sp.synthesise(pipeline, plugins=[strict])
    for bad in ([strict, strict], [sp.Plugin("a", after=("b",)), sp.Plugin("b", after=("a",))]):
        with pytest.raises(n.DefinitionError):
            sp.synthesise(pipeline, plugins=bad)


def test_streaming_pipeline(spark, tmp_path):
    rows = [(k, "ab"[k % 2]) for k in range(10)]
    spark.createDataFrame(rows, "id bigint, k string").write.parquet(str(tmp_path / "in"))
    source = n.FileSource(path=str(tmp_path / "in"), schema=Schema({"id": Field.BIGINT(), "k": Field.STRING()}))
    route = source.filter("id > 1").via(n.Route(branches=(n.Branch("a", "k = 'a'"),)))
    sinks = (route.branch("a").to(n.FileSink(path=str(tmp_path / "a"))), route.default().to(n.FileSink(path=str(tmp_path / "rest"))), source.to(n.MemorySink(name="all_rows")))
    pipeline = sp.Pipeline("routed", sinks, checkpoint=n.Checkpoint(location=str(tmp_path / "ckpt")), state_backend="rocksdb")
    for query in sp.start_streams(spark, pipeline, every="available-now"):
        query.awaitTermination()
    assert [spark.read.parquet(str(tmp_path / x)).count() for x in ("a", "rest")] == [4, 4] and spark.table("all_rows").count() == 10


def test_command_line(spark, tmp_path, capsys):
    from spillway.__main__ import main

    plan = str(tmp_path / "plan.json")
    assert main(["new", plan]) == 0 and main(["new", plan]) == 1
    assert main(["inspect", plan, "mermaid"]) == 0 and "numbers --> Filter" in capsys.readouterr().out
    assert main(["nothing"]) == 2
    bad = json.loads((tmp_path / "plan.json").read_text())
    bad["edges"] = bad["edges"][1:]
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    assert main(["inspect", str(tmp_path / "bad.json")]) == 1
    assert main(["run", plan]) == 0 and "... (40 more rows)" in capsys.readouterr().out
