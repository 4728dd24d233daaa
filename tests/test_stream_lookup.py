"""Lookups of a stream meet the table as it is when a micro-batch runs, or as a cache holds it."""

import time

import pytest

import spillway as sp
from spillway.plans import nodes as n
from spillway.schema import Field, Schema
from spillway.streaming import run

KEYS = Schema({"id": Field.BIGINT(), "code": Field.STRING()})


class Place:
    """A folder of keys that a stream reads, and a table of names that changes under it."""

    def __init__(self, spark, path, name, **lookup):
        self.spark, self.keys, self.names = spark, str(path / "keys"), {"a": "old"}
        spark.createDataFrame([], "id bigint, code string").write.parquet(self.keys)
        table = n.TableSource(frame=lambda s: s.createDataFrame(list(self.names.items()), "code string, name string"))
        looked = n.FileSource(path=self.keys, schema=KEYS).via(n.LookupJoin(table=table, on="l.code = r.code", select=("name",), **lookup)).filter("id >= 0")
        self.name, self.pipeline = name, sp.Pipeline(name, (looked.to(n.MemorySink(name=name)),))

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), "id bigint, code string").coalesce(1).write.mode("append").parquet(self.keys)

    def rows(self, count):
        """All rows, once there are so many."""
        for _ in range(300):
            if self.spark.catalog.tableExists(self.name) and self.spark.table(self.name).count() >= count:
                break
            time.sleep(0.1)
        return sorted((r["id"], r["name"]) for r in self.spark.table(self.name).collect())


@pytest.mark.parametrize("ttl, later, last", [(None, "new", "newer"), ("1 second", "new", "newer"), ("1 hour", "old", "old")])
def test_a_running_stream_sees_the_table_change(spark, tmp_path, ttl, later, last):
    place = Place(spark, tmp_path, f"looked_{str(ttl).replace(' ', '_')}", cache_ttl=ttl)
    (query,) = sp.start_streams(spark, place.pipeline)
    try:
        place.add((1, "a"), (2, "b"), (-1, "a"))
        assert place.rows(2) == [(1, "old"), (2, None)]
        place.names["a"] = "new"
        time.sleep(1.5)
        place.add((3, "a"))
        assert place.rows(3)[-1] == (3, later)
        place.names["a"] = "newer"
        time.sleep(1.5)
        place.add((4, "a"))
        assert place.rows(4)[-1] == (4, last)
    finally:
        query.stop()


def test_a_table_above_the_limit_is_not_kept(spark, tmp_path):
    loads = []
    cache = run.LookupCache(lambda: loads.append(1) or spark.range(5), "1 hour", 4)
    assert cache().count() == cache().count() == 5 and len(loads) == 2
    cache.max_rows = 5
    assert cache().count() == cache().count() == 5 and len(loads) == 3


def test_a_refreshed_lookup_before_an_aggregate_is_an_error(spark, tmp_path):
    place = Place(spark, tmp_path, "never", cache_ttl="1 second")
    counts = place.pipeline.sinks[0].inputs[0].aggregate(["name"], {"n": "COUNT(*)"})
    with pytest.raises(n.DefinitionError, match="row by row"):
        sp.start_streams(spark, sp.Pipeline("p", (counts.to(n.MemorySink(name="never")),), output_mode="complete"))


def test_routes_after_a_lookup(spark, tmp_path):
    place = Place(spark, tmp_path, "routed_lookup")
    route = place.pipeline.sinks[0].inputs[0].via(n.Route(branches=(n.Branch("known", "name IS NOT NULL"),)))
    place.add((1, "a"), (2, "b"))
    sinks = (route.branch("known").to(n.FileSink(path=str(tmp_path / "known"))), route.default().to(n.FileSink(path=str(tmp_path / "rest"))))
    sp.run_streams(spark, sp.Pipeline("routes", sinks, checkpoint=n.Checkpoint(location=str(tmp_path / "c"))), every="available-now")
    assert [[r["id"] for r in spark.read.parquet(str(tmp_path / x)).collect()] for x in ("known", "rest")] == [[1], [2]]


def test_restarts_and_settings_of_a_pipeline(spark, tmp_path):
    place, tries = Place(spark, tmp_path, "again"), []

    def sometimes(df):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("no")
        return df

    place.add((1, "a"))
    # a lookup puts what follows it into the micro-batch, where the first try fails
    table = n.TableSource(frame=lambda s: sometimes(s.createDataFrame([("a", "x")], "code string, name string")))
    looked = n.FileSource(path=place.keys, schema=KEYS).via(n.LookupJoin(table=table, on="l.code = r.code", select=("name",)))
    made = sp.synthesise(
        sp.Pipeline("p", (looked.to(n.FileSink(path=str(tmp_path / "out"))),), checkpoint=n.Checkpoint(location=str(tmp_path / "c")), restart=sp.Restart("fixed-delay", 2, "1 second")),
        sp.AppConfig(batch_size=77, spark={"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}),
    )
    before = {k: spark.conf.get(k, None) for k in made.spark}
    try:
        assert sp.run_streams(spark, made, every="available-now") == 1
        assert [spark.conf.get(k) for k in sorted(made.spark)] == ["32m", "77"]
        assert [r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x"]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_what_a_memory_sink_gets_lies_in_files(spark, tmp_path):
    place = Place(spark, tmp_path, "in_files", cache_ttl="1 hour")
    place.add((1, "a"), (2, "b"))
    sp.run_streams(spark, place.pipeline, every="available-now")
    assert place.rows(2) == [(1, "old"), (2, None)]
    # rows that came to the driver have no files
    files, shared = spark.table("in_files").inputFiles(), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert files and all(f.removeprefix("file://").startswith(shared) for f in files)


def test_a_table_of_micro_batches(spark):
    rows = lambda *ids: spark.createDataFrame([(i, "x", None) for i in ids], "id bigint, ID string, nothing void")
    more, whole = run.Kept(spark, "more_and_more"), run.Kept(spark, "whole_each_time", whole=True)
    for batch, ids in ((0, (1, 2)), (1, (3,)), (1, (4, 5)), (2, ()), (3, (6,))):
        more(rows(*ids), batch)
        whole(rows(*ids), batch)
    for name, want in (("more_and_more", [1, 2, 4, 5, 6]), ("whole_each_time", [6])):
        assert spark.table(name).columns == ["id", "ID", "nothing"] and spark.table(name).dtypes[2][1] == "void"
        assert sorted(map(tuple, spark.table(name).collect())) == [(i, "x", None) for i in want]
