import os

import duckdb
import pytest

import __spark_entry__
from spillway import suites
from spillway.schema import Field, Schema
from spillway.sinks import write
from spillway.sources import external, generated

SCHEMA = Schema({"id": Field.BIGINT(), "n": Field.INT(), "s": Field.STRING(), "d": Field.DOUBLE(), "b": Field.BOOLEAN(), "ts": Field.TIMESTAMP()})


def test_decode_json(spark):
    records = ['{"id": 1, "n": 7, "s": "x", "d": 1.5, "b": true, "ts": "2024-01-01T10:00:00"}', '{"id": 2, "s": 5}', "not json", '{"id": "x"}', None, "{}"]
    raw = spark.createDataFrame([(r,) for r in records], "value string")
    out = external.decode(raw, SCHEMA).collect()
    assert [(r["id"], r["n"], r["s"]) for r in out] == [(1, 7, "x"), (2, None, "5"), (None, None, None)] and out[0]["ts"].hour == 10
    lines = spark.createDataFrame([("1,7,x,1.5,true,2024-01-01 10:00:00",), ("a,b",)], "value string")
    assert external.decode(lines, SCHEMA, "csv").collect()[0]["d"] == 1.5
    with pytest.raises(ValueError):
        external.decode(raw, SCHEMA, "xml")


def test_encode(spark):
    df = spark.createDataFrame([(1, None, 2.5)], "id bigint, s string, d double")
    assert external.encode(df, ["id"]).collect() == [('{"id":1}', '{"id":1,"s":null,"d":2.5}')]
    assert external.encode(df, None, "csv").collect()[0]["value"] == "1,,2.5"
    sequence = write.with_sequence(external.encode(df), 7).collect()[0]["headers"]
    assert [h["key"] for h in sequence] == ["batch", "sequence"] and bytes(sequence[0]["value"]) == b"7" and bytes(sequence[1]["value"]).isdigit()


def test_kafka_options(spark):
    assert external.kafka_options("t", "s")["startingOffsets"] == "latest"
    assert external.kafka_options("t", "s", "group-offsets", "g") | {} == {"subscribe": "t", "kafka.bootstrap.servers": "s", "startingOffsets": "earliest", "kafka.group.id": "g"}
    assert external.kafka_options("t", "s", "timestamp", timestamp_ms=5)["startingTimestamp"] == "5"
    with pytest.raises(ValueError):
        external.kafka_options("t", "s", "timestamp")
    if not external.kafka_available(spark):
        with pytest.raises(RuntimeError):
            external.read_kafka(spark, SCHEMA, "t", "s")
        with pytest.raises(RuntimeError):
            write.write_kafka(spark.range(1), "t", "s")


@pytest.mark.parametrize("form", ["parquet", "orc", "json", "csv"])
def test_files(spark, tmp_path, form):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, k string")
    path = str(tmp_path / form)
    write.write_files(df, path, form, partition_by=["k"])
    assert sorted(x for x in os.listdir(path) if x.startswith("k=")) == ["k=a", "k=b"]
    schema = Schema({"id": Field.BIGINT(), "k": Field.STRING()})
    assert sorted(map(tuple, external.read_files(spark, path, form, schema).collect())) == [(1, "a"), (2, "b")]
    write.write_files(df, path + "1", form, single=True)
    assert len([x for x in os.listdir(path + "1") if x.startswith("part-")]) == 1


def test_stream_of_one_file(spark, tmp_path):
    write.write_files(spark.range(5), str(tmp_path / "x"), single=True)
    (part,) = [x for x in os.listdir(tmp_path / "x") if x.endswith(".parquet")]
    query = external.read_files(spark, str(tmp_path / "x" / part), streaming=True).writeStream.format("memory").queryName("one_file").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("one_file").count() == 5
    with pytest.raises(ValueError):
        external.read_files(spark, str(tmp_path), "json", streaming=True)


def test_upsert_files(spark, tmp_path):
    path = str(tmp_path / "up")
    for rows in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)], [(2, "c", 2), (3, "d", 2)], [(2, "old", 0)]):
        write.upsert_files(spark.createDataFrame(rows, "k int, v string, t int"), path, ["k"], "t")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        write.write_jdbc(spark.createDataFrame([(1, "a"), (2, "b")], "ID int, V string"), url, "T", properties={"createTableColumnTypes": "V VARCHAR(20)"})
    except Exception as e:  # no driver on the class path
        pytest.skip(str(e)[:80])
    assert external.read_jdbc(spark, url, "T").count() == 2
    for _ in range(2):
        write.write_jdbc(spark.createDataFrame([(2, "c"), (3, "d")], "ID int, V string"), url, "T", upsert_keys=["ID"], properties={"createTableColumnTypes": "V VARCHAR(20)"})
    assert sorted(map(tuple, external.read_jdbc(spark, url, "T", "ID", 2, (1, 4)).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_console_table(spark):
    df = spark.createDataFrame([(1, 1.5, None, True), (22, float("inf"), "x", False)], "a int, b double, c string, d boolean")
    assert write.console_table(df).splitlines() == ["| a  | b      | c    | d     |", "|----|--------|------|-------|", "| 1  | 1.5000 | NULL | true  |", "| 22 | inf    | x    | false |"]
    assert write.console_table(df, 1).endswith("... (1 more rows)")


def test_benchmark_generators(spark):
    ads = generated.ad_events(spark, 20_000).groupBy("event_type").count().collect()
    share = {r["event_type"]: r["count"] / 200 for r in ads}
    assert abs(share["view"] - 80) < 2 and abs(share["click"] - 15) < 2 and abs(share["purchase"] - 5) < 2
    rows = {k: df.count() for k, df in generated.auction_events(spark, 20_000).items()}
    assert sum(rows.values()) == 20_000 and abs(rows["person"] / 200 - 5) < 1 and abs(rows["bid"] / 200 - 85) < 1


def test_table_streams(spark, sf_dir):
    assert all(df.isStreaming for df in generated.table_streams(spark, sf_dir).values())


def normal(rows, columns):
    order = sorted(columns)

    def value(v):
        if isinstance(v, float):
            return f"{v:.4f}"
        return str(v.isoformat() if hasattr(v, "isoformat") else v)

    return order, sorted(tuple(value(r[c]) for c in order) for r in rows)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


@pytest.mark.parametrize("name", sorted(suites.ORACLE))
def test_query_equals_sql(spark, sf_dir, tables, name):
    df = suites.QUERIES[name](spark, sf_dir)
    got = normal([r.asDict() for r in df.collect()], df.columns)
    cursor = tables.execute(suites.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    want = normal([dict(zip(columns, r, strict=True)) for r in cursor.fetchall()], columns)
    assert got[0] == want[0] and len(got[1]) == len(want[1]) and got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(suites.QUERIES) - set(suites.ORACLE)))
def test_query_runs(spark, sf_dir, name):
    assert suites.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
