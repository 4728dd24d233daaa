from spillway.llm import exact


def test_stores_are_closed_when_a_batch_is_committed(spark, monkeypatch):
    """Executors would hold the stores of all partitions open, with their native memory, into the steps that follow."""
    key, seen = "spark.sql.streaming.stateStore.unloadOnCommit", []
    state = exact.keyed_state
    monkeypatch.setattr(exact, "keyed_state", lambda stream: (seen.append(spark.conf.get(key)), state(stream))[1])
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    out = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.exact_groups(spark, docs).collect())
    assert out == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
    assert seen == ["true"] and spark.conf.get(key) == before
