import random

import pytest

from spillway.llm import decontaminate, exact, minhash

from . import helpers
from .test_exact_and_benchmark import contaminated


@pytest.mark.parametrize("seed", range(3))
def test_a_text_without_copies_stays_whatever_its_id_has(spark, seed):
    rng = random.Random(seed)
    a, unique = helpers.prose(rng, 80), helpers.prose(rng, 80)
    rows = [(1, a, "first"), (5, helpers.edited(rng, a, 1), "copy"), (5, unique, "unique"), (None, a, "nameless"), (6, None, "null"), (7, a, "exact")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tag string")
    left = minhash.drop_near_duplicates(spark, docs)
    assert left.columns == docs.columns and sorted(r["tag"] for r in left.collect()) == ["first", "nameless", "null", "unique"]


def test_locators_find_the_rows_that_stay(spark, tmp_path):
    rows = [(k, f"text {k % 40}", k) for k in range(200)] + [(900, None, 1), (901, "", 2)]
    spark.createDataFrame(rows, "doc_id bigint, text string, locator int").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    at = {r["at"]: r["doc_id"] for r in docs.selectExpr("concat(_metadata.file_path, '#', _metadata.row_index) AS at", "doc_id").collect()}
    for out in (exact.exact_groups(spark, docs).collect(),):
        assert len(out) == 202 and all(at[r["locator"]] == r["keep_id"] for r in out)


@pytest.mark.parametrize("limit", [exact.ANTI_BYTES, 0], ids=["broadcast", "shuffled"])
def test_hot_texts_and_lone_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(exact, "ANTI_BYTES", limit)
    rows = [(k, "the same") for k in range(300)] + [(k, f"own {k}") for k in range(300, 400)] + [(None, "the same"), (None, None), (400, "")]
    out = {(r["doc_id"], r["text_sha256"][:6]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(spark, spark.createDataFrame(rows, helpers.SCHEMA)).collect()}
    assert len(out) == len(rows)
    for (key, _), (keep, size, kept) in out.items():
        if key is not None and key < 300:
            assert (keep, size, kept) == (299, 301, key == 299)
        elif key is not None and key < 400:
            assert (keep, size, kept) == (key, 1, True)
        elif key == 400:
            assert (keep, size, kept) == (400, 2, True)
        else:
            assert (keep, size, kept) in ((299, 301, False), (400, 2, False))


def test_benchmarks_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    rng = random.Random(6)
    items = [(k, helpers.prose(rng, rng.choice([1, 2, 5, 12, 13, 14, 40]), 60)) for k in range(25)] + [(30, None), (31, ""), (33, "a " * 15)]
    docs = [(k, helpers.prose(rng, rng.randrange(0, 80), 60) + " " + (rng.choice(items)[1] or "").upper()) for k in range(80)]
    docs += [(200, None), (201, ""), (None, docs[0][1]), (203, "a " * 400), (0, docs[0][1]), (0, "another " + "a " * 15)]
    out = decontaminate.contamination(spark, spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r)[:6] for r in out.collect()), key=str) == contaminated(docs, items)
