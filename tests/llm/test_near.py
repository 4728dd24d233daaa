import random

import numpy as np
import pytest

from spillway.llm import minhash, similar
from spillway.llm.common import Scratch

from . import helpers


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = helpers.corpus(seed)
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    assert got(minhash.near_duplicates(spark, docs)) == helpers.near(rows)


@pytest.mark.parametrize("crowd", [similar.PAIRS_PER_MEMBER, 0], ids=["pairs", "settled"])
def test_links_that_centres_miss_are_found(spark, crowd):
    """A chain in one bucket: the centre reaches its neighbour only, the rest is settled in blocks."""
    rng = random.Random(5)
    text, rows = helpers.prose(rng, 120), []
    for k in range(14):
        rows.append((k, text))
        text = helpers.edited(rng, text, 2)
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    # one coordinate a band: neighbours of neighbours share buckets
    found = got(minhash.near_duplicates(spark, docs, bands=similar.Bands(64, 1), crowd=crowd))
    assert found == helpers.near(rows)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)))
    flat, offsets = np.concatenate((np.sort(a), np.sort(b), a[:1])), np.array([0, 400, 800, 801])
    s = similar.sketch(flat, offsets, 1024)
    assert (s != np.iinfo(np.uint64).max).all()  # every coordinate is filled, for one element too
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.06
    assert (s == similar.sketch(flat, offsets, 1024)).all()


def test_connect(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 540)]
    out = similar.connect(Scratch(spark, "test"), spark.createDataFrame(links, "a bigint, b bigint"), "c")
    keys = {k for link in links for k in link}
    want = {k: c for k, c in helpers.components(keys, links).items() if any(a != b and k in (a, b) for a, b in links)}
    assert {r["key"]: r["component"] for r in out.collect()} == want
    assert similar.connect(Scratch(spark, "test"), spark.createDataFrame([], "a bigint, b bigint"), "c").count() == 0


def test_edges(spark):
    assert minhash.near_duplicates(spark, spark.createDataFrame([], helpers.SCHEMA)).count() == 0
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "y", 2), (None, "a b c d e f", "z", 3), (2, None, None, None), (3, "A B  c d e f", "k", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, kept int")
    out = sorted(map(tuple, minhash.near_duplicates(spark, docs).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False)], key=str)
    left = minhash.drop_near_duplicates(spark, docs)
    assert left.columns == docs.columns and sorted(r["component_id"] or "" for r in left.collect()) == ["", "x", "y", "z"]


def test_scratch_tables_go(spark):
    from spillway.llm import common

    scratch = Scratch(spark, "mine")
    table = scratch.save(spark.range(3), "t")
    assert table.count() == 3
    common.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(scratch.path("t"))
