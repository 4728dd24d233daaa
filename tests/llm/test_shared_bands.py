import random
from itertools import pairwise

import numpy as np
import pytest

from spillway.llm import similar, substrings
from spillway.llm.common import Scratch

from . import helpers

KEYS = "key bigint, keys array<bigint>"


@pytest.mark.parametrize(("pairs", "bits"), [(similar.BUCKET_PAIRS, 1), (similar.BUCKET_PAIRS, 8), (8, 1)], ids=["wide buckets", "as set", "many buckets"])
def test_bands_that_keys_share_are_those_of_a_dictionary(spark, pairs, bits):
    rng = np.random.default_rng(3)
    bands = similar.Bands(5, 2)
    pool = rng.integers(-(1 << 63), 1 << 63, 300)
    rows = [(int(k), [int(x) for x in rng.choice(pool, 5)] if k % 2 else [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 5)]) for k in rng.integers(-(1 << 63), 1 << 63, 400)]
    rows += rows[:50]  # as tasks give a set that several have
    held = {}
    for key, keys in rows:
        for band in keys:
            held.setdefault(band, set()).add(key)
    want = sorted(sorted((k, min(v)) for k in v) for v in held.values() if len(v) > 1)
    out = similar.shared_bands(spark.createDataFrame(rows, KEYS).repartition(3), bands, pairs, bits).collect()
    found = {}
    for r in out:
        found.setdefault(r["band"], []).append((r["key"], r["centre"]))
    assert sorted(map(sorted, found.values())) == want and len(want) > 200
    assert similar.shared_bands(spark.createDataFrame([], KEYS), bands).count() == 0


def test_components_of_one_task_are_those_of_rounds(spark):
    rng = random.Random(5)
    keys = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
    links = [(rng.choice(keys[:200]), rng.choice(keys[:200])) for _ in range(120)] + list(pairwise(keys[200:]))
    edges = spark.createDataFrame(links, "a bigint, b bigint")
    linked = {k for a, b in links if a != b for k in (a, b)}
    want = {k: c for k, c in helpers.components(keys, links).items() if k in linked}
    for name, few in (("one", similar.LINKS), ("many", 0)):
        assert {r["key"]: r["component"] for r in similar.connect(Scratch(spark, "test"), edges, name, few=few).collect()} == want
    assert similar.connect(Scratch(spark, "test"), edges.limit(0), "none").count() == 0


def test_texts_are_cut_once_before_banding_and_once_for_units(spark, monkeypatch):
    """A pass over all texts costs more CPU than the table that spares it."""
    frame = type(spark.range(1))
    passes, old = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a: (passes.append(self.columns), old(self, *a))[1])
    rows = [(k, helpers.prose(random.Random(k % 3), 120)) for k in range(6)]
    assert substrings.shared_passages(spark, spark.createDataFrame(rows, helpers.SCHEMA)).count() == 6
    assert passes.count(["who", "tag", "text"]) == 2
