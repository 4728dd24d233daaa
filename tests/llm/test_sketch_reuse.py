import random

import pytest

from spillway.llm import similar, substrings

from . import helpers


@pytest.mark.parametrize("known", [substrings.KNOWN, 3], ids=["all remembered", "few remembered"])
def test_a_task_sketches_copies_once(spark, monkeypatch, known):
    rng = random.Random(8)
    common = [helpers.prose(rng, rng.randrange(20, 300)) for _ in range(12)]
    rows = [(k, k, rng.choice(common) if k % 3 else helpers.prose(rng, 90)) for k in range(120)]
    docs = spark.createDataFrame(rows, "who bigint, tag bigint, text string").coalesce(1)
    out = substrings.sketches(docs, substrings.BANDS, substrings.SHINGLE, 4096, known).collect()
    cut = {k: substrings.Paragraphs(substrings.Words([t.encode()]), substrings.SHINGLE) for k, _, t in rows}
    places = [(k, n) for k, c in cut.items() for n in range(len(c.first))]
    assert sorted((r["who"], r["number"]) for r in out) == places
    assert all(bytes(r["digest"]) == similar.set_digest(cut[r["who"]].set(r["number"])) for r in out)
    sketched = {}
    for r in out:
        want = similar.sketch_columns([cut[r["who"]].set(r["number"])], substrings.BANDS)
        assert r["n_shingles"] == want[0][0].as_py()
        if r["keys"] is not None:
            sketched.setdefault(bytes(r["digest"]), []).append(r)
            assert r["keys"] == want[2][0].as_py() and bytes(r["marks"]) == want[3][0].as_py()
    assert set(sketched) == {bytes(r["digest"]) for r in out}  # none is left without
    if known > 3:
        assert all(len(v) == 1 for v in sketched.values())
