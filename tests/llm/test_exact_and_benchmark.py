import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spillway.llm import decontaminate, exact

from . import helpers


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contaminated(docs, items, window=13):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, said in items:
            v = words(said)
            for i in range(max(0, len(v) - window) + 1 if v else 0):
                win = v[i : i + window]
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        found.add(str(item))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_is_that_of_brute_force(spark):
    rng = random.Random(2)
    items = [(k, helpers.prose(rng, rng.choice([1, 2, 5, 12, 13, 14, 40]), 60)) for k in range(25)] + [(30, None), (31, ""), (32, "... !"), (3, "Zweiter Text ÄÖ, ß"), (33, "a a a a a a a a a a a a a a a")]
    docs = []
    for k in range(120):
        text = helpers.prose(rng, rng.randrange(0, 80), 60)
        if rng.random() < 0.6:
            text += rng.choice([" ", "; ", "\x7f"]) + (rng.choice(items)[1] or "").upper() + "." + helpers.prose(rng, rng.randrange(0, 300), 60)
        docs.append((k, text))
    docs += [(200, None), (201, ""), (202, "zweiter, text ÄÖ -- ß"), (None, docs[0][1]), (203, "a " * 400), (0, docs[0][1]), (0, "another a a a a a a a a a a a a a a a")]
    out = decontaminate.contamination(spark, spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    got = [tuple(r)[:6] for r in out.collect()]
    assert sorted(got, key=str) == contaminated(docs, items)


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    rows = [(1, "x One, two  three! y", "p"), (2, "one two", "q"), (3, None, "r"), (None, "one two three", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    kept = decontaminate.decontaminate(spark, docs, bench)
    assert kept.columns == docs.columns and sorted(r["digest"] for r in kept.collect()) == ["q", "r"]
    spans = {r["digest"]: r["text"] for r in decontaminate.decontaminate(spark, docs, bench, mode="spans").collect()}
    assert spans == {"p": "x ,   ! y", "q": "one two", "r": None, "s": "  "}
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(spark, docs, empty).count() == 4
    assert decontaminate.contamination(spark, docs.limit(0), bench).count() == 0


def groups(rows):
    out = []
    for key, text in rows:
        same = [k for k, t in rows if (t or "") == (text or "")]
        keep = max((k for k in same if k is not None), default=None)
        out.append((key, keep, len(same), key == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact.sha256, lambda text: F.substring(F.coalesce(text, F.lit("")), 1, 2).cast("binary")], ids=["sha256", "colliding"])
def test_exact_groups(spark, digest):
    rows = [*helpers.corpus(7), (900, "dup"), (901, "dup"), (901, "dup"), (None, "dup"), (None, "lone"), (902, "Dup"), (903, "du"), (904, "dup ")]
    out = exact.exact_groups(spark, spark.createDataFrame(rows, helpers.SCHEMA), digest=digest).drop("locator")
    assert sorted(map(tuple, out.collect()), key=str) == groups(rows)


def test_stream_resumes(spark, tmp_path):
    """State outlives a stop: a second run sees what the first one kept."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for rows in ([(1, "a"), (2, "b")], [(5, "a"), (3, "c")]):
        exact.arrivals(spark.createDataFrame(rows, helpers.SCHEMA)).write.mode("append").parquet(source)
        exact.run_stream(spark, spark.readStream.schema(exact.ARRIVALS).parquet(source), target, checkpoint)
    state = {r["last"]["doc_id"]: r["seen"] for r in exact.latest(spark, target).collect()}
    assert state == {5: 2, 2: 1, 3: 1}


def test_drop_exact(spark):
    rows = [(1, "t", "a"), (2, "t", "b"), (2, "t", "c"), (3, None, "d"), (4, "", "e"), (5, "u", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    left = exact.drop_exact_duplicates(spark, docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(2, "t"), (4, ""), (5, "u")]
    assert exact.exact_groups(spark, docs.limit(0)).count() == 0
