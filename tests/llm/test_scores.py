import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spillway.llm import language, lm, queries, urls

from . import helpers


def base(rows):
    def tokens(text):
        return [*(text or "").encode().lower().split(), b""]

    train = Counter(t for k, text in rows if k is None or zlib.crc32(str(k).encode()) % 10 for t in tokens(text))
    n, v = sum(train.values()), len(train)
    out = []
    for k, text in rows:
        ts = tokens(text)
        out.append((k, k is not None and zlib.crc32(str(k).encode()) % 10 == 0, len(ts), sum(train[t] > 0 for t in ts), n, round(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [lm.Settings(), lm.Settings(block_bytes=2000, shard_tokens=500), lm.Settings(block_bytes=2000, shard_tokens=500, broadcast_bytes=0)], ids=["one", "shards", "routed"])
def test_base_scores_are_exact(spark, settings):
    rows = [*helpers.corpus(11, families=6), (None, "w1 w2"), (1, "w1 W1 \u00a0 é")]
    out = lm.log_frequency_scores(spark, spark.createDataFrame(rows, helpers.SCHEMA), settings).collect()
    assert sorted([(*tuple(r)[:5], round(r["base_score"], 6)) for r in out], key=str) == base(rows)
    assert all(r["score"] < 0 for r in out)


def test_routes_agree(spark):
    docs = spark.createDataFrame(helpers.corpus(12, families=4), helpers.SCHEMA)
    a, b = ({r["doc_id"]: r["score"] for r in lm.log_frequency_scores(spark, docs, lm.Settings(block_bytes=3000, shard_tokens=400, broadcast_bytes=limit)).collect()} for limit in (1 << 27, 0))
    assert a == pytest.approx(b, abs=1e-9)


def test_lm_edges(spark):
    assert lm.log_frequency_scores(spark, spark.createDataFrame([], helpers.SCHEMA)).count() == 0
    only_held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    (row,) = lm.log_frequency_scores(spark, spark.createDataFrame([(only_held, "a b")], helpers.SCHEMA)).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)


def test_filter_gives_quantised_counts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    counts = rng.integers(1, 1000, 5000)
    segment = lm.make_segment(keys, counts, lm.Settings())
    levels = lm.probe_segment(segment, keys, lm.Settings())
    assert (levels >= lm.levels_of(counts)).all() and (levels == lm.levels_of(counts)).mean() > 0.95
    absent = lm.probe_segment(segment, rng.integers(0, 2**63, 5000).astype(np.uint64), lm.Settings())
    assert (absent > 0).mean() < 0.05


def test_packing():
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm.unpack(lm.pack(x, True), np.uint64, True) == x).all()
    assert len(lm.unpack(lm.pack(x[:0]), np.uint64)) == 0


def test_bigrams_help(spark, sf_dir):
    out = queries.op7_lm_scores(spark, sf_dir).agg(F.sum("base_score").alias("base"), F.sum("score").alias("model")).first()
    assert out["model"] > out["base"]


def test_language_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables hold out forty documents
    docs = queries.table(spark, sf_dir, "documents")
    out = queries.op9_language(spark, sf_dir).where("held_out").join(docs.where("lang is not null"), "doc_id")
    hits = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert hits["a"] > 0.95 and 0 <= hits["lo"] <= hits["hi"] <= 1


def test_language_edges(spark):
    rows = [(1, "the house and the garden", "en", "x"), (2, "das haus und der garten", "de", "y"), (3, None, "en", "z"), (4, "123 !!", None, ""), (None, "the garden", None, ""), (5, "", "fr", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    known = language.learn(docs.select("doc_id", "text", "lang"))
    assert set(known) == {"en", "de"}
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark, docs, known).collect()}
    assert out == {1: "en", 2: "de", 3: "und", 4: "und", None: "en", 5: "und"}
    kept = language.keep_identified(spark, docs, known)
    assert kept.columns == docs.columns and kept.count() == 3
    assert language.learn(docs.limit(0).select("doc_id", "text", "lang")) == {}
    assert {r["lang_pred"] for r in language.identify(spark, docs, {}).collect()} == {"und"}


def test_dictionary_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more", "en") for k in range(500)], "doc_id bigint, text string, lang string")
    assert len(language.learn(docs, documents=10)["en"]) < 10 * 20


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def test_rules_by_hand(spark):
    said = ["https://A.example.ORG/es/1?x=/en/1", "http://example.org/en/12", "http://example.org/en/2", "http://xexample.org/es/", "https://www.b.com/fr/1", "https://com/de/2", "https://a.com/dE/2", "http://a.org", "http://a.org?x", None, "", "nothing", "a://b://c/d", "http://ä.org/ü#x", "http://a.net\n/en/1"]
    pages = spark.createDataFrame(list(enumerate(said)), "page_id bigint, url string")
    out = {r["page_id"]: r for r in urls.judge(spark, pages, queries.RULES, None).collect()}
    for k, url in enumerate(said):
        host, path = by_hand(url)
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (out[k]["host"], out[k]["path"], out[k]["rule"], out[k]["verdict"]) == (host, path, best and best.name, best.verdict if best else "allow"), url


def test_trees_learn_from_lexical_features(spark):
    rng = random.Random(0)
    rows = [(f"http://s{k}.example.{'biz' if k % 2 else 'net'}/" + "".join(rng.choice("0123456789" if k % 2 else "abc") for _ in range(12)) + "?a=1" * (k % 3), k % 2 == 1) for k in range(600)] + [(None, True), ("http://x", None)]
    model = urls.fit(spark.createDataFrame(rows, "url string, label boolean"))
    fresh = ["http://new.example.biz/123456789012", "http://new.example.net/abcabcabcabc", None, ""]
    p = model.probability(fresh)
    assert p[0] > 0.9 and p[1] < 0.1 and len(p) == 4
    pages = spark.createDataFrame(list(enumerate([*fresh, fresh[0]])), "page_id bigint, url string")
    assert [r["verdict"] for r in sorted(urls.judge(spark, pages, [], model).collect())][:2] == ["block", "allow"]
    assert urls.fit(spark.createDataFrame([], "url string, label boolean")) is None
    assert urls.judge(spark, pages.limit(0), [], model).count() == 0


def test_url_query_covers_all_pages(spark, sf_dir):
    assert queries.op2_url_filter(spark, sf_dir).count() == queries.table(spark, sf_dir, "pages").count()
