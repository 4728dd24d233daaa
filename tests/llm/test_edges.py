"""Empty tables, clashing columns, ties and long texts, for every operator and stage."""

import random

import pytest

import corpus_pipeline
from spillway.llm import decontaminate, exact, language, lm, minhash, queries, secrets, sentencepiece, substrings, tokens, urls

from . import helpers

CLASH = ["digest", "key", "tag", "kept", "spans", "score", "keep", "w", "upto", "block", "class", "name", "url", "host", "rule", "verdict", "probability", "found", "ids", "lang_pred", "rejected", "seen", "n", "__id", "__sha", "__digest", "__spans", "__gone", "__tag", "__who", "__cuts", "__row"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(1)
    common = helpers.prose(rng, 70)
    rows = [(1, common), (2, common), (3, f"secret=abcdefgh1 {helpers.prose(rng, 60)}"), (4, None), (None, common), (5, ""), (6, helpers.prose(rng, 30))]
    data = [(k, t, *[f"{c} of row {n}" for c in CLASH]) for n, (k, t) in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(["doc_id bigint", "text string", *[f"`{c}` string" for c in CLASH]]))


def benchmark(spark):
    return spark.createDataFrame([(1, "w1 w2"), (2, None)], "item_id bigint, text string")


def operators(spark):
    """Each from documents to one row per document."""
    words = language.learn(spark.createDataFrame([(k, "one two three words", "en") for k in range(9)], "doc_id bigint, text string, lang string"))
    return {
        "contamination": lambda d: decontaminate.contamination(spark, d, benchmark(spark)),
        "token_counts": lambda d: tokens.token_counts(spark, d, queries.PIECES),
        "near_duplicates": lambda d: minhash.near_duplicates(spark, d),
        "exact_groups": lambda d: exact.exact_groups(spark, d),
        "scores": lambda d: lm.log_frequency_scores(spark, d),
        "secrets": lambda d: secrets.secrets(spark, d),
        "identify": lambda d: language.identify(spark, d, words),
        "encode": lambda d: sentencepiece.encode(spark, d, queries.PIECES),
    }


def test_clashing_columns_and_empty_tables(spark, wide):
    plain = wide.select("doc_id", "text")
    for name, run in operators(spark).items():
        want = sorted(map(str, run(plain).drop("locator").collect()))
        assert sorted(map(str, run(wide).drop("locator").collect())) == want and len(want) == 7, name
        assert run(wide.limit(0)).count() == 0, name
    assert substrings.shared_passages(spark, wide).count() == 3


@pytest.mark.parametrize("keep", [
    lambda s, d: decontaminate.decontaminate(s, d, benchmark(s)),
    lambda s, d: decontaminate.decontaminate(s, d, benchmark(s), mode="spans"),
    lambda s, d: exact.drop_exact_duplicates(s, d.unionByName(d.where("doc_id = 6"))),
    lambda s, d: minhash.drop_near_duplicates(s, d),
    lambda s, d: substrings.remove_shared(s, d),
], ids=["documents", "spans", "exact", "near", "passages"])
def test_what_stays_keeps_its_columns(spark, wide, keep):
    out = keep(spark, wide)
    rows = out.collect()
    assert out.columns == wide.columns and len(rows) >= 4
    assert all(r[c] == f"{c} of row {r['n'].rsplit(' ', 1)[1]}" for r in rows for c in CLASH)
    assert keep(spark, wide.limit(0)).count() == 0


def test_urls_with_clashing_columns(spark, wide):
    pages = wide.selectExpr("doc_id AS page_id", "concat('https://a.org/', doc_id) AS url", "`host`", "`rule`", "`verdict`", "`probability`", "`key`")
    out = urls.judge(spark, pages, queries.RULES, None)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "probability"] and out.count() == 7
    long = spark.createDataFrame([(1, "https://b.net/" + "a/1?" * 500_000), (2, None)], "page_id bigint, url string")
    model = urls.Trees().fit(["https://x.com/1", "https://y.org/a"] * 30, [True, False] * 30)
    assert [r["rule"] for r in urls.judge(spark, long, queries.RULES, model).collect()] == [None, None]
    assert urls.judge(spark, long.limit(0), queries.RULES, model).count() == 0


def test_long_texts(spark):
    rng = random.Random(2)
    long = helpers.prose(rng, 500_000)
    other = " ".join(long.split(" ")[:400_000] + ["password = hunter2hunter2"])
    docs = spark.createDataFrame([(1, long), (2, long), (3, other), (4, "é" * 1_000_000), (5, "x " * 500_000)], helpers.SCHEMA)
    for name, run in operators(spark).items():
        assert run(docs).count() == 5, name
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, docs).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    found = {r["doc_id"]: r["n_words"] for r in substrings.shared_passages(spark, docs).collect()}
    assert found == {1: 500_000, 2: 500_000, 3: 400_000}


def test_ties_of_languages(spark):
    """Equal dictionaries encode equally: the first name wins with score 0, and any margin rejects it."""
    same = b"one two three four five six seven eight " * 20
    docs = spark.createDataFrame([(1, "one two three four"), (2, "1 2 3"), (3, None)], helpers.SCHEMA)
    out = {r["doc_id"]: tuple(r)[1:] for r in language.identify(spark, docs, {"b": same, "a": same, "c": same}, 0.001).collect()}
    assert out == {1: ("a", 0.0, True), 2: ("und", 0.0, True), 3: ("und", 0.0, True)}


def test_pipeline_over_an_empty_table(spark, tmp_path, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    queries.table(spark, sf_dir, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    _, encode = corpus_pipeline.STAGES[-1]
    assert {"doc_id", "ids"} <= set(encode(spark, docs, sf_dir).columns) and encode(spark, docs, sf_dir).count() == 0
