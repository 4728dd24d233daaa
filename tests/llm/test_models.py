"""Scores against a model with exact counts, and what the url trees learn."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from spillway.llm import lm, queries, sentencepiece, tokens, urls

from . import helpers


def quantised(count):
    return float(lm.counts_of(lm.levels_of(np.array([count])))[0]) if count else 0.0


def exact_scores(rows, prior):
    said = {k: [*(t or "").translate({c: c + 32 for c in range(65, 91)}).split(), ""] for k, t in rows}
    train = {k: zlib.crc32(str(k).encode()) % 10 != 0 for k in said}
    ones = Counter(w for k, words in said.items() if train[k] for w in words)
    twos = Counter(p for k, words in said.items() if train[k] for p in zip(["", *words], words))
    scale = sum(ones.values()) + 0.1 * (len(ones) + 1)
    out = {}
    for k, words in said.items():
        total = 0.0
        for before, now in zip(["", *words], words):
            context = quantised(ones[before])
            pair = min(quantised(twos[before, now]), context)
            total += math.log10((pair + prior * (quantised(ones[now]) + 0.1) / scale) / (context + prior))
        out[k] = total
    return out


@pytest.mark.parametrize("broadcast", [128 << 20, 0], ids=["broadcast", "routed"])
def test_scores_are_those_of_the_exact_quantised_model(spark, broadcast):
    rng = random.Random(3)
    rows = [(k, helpers.prose(rng, rng.randrange(0, 120), 50)) for k in range(60)] + [(90, None), (91, ""), (92, "W1 w1 W2")]
    # so many bits a key that no absent one is found
    settings = lm.Settings(bits=400, probes=12, block_bytes=1500, broadcast_bytes=broadcast, shard_tokens=500)
    out = {r["doc_id"]: r["score"] for r in lm.log_frequency_scores(spark, spark.createDataFrame(rows, helpers.SCHEMA), settings).collect()}
    want = exact_scores(rows, settings.prior)
    assert out.keys() == want.keys() and all(math.isclose(out[k], want[k], rel_tol=1e-9) for k in want)


def test_trees_tell_urls_apart_where_they_differ(spark):
    rng = random.Random(2)
    rows = [(f"https://{'win' if bad else 'news'}{rng.randrange(50)}.{rng.choice(['xyz', 'com'] if bad else ['com', 'org'])}/{'x' * rng.randrange(9)}{rng.randrange(10**6) if bad else ''}", bad) for bad in [True, False] * 300]
    labelled = spark.createDataFrame(rows, "url string, label boolean")
    assert urls.held_out_auc(labelled) > 0.9
    noise = spark.createDataFrame([(u, rng.random() < 0.5) for u, _ in rows], "url string, label boolean")
    assert 0.35 < urls.held_out_auc(noise) < 0.65
    assert urls.held_out_auc(labelled.where("label")) is None and urls.held_out_auc(labelled.limit(0)) is None


def test_token_counts_are_near_those_of_the_tokenizer(spark, sf_dir):
    """The public model's pieces are merged by rank; the counts of likeliest segmentations estimate its own."""
    rows = queries.table(spark, sf_dir, "documents").collect()
    codec = sentencepiece.Codec(sentencepiece.read_model(queries.PIECES))
    ids, _, _ = codec.encode_block([r["text"] for r in rows])
    want = {r["doc_id"]: len(k) for r, k in zip(rows, ids, strict=True)}
    out = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(spark, queries.table(spark, sf_dir, "documents"), queries.PIECES).collect()}
    assert abs(sum(out.values()) / sum(want.values()) - 1) < 0.02
    # a tokenizer has tokens of white space too
    apart = sorted(abs(out[k] - n) / n for k, n in want.items() if n >= 50)
    assert apart[len(apart) // 2] < 0.03
