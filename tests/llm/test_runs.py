import random

import pytest

from spillway.llm import passages

from . import helpers


def planted(seed):
    """Passages of 50 words and more, in long lines, over short lines, and at the edges of texts."""
    rng = random.Random(seed)
    common = [[f"p{k}w{rng.randrange(400)}" for _ in range(rng.randrange(50, 90))] for k in range(6)] + [["na"] * 60]
    rows = []
    for k in range(50):
        words = helpers.prose(rng, rng.randrange(0, 300)).split()
        for passage in rng.sample(common, rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if k % 3 == 0 else w for w in passage]
        if k % 7 == 0:
            words += ["é🙂"] * 3
        text, step = "", rng.choice([5, 9, 10**6])  # lines of under 10 words, or one line
        for n, w in enumerate(words):
            text += w + ("\n" if n % step == step - 1 else rng.choice([" ", "  ", "\t"]))
        rows.append((k, ("é " if k % 5 == 0 else "") + text))
    return [*rows, (100, None), (101, ""), (102, " ".join(common[0][:50])), (None, " ".join(common[0]))]


def spans(text):
    at, out = 0, []
    for w in (text or "").split():
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_every_run_of_fifty_words_holds_a_unit(spark, seed):
    rows = [r for r in planted(seed) if r[0] is not None]
    texts = dict(rows)
    docs = spark.createDataFrame(planted(seed), helpers.SCHEMA)
    found = passages.repeats(spark, docs).where("unit = 'run'").collect()
    units = {}
    for r in found:
        said = lambda key, start, n=25: texts[key][start:].lower().split()[:n]
        assert texts[r.doc_id][r.start : r.end].lower().split() == said(r.doc_id, r.start) == said(r.keep_doc_id, r.keep_start)
        assert r.removed == ((r.doc_id, r.start) != (r.keep_doc_id, r.keep_start)) and r.occurrences > 1 and r.par is None
        units.setdefault(r.doc_id, []).append((r.start, r.end))
    windows = {}
    for key, text in rows:
        words = (text or "").lower().split()
        for i in range(len(words) - 49):
            windows.setdefault(tuple(words[i : i + 50]), []).append((key, i))
    shared = [places for places in windows.values() if len({k for k, _ in places}) > 1]
    assert len(shared) > 50
    for places in shared:
        for key, i in places:
            at = spans(texts[key])
            lo, hi = at[i][0], at[i + 49][1]
            if len(set(texts[key][lo:hi].lower().split())) > 1:
                assert any(lo <= s and e <= hi for s, e in units[key]), (key, i)
            else:  # of equal units that overlap one is given
                assert any(s < hi and lo < e for s, e in units[key]), (key, i)


def test_no_texts(spark):
    assert passages.repeats(spark, spark.createDataFrame([], helpers.SCHEMA)).count() == 0
