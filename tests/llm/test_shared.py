import random
import re

import pytest

from spillway.llm import substrings
from spillway.llm.common import Scratch

from . import helpers
from .test_runs import planted

LEAST = substrings.LEAST
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def places(text):
    """Start, end and word of each word."""
    return [(m.start(), m.end(), m[0].translate(LOWER)) for m in WORD.finditer(text or "")]


def windows(rows):
    """All (doc, first word, upto) of stretches of LEAST words that another document has, with the least such document."""
    holders = {}
    for key, text in rows:
        words = [w for _, _, w in places(text)]
        for i in range(len(words) - LEAST + 1):
            holders.setdefault(tuple(words[i : i + LEAST]), []).append((key, i))
    return [(k, i, i + LEAST, min(h)[0]) for h in holders.values() if len({x for x, _ in h}) > 1 for k, i in h]


def islands(rows, found):
    """Rows as shared_passages gives them, from pieces (doc, w, upto, first); ids are unique."""
    out = []
    for key, text in rows:
        at, current = places(text), None
        for _, w, upto, first in sorted(p for p in found if p[0] == key):
            if current and w <= current[1]:
                current = (current[0], max(current[1], upto), min(current[2], first), current[3] and first < key)
            else:
                out += [(key, at, *current)] if current else []
                current = (w, upto, first, first < key)
        out += [(key, at, *current)] if current else []
    return sorted((key, at[w][0], at[upto - 1][1], upto - w, first, gone) for key, at, w, upto, first, gone in out)


def chains(rows):
    """Pieces from paragraphs: cut as the operator cuts, compared all with all."""
    paragraphs, sets = {}, {}
    for key, text in rows:
        words = substrings.Words([(text or "").encode()])
        cut = substrings.Paragraphs(words, substrings.SHINGLE)
        said = [w for _, _, w in places(text)]
        paragraphs[key] = list(zip(cut.first.tolist(), cut.upto.tolist(), strict=True))
        for k, (w, upto) in enumerate(paragraphs[key]):
            sets[key, k] = helpers.shingles(" ".join(said[w:upto]))
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    at = helpers.components(sets, links)
    members = {}
    for (key, _), c in at.items():
        members.setdefault(c, set()).add(key)
    holders = {}
    for key, cut in paragraphs.items():
        shared = [len(members[at[key, k]]) > 1 for k in range(len(cut))]
        for i in range(len(cut)):
            j = next((j for j in range(i, len(cut)) if cut[j][1] - cut[i][0] >= LEAST), None)
            for last in (j, j + 1) if j is not None else ():
                if last < len(cut) and all(shared[i : last + 1]):
                    holders.setdefault(tuple(at[key, k] for k in range(i, last + 1)), []).append((key, cut[i][0], cut[last][1]))
    return [(*p, min(h)[0]) for h in holders.values() if len({x[0] for x in h}) > 1 for p in h]


def edited_passages(seed):
    """Long passages with a few edits, which paragraphs link, beside verbatim ones and lone texts."""
    rng = random.Random(seed)
    common = [helpers.prose(rng, rng.randrange(60, 400)) for _ in range(5)]
    rows = []
    for k in range(36):
        parts = [helpers.prose(rng, rng.randrange(0, 120))]
        if rng.random() < 0.7:
            parts += [helpers.edited(rng, rng.choice(common), rng.randrange(0, 9)), helpers.prose(rng, rng.randrange(0, 60))]
        rows.append((k, rng.choice(["\n", " ", "  "]).join(parts)))
    return rows


@pytest.mark.parametrize("rows", [planted(0), planted(1), edited_passages(2)], ids=["lines", "more lines", "edits"])
def test_verbatim_stretches_are_those_of_brute_force(spark, rows):
    rows = [r for r in rows if r[0] is not None]
    scratch = Scratch(spark, "test")
    texts = substrings.identified(spark.createDataFrame(rows, helpers.SCHEMA), "doc_id", "text")
    found = substrings.merged(substrings.held(scratch, *substrings.verbatim(scratch, texts, LEAST)), LEAST)
    out = sorted((r["who"], r["start"], r["end"], r["n_words"], r["first"], r["removed"]) for r in found.collect())
    assert out == islands(rows, windows(rows)) and len(out) > 20


@pytest.mark.parametrize("broadcast", [True, False], ids=["broadcast", "shuffled"])
def test_passages_are_those_of_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(substrings, "WIDE_BYTES", 0)
    rows = edited_passages(3)
    want = islands(rows, windows(rows) + chains(rows))
    assert sum(w[3] for w in want) > sum(w[3] for w in islands(rows, windows(rows)))  # paragraphs find more
    out = substrings.shared_passages(spark, spark.createDataFrame(rows, helpers.SCHEMA))
    assert sorted(map(tuple, out.collect())) == want
    assert all(w[3] >= LEAST for w in want)


def test_whole_copies_and_their_edges(spark):
    rng = random.Random(4)
    text, other = helpers.prose(rng, 300), helpers.prose(rng, 200)
    exact, short = " ".join(other.split()[:LEAST]), " ".join(other.split()[:LEAST - 1])
    long = " ".join(helpers.prose(rng, 40_000).split() + exact.split())
    rows = [(1, text), (2, text.upper()), (3, exact), (4, short), (5, "é " + long + "\n"), (6, ""), (7, None), (8, "na " * 500), (9, "na " * 400), (10, "no " * 90)]
    out = substrings.shared_passages(spark, spark.createDataFrame(rows, helpers.SCHEMA))
    assert sorted(map(tuple, out.collect())) == islands(rows, windows(rows))
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 5, 8, 9}


def test_repeated_and_nameless_rows(spark):
    rng = random.Random(5)
    a, b, c = (helpers.prose(rng, 80) for _ in range(3))
    rows = [(1, a, "x", 0), (1, a, "y", 1), (1, f"{b} {c}", "z", 2), (2, f"{a} {c}", None, None), (None, b, "n", 3), (None, b, "m", 4), (3, f"q {c} q", "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, who string, tag int")
    out = sorted(map(tuple, substrings.shared_passages(spark, docs).collect()), key=str)
    bc, ac = f"{b} {c}", f"{a} {c}"
    assert out == sorted([(1, 0, len(a), 80, 1, False), (1, 0, len(bc), 160, 1, False), (2, 0, len(ac), 160, 1, True), (None, 0, len(b), 80, 1, True), (3, 2, 2 + len(c), 80, 1, True)], key=str)
    left = substrings.remove_shared(spark, docs)
    assert left.columns == docs.columns
    assert sorted((r["who"] or "", r["text"]) for r in left.collect()) == [("", ""), ("k", "q  q"), ("m", ""), ("n", ""), ("x", a), ("y", a), ("z", bc)]
    only = docs.where("doc_id = 1")
    assert substrings.shared_passages(spark, only).count() == 0  # one document's repeats are none
    assert substrings.shared_passages(spark, docs.limit(0)).count() == 0 and substrings.remove_shared(spark, docs.limit(0)).count() == 0
