"""Brute-force versions, in plain Python over lists of (doc_id, text)."""

import itertools
import random
import re

SCHEMA = "doc_id bigint, text string"


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(keys, links):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in keys}


def near(rows, percent=75, n=5):
    sets = {k: shingles(t, n) for k, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    at = components(sets, links)
    return {k: (len(sets[k]), at[k], at[k] == k) for k in sets}


def prose(rng, words, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=0, families=12, singles=25):
    """Families of copies with a few to many edits, chains of edits, lone texts, short and empty ones, nulls."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(singles)]
    for _ in range(families):
        base = prose(rng, rng.randrange(20, 250))
        texts += [base] * rng.randrange(1, 4) + [edited(rng, base, rng.randrange(0, 9)) for _ in range(rng.randrange(2, 9))]
        step = base
        for _ in range(6):  # a chain whose ends are far apart
            step = edited(rng, step, 3)
            texts.append(step)
    texts += ["", "", None, None, "  \n\t ", "one", "ONE", "one two", "one  two", "é É", "\u00a0x", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))
