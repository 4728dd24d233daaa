import numpy as np

from spillway.llm import similar


def one_by_one(key, component, asks, sets, percent):
    out, group = [], component.copy()
    for k in np.flatnonzero(asks):
        for other in np.flatnonzero(~asks):
            if group[other] != group[k] and similar.similar(sets[k], sets[other], percent):
                out.append((min(key[k], key[other]), max(key[k], key[other])))
                group[group == group[other]] = group[k]
    return out


def test_links_of_a_block_are_those_found_one_by_one(monkeypatch):
    rng = np.random.default_rng(3)
    for limit in (1, 200, 1 << 20):
        monkeypatch.setattr(similar, "LOOKED_UP", limit)
        for _ in range(20):
            n = 60
            base = rng.integers(0, 1 << 60, (4, 40)).astype(np.uint64)
            sets = []
            for _ in range(n):
                s = base[rng.integers(4)].copy()
                s[: rng.integers(0, 12)] = rng.integers(0, 1 << 60)
                sets.append(np.unique(s[: rng.integers(1, 41)] if rng.random() < 0.2 else s))
            key, component, asks = rng.permutation(n), rng.integers(0, 30, n), rng.random(n) < 0.5
            found = similar.block_links(key, component, asks, np.zeros((n, 4), np.uint8), sets, 4, 75)
            assert found == one_by_one(key, component, asks, sets, 75) and found
