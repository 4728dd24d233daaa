import numpy as np

from spillway.llm import similar
from spillway.llm.common import mix

FREE = np.uint64(np.iinfo(np.uint64).max)


def plain(elements, t):
    """A set's sketch, a round and an element at a time."""
    out = [FREE] * t
    for i in range(2 * t):
        if FREE not in out:
            break
        with np.errstate(over="ignore"):
            h = mix(elements + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        for x in h:
            at = int(x & np.uint64(0xFFFF)) % t if i < t else i - t
            out[at] = min(out[at], (np.uint64(i) << np.uint64(48)) | (x >> np.uint64(16)))
    return out


def test_sketches_are_those_of_single_sets():
    rng = np.random.default_rng(1)
    sizes = rng.choice([1, 2, 7, 40, 300], 60)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = rng.integers(0, 1 << 63, offsets[-1], dtype=np.uint64)
    for t in (1, 6, 60):
        want = [plain(flat[a:b], t) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert (similar.sketch(flat, offsets, t) == np.array(want, np.uint64)).all()
        assert (similar.sketch(flat, offsets[1:], t) == np.array(want[1:], np.uint64)).all()
    assert similar.sketch(flat, offsets[:1], 6).shape == (0, 6)
