import numpy as np

from spillway.llm import common, lm


def test_places_of_what_a_block_asks_come_from_one_sort(monkeypatch):
    texts = [b"a b a b c", b"", b"b a", b"c c c"]
    vocabulary = common.Vocabulary()
    seqs = [vocabulary.ids([*t.split(), lm.END]) for t in texts]
    words = vocabulary.words
    block = lm.Block({"block": 1, "doc_ids": [1, 2, 3, 4], "held": [False] * 4, "sizes": [len(s) for s in seqs], "tokens": lm.pack(np.concatenate(seqs)), "words": words, "train": [1] * len(words)})
    monkeypatch.setattr(np, "unique", None)  # slow on large arrays
    keys, at, own = lm.asked(block)
    assert (keys[1:] > keys[:-1]).all() and set(keys) == {*block.pairs(), *block.hashes}
    assert (keys[at] == block.pairs()).all() and (keys[own] == block.hashes).all()


def test_distinct_is_sorted_and_takes_nothing_too():
    x = np.array([3, 1, 3, 2, 1], np.uint64)
    assert common.distinct(x).tolist() == [1, 2, 3] and x.tolist() == [3, 1, 3, 2, 1]
    assert common.distinct(x[:0]).tolist() == []
