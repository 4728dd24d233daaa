import random

import sentencepiece as spm

from spillway.llm import queries, sentencepiece


def test_pre_tokens_are_cut_beside_punctuation_with_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(sentencepiece, "MEMO", 200)
    model = sentencepiece.read_model(queries.PIECES)
    codec, reference = sentencepiece.Codec(model), spm.SentencePieceProcessor(model_proto=model.content)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abz09.,;:'\"()\n\t #é—ñ▁_-@/中\x00\x01😀  ") for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    texts += ["".join(rng.choice(model.pieces).text.replace("▁", " ") for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    texts += ["one.\ntwo three.\none", "", None, "two.\nthree"]
    for start in range(0, len(texts), 100):
        some = texts[start : start + 100]
        ids, words, _ = codec.encode_block(some)
        sentencepiece.check(codec, reference, some, ids, words)
        assert [k.tolist() for k in ids] == [reference.encode(t) if t else [] for t in some]
    assert {"▁one", "\n", "two"} <= set(codec.memo.words)  # not ▁one.\ntwo


def test_pre_tokens_in_use_stay_when_the_memo_is_full(monkeypatch):
    monkeypatch.setattr(sentencepiece, "MEMO", 50)
    codec = sentencepiece.Codec(sentencepiece.read_model(queries.PIECES))
    for k in range(5):
        ids, words, same = codec.encode_block([f"the the of of w{k}x{j}" for j in range(60)])
        assert all(same) and ("▁the" in words) == (k == 0)
        assert codec.known == len(codec.memo.words) < 130
