import numpy as np
import pytest
import sentencepiece as spm

from spillway.llm import queries, sentencepiece


def test_a_wrong_pre_token_is_found_wherever_it_stands():
    model = sentencepiece.read_model(queries.PIECES)
    codec = sentencepiece.Codec(model)
    reference = spm.SentencePieceProcessor(model_proto=model.content)
    texts = [" ".join(f"w{k}" for k in range(500)), "a   b  c ", "▁▁x  ▁y", "null\x00in  it", None, ""]
    ids, words, _ = codec.encode_block(texts)
    sentencepiece.check(codec, reference, texts, ids, words)
    at = [k for k, w in enumerate(words) if w.startswith("▁▁")][0]
    for k in (300, at):  # beyond the first 64, and one of several markers
        pool = codec.pools[0].copy()
        codec.pools[0][codec.begins[0][k]] += 1
        with pytest.raises(ValueError):
            sentencepiece.check(codec, reference, texts, ids, words)
        codec.pools[0] = pool
    codec.cut = False
    with pytest.raises(ValueError):
        sentencepiece.check(codec, reference, ["one two"], [np.array([1])], [])


def test_unigram_texts_are_checked_whole():
    from .test_texts import unigram_model

    model = sentencepiece.parse_model(unigram_model())
    codec, reference = sentencepiece.Codec(model), spm.SentencePieceProcessor(model_proto=unigram_model())
    texts = ["the cab", "  a  b ", "é the", "thebc abab", ""]
    ids, words, _ = codec.encode_block(texts)
    sentencepiece.check(codec, reference, texts, ids, words)
    with pytest.raises(ValueError):
        sentencepiece.check(codec, reference, texts, [*ids[1:], ids[0]], words)
