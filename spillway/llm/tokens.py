"""Token counts by a unigram segmentation whose forward scores are shared over a trie of distinct pre-tokens.

Pre-tokens are words of non-space characters after a word marker. Each task collects the distinct pre-tokens of a
block of texts, walks their trie depth first (in sorted order, where neighbours share their longest prefix), and
extends one column of forward scores per trie node. A pre-token's count is read off at its terminal node. Texts are
not shuffled and a block bounds a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Vocabulary, blocks, pick
from .sentencepiece import BYTE, CONTROL, UNKNOWN, UNUSED, Model, read_model

MARK = "▁"


#: Words whose counts a Python worker keeps between blocks; beyond, it starts anew. Results don't depend on it.
MEMO = 400_000
#: Key of a piece's score in its node of the trie of pieces.
SCORE = 0


@dataclass(frozen=True)
class Pieces:
    """Log scores of pieces, and the score of one byte of a character that no piece covers."""

    scores: dict[str, float]
    byte_score: float

    def trie(self) -> dict:
        root: dict = {}
        for text, score in self.scores.items():
            node = root
            for c in text:
                node = node.setdefault(c, {})
            node[SCORE] = score
        return root


def pieces_of(model: Model) -> Pieces:
    """Unigram scores of a model. A merge-ranked model has ranks for scores: rank r gets the log of its share under
    Zipf's law, 1 / (r + 1) over the sum of these. A byte costs 10 more than the least likely piece."""
    normal = [p for p in model.pieces if p.kind not in (UNKNOWN, CONTROL, UNUSED, BYTE) and p.text]
    if model.unigram:
        scores = {p.text: p.score for p in normal}
    else:
        ranked = sorted(normal, key=lambda p: (-p.score, p.text))
        total = math.log(sum(1 / (r + 1) for r in range(len(ranked))) or 1)
        scores = {p.text: -math.log(r + 1) - total for r, p in enumerate(ranked)}
    return Pieces(scores, min(scores.values(), default=0.0) - 10.0)


def count_words(words: list[str], trie: dict, byte_score: float) -> list[int]:
    """Tokens of each distinct word's best segmentation: most score, then fewest tokens.

    In sorted order a word shares its longest prefix with the one before. For each character of the path the forward
    score, its tokens, and the open matches (start, node of the piece trie) are kept; a word extends what it shares.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    out = [0] * len(words)
    score, tokens, opened, path = [0.0], [0], [[]], ""
    for at in order:
        word = words[at]
        shared = 0
        for a, b in zip(word, path):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], tokens[shared + 1 :], opened[shared + 1 :]
        for stop in range(shared, len(word)):
            c = word[stop]
            size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
            best, fewest = score[stop] + size * byte_score, tokens[stop] + size
            matches = []
            for start, node in (*opened[stop], (stop, trie)):
                node = node.get(c)
                if node is not None:
                    matches.append((start, node))
                    own = node.get(SCORE)
                    if own is not None:
                        total = score[start] + own
                        if total > best or (total == best and tokens[start] + 1 < fewest):
                            best, fewest = total, tokens[start] + 1
            score.append(best)
            tokens.append(fewest)
            opened.append(matches)
        out[at] = tokens[-1]
        path = word
    return out


class Counter:
    """Counts of distinct pre-tokens, made once per worker; keeps the terminal counts of what it has seen."""

    made: dict[tuple, Counter] = {}

    def __init__(self, pieces: Pieces):
        self.trie, self.byte_score, self.memo = pieces.trie(), pieces.byte_score, {}

    @classmethod
    def of(cls, pieces: Pieces) -> Counter:
        key = (len(pieces.scores), hash(frozenset(pieces.scores.items())))
        if key not in cls.made:
            cls.made.clear()
            cls.made[key] = cls(pieces)
        return cls.made[key]

    def counts(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.memo]
        found = count_words([MARK + w.decode("utf-8", "surrogatepass") for w in new], self.trie, self.byte_score)
        if len(self.memo) + len(new) > MEMO:
            old = {w: self.memo[w] for w in words if w in self.memo}
            self.memo = old
        self.memo.update(zip(new, found, strict=True))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))


def token_counts(spark: SparkSession, docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens.

    Null and empty texts and such of white space alone have none of either. Rows may repeat; a null doc_id stays. The
    vocabulary is read on the driver and sent with the function; its size is the model's, whatever the data's.
    """
    pieces = pieces_of(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(pieces)
        for ids, texts in blocks(batches, limit):
            vocabulary = Vocabulary()
            seqs = [vocabulary.ids(text.split()) if text else np.empty(0, np.int32) for text in texts]
            counts = counter.counts(vocabulary.words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in seqs], pa.int64()), pa.array([int(counts[s].sum()) for s in seqs], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    texts = pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return texts.mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")
