"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne 2007).

The corpus becomes blocks: token ids and the block's vocabulary. Each block sends its sorted distinct n-grams with
their counts, packed as deltas, to shards of the hash space. A shard sums the counts, so they are those of the whole
corpus, and answers two ways: exact unigram counts for each block that asked, and one segment of the filter. An n-gram
of count c is stored as the keys (n-gram, 1) ... (n-gram, 1 + floor(log2 c)); probing level after level gives its
quantised count back. The number of shards follows the number of training tokens, so neither a shard nor a segment
grows with the corpus. Segments are broadcast while all of them together stay below BROADCAST_BYTES; beyond that the
blocks' n-grams are sent to the segments instead, with the same answers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Vocabulary, blocks, distinct, mix, pick, word_hashes

#: All segments of a filter that is broadcast; larger ones are probed where they lie.
BROADCAST_BYTES = 128 << 20
#: Training tokens for each shard.
SHARD_TOKENS = 4_000_000
END = b""  # no word is empty
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """bits of the filter a key, probes a key, weight of the unigram prior, and one in ``held`` documents held out."""

    bits: int = 8
    probes: int = 5
    prior: float = 500.0
    held: int = 10
    block_bytes: int = 10 << 20
    broadcast_bytes: int = BROADCAST_BYTES
    shard_tokens: int = SHARD_TOKENS


# ---- packed arrays

def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Compressed bytes of an integer array; ``delta`` for sorted ones. Bytes of equal weight lie together."""
    values = np.ascontiguousarray(values)
    if delta and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind, delta: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if delta else values


# ---- filter

def probe_bits(keys: np.ndarray, level: int, probes: int, size: int) -> Iterator[np.ndarray]:
    """Bit numbers of (key, level), one array for each probe."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64((level * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
        step = mix(h) | np.uint64(1)
        for _ in range(probes):
            yield h % np.uint64(size)
            h = h + step


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def make_segment(keys: np.ndarray, counts: np.ndarray, settings: Settings) -> bytes:
    """Bits of a filter of these keys; their number follows the number of stored (key, level)."""
    levels = levels_of(counts)
    size = max(64, int(levels.sum()) * settings.bits)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in probe_bits(keys[levels >= level], level, settings.probes, size):
            bits[at.astype(np.int64)] = True
    return np.packbits(bits).tobytes() + size.to_bytes(8, "little")


def probe_segment(segment: bytes, keys: np.ndarray, settings: Settings) -> np.ndarray:
    """The last level of each key up to which all are found; 0 where the first isn't."""
    size = int.from_bytes(segment[-8:], "little")
    bits = np.frombuffer(segment, np.uint8, len(segment) - 8)
    found, active = np.zeros(len(keys), np.uint8), np.arange(len(keys))
    for level in range(1, 60):
        if not len(active):
            break
        # probe by probe, so that most absent keys cost one
        k, alive = keys[active], np.arange(len(active))
        for at in probe_bits(k, level, settings.probes, size):
            at = at[alive].astype(np.int64)
            alive = alive[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
        active = active[alive]
        found[active] = level
    return found


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level: 1, 2.5, 5.5, ..."""
    low = np.exp2(levels.astype(np.float64) - 1)
    return np.where(levels > 0, (low + 2 * low - 1) / 2, 0.0)


# ---- blocks

def held_out(key, held: int) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % held == 0


BLOCK = "block bigint, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, tokens binary, words array<binary>, train array<bigint>, train_tokens bigint"


def block_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """One row per block of documents: token ids of all texts, each closed by the end token, and the vocabulary with its
    counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(blocks(batches, settings.block_bytes)):
            vocabulary = Vocabulary()
            seqs = [vocabulary.ids([*(text or b"").lower().split(), END]) for text in texts]
            out = [held_out(key, settings.held) for key in ids]
            words = vocabulary.words
            train = np.bincount(np.concatenate([np.empty(0, np.int32), *(s for s, h in zip(seqs, out, strict=True) if not h)]), minlength=len(words))
            row = [(task << 32) | number, ids, out, [len(s) for s in seqs], pack(np.concatenate(seqs)), words, train.tolist(), int(train.sum())]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64()]
            names = [c.split()[0] for c in BLOCK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, BLOCK)


class Block:
    """A block's arrays: tokens, hashes of its words, and the pairs (context, word) as hashes."""

    def __init__(self, row: dict):
        self.number, self.ids, self.words = row["block"], row["doc_ids"], list(row["words"])
        self.held, self.sizes = np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        self.tokens, self.train = unpack(row["tokens"], np.int32), np.array(row["train"], np.int64)
        self.hashes = mix(word_hashes(self.words))
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def exact_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the words by 128-bit digest, and its halves in that order."""
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        return order, digests[order, 0], digests[order, 1]

    def pairs(self) -> np.ndarray:
        """Hash of (context, word) for each token; a text begins after an end token."""
        now = self.hashes[self.tokens]
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[self.begins] = mix(word_hashes([END]))[0]
        with np.errstate(over="ignore"):
            return mix(before * MULTIPLIER + now)

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)


def cuts(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the 2**bits shards in sorted keys: the leading bits of a key are its shard's number."""
    if not bits:
        return np.array([0, len(sorted_keys)])
    heads = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(sorted_keys, heads), [len(sorted_keys)]))


def rows_of(batches) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.slice(row, 1).to_pylist()[0]


GRAMS = "shard int, block bigint, high binary, low binary, train binary, grams binary, times binary"


def grams(table: DataFrame, bits: int) -> DataFrame:
    """For each block and shard: 128-bit keys of the block's words with their training counts, and hashes of its
    training unigrams and bigrams with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row)
            order, high, low = b.exact_keys()
            train = b.train[order]
            keys, times = np.unique(b.pairs()[b.training()], return_counts=True)
            seen = b.train > 0
            keys, times = np.concatenate((keys, b.hashes[seen])), np.concatenate((times, b.train[seen]))
            by = np.argsort(keys, kind="stable")
            keys, times = keys[by], times[by]
            x, y = cuts(high, bits), cuts(keys, bits)
            out = []
            for s in range(1 << bits):
                p, q = slice(x[s], x[s + 1]), slice(y[s], y[s + 1])
                if p.stop > p.start or q.stop > q.start:
                    out.append((s, b.number, pack(high[p], True), pack(low[p]), pack(train[p]), pack(keys[q], True), pack(times[q].astype(np.int64))))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in GRAMS.split(", ")])

    return table.mapInArrow(run, GRAMS)


ANSWERS = "kind string, shard int, block bigint, data binary, distinct bigint"


def answer(settings: Settings):
    """One shard: exact counts for each block that asked (kind counts), and the filter's segment (kind segment)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf.shard.iloc[0])
        high = [unpack(v, np.uint64, True) for v in pdf.high]
        low = [unpack(v, np.uint64) for v in pdf.low]
        train = [unpack(v, np.int64) for v in pdf.train]
        h, lo, n = np.concatenate(high), np.concatenate(low), np.concatenate(train)
        order = np.lexsort((lo, h))
        h, lo = h[order], lo[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=n[order], minlength=group[-1] + 1 if len(group) else 0).astype(np.int64)
        back = np.empty(len(h), np.int64)
        back[order] = total[group]
        out, start = [], 0
        for block, part in zip(pdf.block, high, strict=True):
            out.append(("counts", shard, block, pack(back[start : start + len(part)]), 0))
            start += len(part)
        keys = np.concatenate([unpack(v, np.uint64, True) for v in pdf.grams])
        times = np.concatenate([unpack(v, np.int64) for v in pdf.times])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        sums = np.add.reduceat(times, first) if len(first) else times
        out.append(("segment", shard, -1, make_segment(keys[first], sums, settings), int((total > 0).sum())))
        return pd.DataFrame(out, columns=["kind", "shard", "block", "data", "distinct"])

    return run


def asked(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all unigrams and bigrams of a block, and the places in them of each bigram token and of
    each word. Sorted once: places follow from the order, without a search."""
    pairs = block.pairs()
    keys = np.concatenate((pairs, block.hashes))
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    places = np.empty(len(keys), np.int64)
    places[order] = np.cumsum(new) - 1
    return keys[new], places[: len(pairs)], places[len(pairs) :]


def probes(table: DataFrame, bits: int) -> DataFrame:
    """For each block and shard, what the block asks; only where segments are too large to be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row)
            keys = distinct(np.concatenate((b.pairs(), b.hashes)))
            y = cuts(keys, bits)
            out = [(s, b.number, pack(keys[y[s] : y[s + 1]], True)) for s in range(1 << bits) if y[s + 1] > y[s]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.binary()], strict=True)], ["shard", "block", "keys"])

    return table.mapInArrow(run, "shard int, block bigint, keys binary")


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def log_frequency_scores(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are one end token. base_score is the smoothed unigram score from exact counts; score is that
    of a bigram model read from the filter: (c(v, w) + prior * P(w)) / (c(v) + prior). A null doc_id is in training.
    Rows may repeat; each counts. An empty table gives an empty result; without any training token all counts are 0.
    """
    scratch = Scratch(spark, "lm")
    table = scratch.save(block_rows(pick(docs, id_col, text_col), settings), "blocks")
    total = table.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("n")).first()["n"]
    bits = max(0, int(np.ceil(np.log2(max(1, total / settings.shard_tokens)))))
    shards = grams(table, bits).repartition(max(1, min(1 << bits, 1 << 20)), "shard") if bits else grams(table, bits)
    answers = scratch.save(shards.groupBy("shard").applyInPandas(answer(settings), ANSWERS), "answers")
    about = answers.where("kind = 'segment'").agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("bytes")).first()
    scale = total + 0.1 * (about["v"] + 1)
    replies = answers.where("kind = 'counts'").select("block", F.lit(0).alias("what"), "shard", "data")
    if about["bytes"] <= settings.broadcast_bytes:
        # segment by segment, so that the driver holds each once
        held = {row["shard"]: bytes(row["data"]) for row in answers.where("kind = 'segment'").select("shard", "data").toLocalIterator()}
        segments = spark.sparkContext.broadcast(held)
    else:
        segments = None

        def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            rows = [(block, 1, shard, probe_segment(right.data.iloc[0], unpack(keys, np.uint64, True), settings).tobytes()) for shard, block, keys in left[["shard", "block", "keys"]].itertuples(index=False)]
            return pd.DataFrame(rows, columns=["block", "what", "shard", "data"])

        left, right = probes(table, bits).groupBy("shard"), answers.where("kind = 'segment'").select("shard", "data").groupBy("shard")
        replies = replies.unionByName(left.cogroup(right).applyInPandas(probe, "block bigint, what int, shard int, data binary"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in SCORES.split(", ")]
        if not len(left):
            return pd.DataFrame([], columns=columns)
        b = Block(left.iloc[0].to_dict())
        right = right.sort_values("shard")
        order, _, _ = b.exact_keys()
        exact = np.empty(len(b.words), np.int64)
        exact[order] = np.concatenate([unpack(v, np.int64) for v in right[right.what == 0].data])
        keys, at, own = asked(b)
        if segments is not None:
            y = cuts(keys, bits)
            levels = np.concatenate([probe_segment(segments.value[s], keys[y[s] : y[s + 1]], settings) if s in segments.value else np.zeros(y[s + 1] - y[s], np.uint8) for s in range(1 << bits)])
        else:
            levels = np.concatenate([np.frombuffer(v, np.uint8) for v in right[right.what == 1].data])
        counts = counts_of(levels)
        single = counts[own]
        word_p = (single + 0.1) / scale
        before = np.empty(len(b.tokens), np.float64)
        before[1:] = single[b.tokens[:-1]]
        before[b.begins] = single[b.words.index(END)]
        prior = word_p[b.tokens]
        pair = np.minimum(counts[at], before)
        model = np.log10((pair + settings.prior * prior) / (before + settings.prior))
        base = np.log10((exact + 0.1) / scale)[b.tokens]
        known = (exact > 0).astype(np.int64)[b.tokens]
        sums = [np.add.reduceat(v, b.begins) for v in (known, base, model)]
        return pd.DataFrame(dict(zip(columns, (pd.array(list(b.ids), dtype="Int64"), b.held, b.sizes, sums[0], total, sums[1], sums[2]), strict=True)))

    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(score, SCORES)
