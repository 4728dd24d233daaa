"""SentencePiece encoding and decoding through the tokenizers library, rebuilt from the model's protobuf.

The protobuf is parsed here; from it come the normaliser (its compiled character map, dummy prefix, white space rules),
the metaspace marker, the unigram scores or, for merge-ranked models, the merges, and byte fallback. Where no piece
holds the marker after another character, a text may be cut before every marker that follows one without any change of
the result. Merges only ever make pieces, so a merge-ranked model with byte fallback may be cut between any two characters
that no piece holds side by side; it is cut there beside punctuation and white space. Each distinct pre-token is encoded
once, in multithreaded batches, and kept while it is in use. Parity with the reference implementation is verified on every
pre-token when it is first met, and tests do it on whole texts.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Vocabulary, blocks, pick

MARK = "▁"
#: Piece kinds of the public protobuf schema.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model kinds of the public protobuf schema.
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: int


@dataclass(frozen=True)
class Model:
    pieces: tuple[Piece, ...]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True
    content: bytes = field(default=b"", repr=False)

    @property
    def unigram(self) -> bool:
        return self.kind == UNIGRAM

    @property
    def unknown(self) -> int:
        return next(k for k, p in enumerate(self.pieces) if p.kind == UNKNOWN)


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: number and value (an integer, or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if size is None:
            raise ValueError(f"wire type {kind}")
        yield number, data[at : at + size]
        at += size


def parse_model(content: bytes) -> Model:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in wire(content):
        if number == 1:
            fields = dict(wire(value))
            pieces.append(Piece(fields.get(1, b"").decode("utf-8"), struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0, fields.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(wire(value))
        elif number == 3:
            normaliser = dict(wire(value))
    return Model(
        tuple(pieces),
        kind=trainer.get(3, UNIGRAM),
        byte_fallback=bool(trainer.get(35, 0)),
        charsmap=normaliser.get(2, b""),
        dummy_prefix=bool(normaliser.get(3, 1)),
        strip_spaces=bool(normaliser.get(4, 1)),
        escape_spaces=bool(normaliser.get(5, 1)),
        content=content,
    )


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        return parse_model(f.read())


def build_tokenizer(model: Model, whole: bool = True):
    """A tokenizers.Tokenizer that gives the model's ids. Without ``whole``, it takes pre-tokens that are normalised."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    if model.unigram:
        # control, unknown and byte pieces never match text; a score this low keeps them out of every best path
        vocabulary = [(p.text, p.score if p.kind in (NORMAL, USER_DEFINED) else -1e30) for p in model.pieces]
        tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=model.unknown, byte_fallback=model.byte_fallback))
    elif model.kind == BPE:
        ids = {p.text: k for k, p in enumerate(model.pieces)}
        mergeable = {p.text: p.score for p in model.pieces if p.kind in (NORMAL, USER_DEFINED)}
        merges = []
        for text, score in mergeable.items():
            for cut in range(1, len(text)):
                left, right = text[:cut], text[cut:]
                if left in mergeable and right in mergeable:
                    merges.append((-score, ids[text], ids[left], ids[right], left, right))
        merges.sort()
        tokenizer = Tokenizer(models.BPE(ids, [m[4:] for m in merges], unk_token=model.pieces[model.unknown].text, fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model kind {model.kind} has no subword units")
    if whole:
        steps = []
        if model.charsmap:
            steps.append(normalizers.Precompiled(model.charsmap))
        if model.strip_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
        tokenizer.normalizer = normalizers.Sequence(steps) if steps else None
    return tokenizer


def normalise(model: Model, tokenizer, text: str) -> str:
    """Text as the model sees it, with markers for spaces; empty texts stay empty."""
    return tokenizer.normalizer.normalize_str(text) if text and tokenizer.normalizer else text


def cuttable(model: Model) -> bool:
    """No piece holds a marker after another character: markers then only begin pieces, or follow markers."""
    return model.escape_spaces and not any(MARK in p.text.lstrip(MARK) for p in model.pieces if p.kind in (NORMAL, USER_DEFINED))


PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


#: Pre-tokens whose ids a Python worker keeps between blocks; beyond, those that were met again stay, half of it at most.
#: Results don't depend on it.
MEMO = 200_000


class Borders:
    """Where a text may be cut: between characters that no piece holds side by side, letters and digits aside.
    ``apart`` is a character that may be cut off on either side."""

    def __init__(self, model: Model):
        pieces = [p.text for p in model.pieces if p.kind in (NORMAL, USER_DEFINED, UNUSED)]
        held = sorted({c for p in pieces if len(p) > 1 for c in p} | {MARK})
        # kinds of characters: each that a longer piece holds is one, all other letters, and the rest
        self.kinds = np.ones(0x110000, np.uint16)
        self.kinds[:128] = [chr(c).isalnum() for c in range(128)]
        word = np.array([False, True, *(c.isascii() and c.isalnum() or not c.isascii() and c != MARK for c in held)])
        for k, c in enumerate(held):
            self.kinds[ord(c)] = k + 2
        self.joined = word[:, None] & word[None, :]
        for a, b in {pair for p in pieces for pair in zip(p, p[1:])}:
            self.joined[self.kinds[ord(a)], self.kinds[ord(b)]] = True
        self.apart = next((chr(c) for c in range(1, 128) if not self.kinds[c] and not chr(c) == " "), None)

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of all texts, and the number of the first one of each text, with their count at the end."""
        said = "".join(texts)
        kinds = self.kinds[np.frombuffer(said.encode("utf-32-le"), np.uint32)]
        begins = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        first = np.ones(len(kinds) + 1, bool)
        first[1:-1] = ~self.joined[kinds[:-1], kinds[1:]]
        first[begins] = True
        at = np.flatnonzero(first)
        ends = at.tolist()
        return [said[a:b] for a, b in zip(ends, ends[1:])], np.searchsorted(at, begins)


class Codec:
    """Encodes blocks of texts and decodes ids; made once per worker from the model's bytes."""

    made: dict[bytes, Codec] = {}

    @classmethod
    def of(cls, model: Model) -> Codec:
        if model.content not in cls.made:
            cls.made.clear()
            cls.made[model.content] = cls(model)
        return cls.made[model.content]

    def __init__(self, model: Model):
        import os

        # the library spreads a batch over threads; an executor has as many workers as cores, so two each do
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        self.model = model
        self.part = build_tokenizer(model, whole=False)
        self.cut = cuttable(model)
        self.plain = not model.charsmap and not model.strip_spaces and model.escape_spaces and model.dummy_prefix
        borders = Borders(model) if self.plain and model.kind == BPE and model.byte_fallback else None
        self.borders = borders if borders and borders.apart else None
        self.bytes = {k: int(p.text[3:5], 16) for k, p in enumerate(model.pieces) if p.kind == BYTE}
        self.texts = ["" if p.kind == CONTROL else " ⁇ " if p.kind == UNKNOWN else p.text.replace(MARK, " ") if model.escape_spaces else p.text for p in model.pieces]
        self.forget()
        self.easy = set(range(len(model.pieces))) - self.bytes.keys()

    @cached_property
    def whole(self):
        """The tokenizer with its normaliser, which models without rules of their own don't need."""
        return build_tokenizer(self.model)

    def pre_tokens(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of texts as the model sees them, and the number of each text's first one, with their count at the end."""
        if self.borders and self.cut:
            return self.borders.cut(texts)
        parts = [PRE_TOKEN.findall(t) if self.cut else [t] if t else [] for t in texts]
        return list(chain.from_iterable(parts)), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))

    def encode_block(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], list[bool]]:
        """Ids of each text, the pre-tokens not met before, and whether each text's ids give back the text as normalised."""
        if self.plain:
            seen = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        else:
            seen = [normalise(self.model, self.whole, t) if t else "" for t in texts]
        if self.known > MEMO:
            self.thin()
        parts, firsts = self.pre_tokens(seen)
        p = self.memo.ids(parts)
        del parts, seen
        words = list(islice(self.memo.index, self.known, None))
        for start in range(0, len(words), 5_000):
            some = words[start : start + 5_000]
            found = [one.ids for one in self.part.encode_batch_fast(some, add_special_tokens=False)]
            self.begins.append(self.begins[-1][-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
            self.pools.append(np.fromiter(chain.from_iterable(found), np.int32))
            # a pre-token ends a run of byte pieces at a whole character, so a text decodes as its pre-tokens do
            self.good.append(np.array([self.decoded(k) == w.replace(MARK, " ") for k, w in zip(found, some, strict=True)], bool))
        self.known += len(words)
        self.pools, self.begins, self.good = [np.concatenate(self.pools)], [np.concatenate(self.begins)], [np.concatenate(self.good)]
        pool, begins, good = self.pools[0], self.begins[0], self.good[0]
        self.uses = np.bincount(p, minlength=self.known) + np.concatenate((self.uses, np.zeros(len(words), np.int64)))
        sizes = (begins[p + 1] - begins[p]).astype(np.int32)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        # within a block numbers of 32 bits do, unless a text is larger than that
        narrow = np.int32 if max(ends[-1], begins[-1]) < 1 << 31 else np.int64
        flat = pool[np.repeat((begins[p] - ends[:-1]).astype(narrow), sizes) + np.arange(ends[-1], dtype=narrow)]
        bad = np.concatenate(([0], np.cumsum(~good[p])))[firsts]
        cut = ends[firsts]
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], words, (bad[1:] == bad[:-1]).tolist()

    def thin(self) -> None:
        """Keeps the pre-tokens that were met more than once since the last time, half of MEMO at most."""
        stay = np.flatnonzero(self.uses > 1)
        if len(stay) > MEMO // 2:
            stay = np.sort(stay[np.argsort(-self.uses[stay], kind="stable")[: MEMO // 2]])
        words, pool, begins, good = self.memo.words, self.pools[0], self.begins[0], self.good[0]
        self.forget()
        self.memo.ids([words[k] for k in stay])
        sizes = begins[stay + 1] - begins[stay]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        self.known, self.uses = len(stay), np.zeros(len(stay), np.int64)
        self.pools, self.begins, self.good = [pool[np.repeat(begins[stay] - ends[:-1], sizes) + np.arange(ends[-1])]], [ends], [good[stay]]

    def forget(self) -> None:
        self.memo, self.known, self.uses = Vocabulary(), 0, np.empty(0, np.int64)
        self.pools, self.begins, self.good = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], [np.empty(0, bool)]

    def decoded(self, ids) -> str:
        """Text of ids with the dummy prefix: byte pieces are joined as UTF-8, control pieces say nothing."""
        if self.easy.issuperset(ids):
            return "".join(map(self.texts.__getitem__, ids))
        out, run = [], bytearray()
        for k in ids:
            if (byte := self.bytes.get(k)) is not None:
                run.append(byte)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.texts[k])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        text = self.decoded(ids)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def check(codec: Codec, reference, texts: list[str | None], ids: list[np.ndarray], words: list[str]) -> None:
    """Raises if ids of the new pre-tokens, or of texts that aren't cut or are normalised, differ from the reference. Of a
    unigram model, segmentations of one text with equal scores count as equal."""
    score = lambda ids: sum(codec.model.pieces[k].score for k in ids)
    tie = lambda a, b: codec.model.unigram and codec.decode(a) == codec.decode(b) and math.isclose(score(a), score(b), rel_tol=1e-6, abs_tol=1e-4)
    if codec.cut and codec.plain:
        begins, first = codec.begins[0], codec.known - len(words)
        # the reference puts a marker first, which where there is none is cut off together with a character that stands apart
        apart = codec.borders.apart if codec.borders else ""
        lead = len(reference.encode(apart)) if apart else 0

        def wanted() -> Iterator[list[int]]:
            for start in range(0, len(words), 5_000):
                some = words[start : start + 5_000]
                bare = [w[0] != MARK and bool(apart) for w in some]
                for w, b, said in zip(some, bare, reference.encode([apart + w if b else w[1:] for w, b in zip(some, bare, strict=True)], num_threads=1), strict=True):
                    # of nothing it makes nothing
                    yield said[lead:] if b else said if w != MARK else [reference.piece_to_id(MARK)]

        pairs = ((w, said, codec.pools[0][begins[first + k] : begins[first + k + 1]]) for k, (w, said) in enumerate(zip(words, wanted(), strict=True)))
    else:
        pairs = ((t, reference.encode(t), k) for t, k in zip(texts, ids, strict=True) if t)
    for said, want, found in pairs:
        if want != (ids_found := found.tolist()) and not tie(want, ids_found):
            raise ValueError(f"ids of {said[:200]!r} differ from the reference")


def encode(spark: SparkSession, docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 20) -> DataFrame:
    """One row per row of docs: doc_id, ids, n_ids, round_trip.

    Null and empty texts have no ids. round_trip: decoding gives back the text as normalised (markers are spaces).
    Each pre-token is also encoded by the sentencepiece library when it is first met, whole texts where the model can't be cut
    or has a normaliser; the job fails if any differs.
    The model (below a megabyte or so, whatever the data) is read on the driver and sent with the function.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        codec = Codec.of(model)
        reference = codec.reference = getattr(codec, "reference", None) or sentencepiece.SentencePieceProcessor(model_proto=model.content)
        for keys, raw in blocks(batches, limit):
            texts = [t.decode("utf-8") if t else None for t in raw]
            ids, words, same = codec.encode_block(texts)
            check(codec, reference, texts, ids, words)
            sizes = np.array([len(k) for k in ids], np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat, pa.array(sizes), pa.array(same)], ["doc_id", "ids", "n_ids", "round_trip"])

    texts = pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return texts.mapInArrow(run, "doc_id bigint, ids array<int>, n_ids bigint, round_trip boolean")


def decode(spark: SparkSession, encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id, text. Null ids give null, no ids an empty text."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
