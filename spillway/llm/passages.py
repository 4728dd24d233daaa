"""Substring dedup: paragraphs are banded by MinHash, colliding ones joined, exact Jaccard verified, and of each
component of linked paragraphs all occurrences but the first are removed.

Passages that no line bounds are found by units of UNIT words, wherever lines end: in each window of WINDOW places the
one with the least hash of its next words (the last of equal ones) starts a unit, as in winnowing (Schleimer et al.
2003). A run of WINDOW + UNIT - 1 words holds a whole window and its unit, and what a window picks depends on the run
alone, so two verbatim copies of 50 words share a unit for sure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Vocabulary, blocks, free, gram_hashes, mix, pick, word_hashes
from .similar import BROADCAST_BYTES, SKETCH, SKETCH_TYPES, Bands, connect, near_links, shingle_sets, sketch_columns, split_words

#: Tuned for recall: a pair at 0.75 shares a band with probability 1 - (1 - 0.75**3)**20, all but 2 in a hundred thousand.
BANDS = Bands(20, 3)
SHINGLE, PERCENT = 5, 75
#: Paragraphs of fewer words repeat by chance and are no passages.
LEAST_WORDS = 10
#: Words of a unit, places of a window and words whose hash is compared; 50 words in a row hold a unit.
UNIT, WINDOW, GRAM = 25, 26, 4

PLACES = {"doc_id": pa.int64(), "par": pa.int32(), "start": pa.int64(), "end": pa.int64(), "n_words": pa.int64()}
PLACE = "doc_id bigint, par int, start bigint, end bigint, n_words bigint"


def cut(ids: list, texts: list[bytes | None], least: int, n: int):
    """Places (doc_id, par, start, end, n_words) of the paragraphs of a block, and their shingle sets."""
    places, seqs, vocabulary = [], [], Vocabulary()
    for key, raw in zip(ids, texts, strict=True):
        at = 0
        for par, line in enumerate((raw or b"").split(b"\n")):
            # code points: bytes that aren't continuation bytes
            size = len(line) if line.isascii() else len(line.decode("utf-8"))
            words = split_words(line)
            if len(words) >= max(1, least):
                places.append((key, par, at, at + size, len(words)))
                seqs.append(vocabulary.ids(words))
            at += size + 1
    hashes = word_hashes(vocabulary.words)
    return places, shingle_sets([hashes[s] for s in seqs], n)


def paragraphs(docs: DataFrame, bands: Bands, n: int, least: int, limit: int = 8 << 20) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, limit):
            places, sets = cut(ids, texts, least, n)
            columns = list(zip(*places, strict=True)) or [[]] * len(PLACES)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, PLACES.values(), strict=True)), *sketch_columns(sets, bands)], [*PLACES, *SKETCH_TYPES])

    return docs.mapInArrow(run, f"{PLACE}, {SKETCH}")


def wanted_sets(docs: DataFrame, wanted: DataFrame, n: int, least: int, limit: int = 8 << 20) -> DataFrame:
    """key, shingles of wanted paragraphs (key, doc_id, par, digest): their documents are cut again."""
    from .similar import set_digest

    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("par", "key", "digest")).alias("pars"))
    few = wanted.count() * 64 <= BROADCAST_BYTES
    rows = docs.join(F.broadcast(lists) if few else lists, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for row in range(batch.num_rows):
                pars = {p["par"]: p for p in batch.column(2)[row].as_py()}
                places, sets = cut([0], [batch.column(1)[row].as_py().encode() if batch.column(1)[row].is_valid else None], least, n)
                for place, s in zip(places, sets, strict=True):
                    if (p := pars.get(place[1])) and p["digest"] == set_digest(s):
                        keys.append(p["key"])
                        out.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["key", "shingles"])

    return rows.select("doc_id", "text", "pars").mapInArrow(run, "key bigint, shingles array<bigint>")


def repeated_passages(spark: SparkSession, docs: DataFrame, bands: Bands = BANDS, shingle: int = SHINGLE, percent: int = PERCENT, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence of a paragraph that repeats: doc_id, par (0-based line), start, end (code points, end
    exclusive), n_words, keep_doc_id, keep_par, occurrences, removed.

    Paragraphs are lines of ``least`` words or more, after lower-casing A-Z. Two link if 100 * intersection >= percent *
    union of their shingle sets; a component's first occurrence by (doc_id, par) stays, the others are removed. Null
    and empty texts have no paragraphs. Rows that repeat a doc_id are occurrences of their own, with equal places: all
    of them stay if theirs is the first. Rows with a null doc_id are left out.
    """
    scratch = Scratch(spark, "passages")
    texts = pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")).where("doc_id is not null")
    table = scratch.save(paragraphs(texts, bands, shingle, least), "paragraphs")
    classes = table.groupBy("digest").agg(F.min(F.struct("doc_id", "par")).alias("first"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("marks").alias("marks"))
    # ids are fixed by writing them
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("key"), "digest", "first", "n", "n_shingles", "keys", "marks"), "classes")

    def sets_for(needed: DataFrame) -> DataFrame:
        small = needed.count() * 16 <= BROADCAST_BYTES
        wanted = classes.join(F.broadcast(needed) if small else needed, "key", "left_semi").select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.par").alias("par"), "digest")
        return wanted_sets(texts, scratch.save(wanted, "wanted"), shingle, least)

    links = near_links(scratch, classes.select("key", "n_shingles", "keys", "marks"), sets_for, bands, percent)
    component = connect(scratch, links, "whole")
    owned = classes.select("key", "digest", "first", "n").join(component, "key", "left").withColumn("component", F.coalesce("component", "key"))
    clusters = owned.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("occurrences")).where("occurrences > 1")
    repeats = scratch.save(owned.select("digest", "component").join(clusters, "component").select("digest", "keep", "occurrences"), "repeats")
    few = repeats.count() * 64 <= BROADCAST_BYTES
    places = table.select(*PLACES, "digest").join(F.broadcast(repeats) if few else repeats, "digest")
    here = (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("par") == F.col("keep.par"))
    return places.select(*PLACES, F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.par").alias("keep_par"), "occurrences", (~here).alias("removed"))


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (code points, end exclusive) of the words that split_words gives."""
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], space.astype(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not raw.isascii():
        points = np.cumsum((data & 0xC0) != 0x80)
        starts, ends = points[starts] - 1, points[ends - 1]
    return starts, ends


def unit_starts(hashes: np.ndarray) -> np.ndarray:
    """Words at which a unit starts; none where there are fewer words than a window and a unit take."""
    if len(hashes) < WINDOW + UNIT - 1:
        return np.empty(0, np.int64)
    grams = gram_hashes(hashes, GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    found = np.unique(np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(axis=1))
    return found[found + UNIT <= len(hashes)]


def unit_digests(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words of each unit, in two numbers."""
    one, two = np.full(len(starts), 1, np.uint64), np.full(len(starts), 2, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(UNIT):
            word = hashes[starts + k]
            one, two = mix(one * np.uint64(0x9E3779B97F4A7C15) + word), mix(two * np.uint64(0xD6E8FEB86659FD93) ^ word)
    return one.view(np.int64), two.view(np.int64)


UNITS = {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "h1": pa.int64(), "h2": pa.int64()}


def units(docs: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """doc_id, start, end, h1, h2 of each unit. Of equal units of a text that overlap the first is given: a text of one
    word would have a unit at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, limit):
            vocabulary = Vocabulary()
            seqs = [vocabulary.ids(split_words(raw or b"")) for raw in texts]
            hashes, out = word_hashes(vocabulary.words), []
            for key, raw, seq in zip(ids, texts, seqs, strict=True):
                words = hashes[seq]
                at = unit_starts(words)
                if not len(at):
                    continue
                h1, h2 = unit_digests(words, at)
                ends, keep = {}, []
                for n, (place, digest) in enumerate(zip(at.tolist(), zip(h1.tolist(), h2.tolist(), strict=True), strict=True)):
                    if ends.get(digest, 0) <= place:
                        ends[digest] = place + UNIT
                        keep.append(n)
                starts, stops = word_places(raw)
                at, h1, h2 = at[keep], h1[keep], h2[keep]
                out.append((np.full(len(at), key, np.int64), starts[at], stops[at + UNIT - 1], h1, h2))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), UNITS.values(), strict=True)], [*UNITS])

    return docs.mapInArrow(run, "doc_id bigint, start bigint, end bigint, h1 bigint, h2 bigint")


def repeated_runs(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence of a unit of UNIT words that repeats: doc_id, start, end (code points, end exclusive),
    n_words, keep_doc_id, keep_start, occurrences, removed.

    Units are equal in all words after lower-casing A-Z, whatever white space is between. The first occurrence by
    (doc_id, start) stays. Each place of 50 words that recur anywhere holds a whole reported unit.
    """
    scratch = Scratch(spark, "runs")
    texts = pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")).where("doc_id is not null")
    table = scratch.save(units(texts), "units")
    repeats = table.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("keep"), F.count("*").alias("occurrences")).where("occurrences > 1")
    repeats = scratch.save(repeats, "repeats")
    few = repeats.count() * 48 <= BROADCAST_BYTES
    places = table.join(F.broadcast(repeats) if few else repeats, ["h1", "h2"])
    here = (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("start") == F.col("keep.start"))
    return places.select("doc_id", "start", "end", F.lit(UNIT).cast("bigint").alias("n_words"), F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "occurrences", (~here).alias("removed"))


def repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of repeated_passages (unit ``line``) and of repeated_runs (unit ``run``: par and keep_par are null; lines
    have no keep_start). A run may lie in a line that is there too."""
    lines = repeated_passages(spark, docs, id_col=id_col, text_col=text_col, **options).withColumn("unit", F.lit("line"))
    runs = repeated_runs(spark, docs, id_col, text_col).withColumn("unit", F.lit("run"))
    return lines.unionByName(runs, allowMissingColumns=True)


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with removed paragraphs (lines; not runs) taken out of their texts, line feeds included; other columns and
    rows stay."""
    found = repeated_passages(spark, docs, id_col=id_col, text_col=text_col, **options).where("removed")
    key, pars = free(docs, "__id", "__pars")
    gone = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("par").alias(pars))
    joined = docs.join(gone, F.col(id_col).cast("bigint") == F.col(key), "left")
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(pars, i), F.lit(False)))
    return joined.select(*[F.when(F.col(pars).isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns])
