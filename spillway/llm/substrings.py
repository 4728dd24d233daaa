"""Substring dedup: paragraphs are banded by MinHash, colliding ones joined, exact Jaccard verified, and linked ones are
one component; a passage is a stretch of over 50 words that other documents hold too.

A paragraph is what lies between two cuts, and cuts follow the words, not the lines: a place is cut whose next words
have the least hash of some window of SPREAD places around it (winnowing, Schleimer et al. 2003). Copies of a passage
are thus cut alike wherever their lines end. A chain of neighbouring paragraphs of LEAST words or more counts as
repeated where another document has a chain of the same components.

A passage that begins or ends within a paragraph is followed to its last word. Units of UNIT words start at the least
hashes of windows of LEAST - UNIT + 1 places, so every verbatim stretch of LEAST words holds a whole unit, the same one
in each copy. A unit whose copies all stand in the same words for LEAST words to each side settles those words by
itself; of other repeated units each window of LEAST words that picks one is looked up, and counts where another
document has it. A window's copies pick the same unit, so those that pick a unit without copies have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, distinct, free, mix
from .passages import BANDS, PERCENT, SHINGLE
from .similar import BROADCAST_BYTES, SKETCH, SKETCH_TYPES, Bands, connect, near_links, set_digest, sketch_arrays, sorted_groups

#: Words of a passage at least; of a unit; whose hash is compared; and places of a window of cuts.
LEAST, UNIT, GRAM, SPREAD = 51, 25, 4, 80
#: Repeated units, and the texts of open ones with their units, are broadcast up to this size; beyond, a shuffled join.
WIDE_BYTES = 64 << 20
#: Rows without a doc_id get a number from here on, after all doc_ids.
NAMELESS = 1 << 62
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


#: A number for each byte, the same for letters in either case; bytes whose sums are held at once.
BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(MULTIPLIERS[1]))
BYTES[65:91] = BYTES[97:123]
SEGMENT = 1 << 16
#: Powers that are kept; sets that are sketched at once; and digests of paragraphs that a task remembers, some 100 bytes each.
POWERS, SKETCHED, KNOWN = 1 << 20, 1 << 14, 1 << 17
#: Of a shingle's hash: two of a thousand shingles are equal by chance once in 35 million paragraphs.
SHINGLE_BITS = 44


class Words:
    """The words of a block of texts, one array for all: hashes after lower-casing A-Z, code points of start and end
    within the text, and the first word of each text (one more number: of all words)."""

    def __init__(self, texts: list[bytes | None]):
        raw = [t or b"" for t in texts]
        joined = b" ".join(raw)
        data = np.frombuffer(joined, np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate((np.ones(1, np.int8), space.view(np.int8), np.ones(1, np.int8))))
        where, stops = starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw], dtype=np.int64)))
        self.begins = np.searchsorted(starts, at)
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.begins))
        if not joined.isascii():
            # code points before each byte: bytes that aren't continuation bytes
            points = np.concatenate((np.zeros(1, np.int32), np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
            starts, ends, at = points[starts], points[ends], points[np.minimum(at, len(data))]
        base = at[:-1][self.text]
        self.starts, self.ends = starts - base, ends - base
        self.hashes = np.empty(len(where), np.uint64)
        k = 0
        while k < len(where):
            # as many words as start within a segment: sums over bytes take 8 bytes each
            upto = int(np.searchsorted(where, where[k] + SEGMENT))
            first, last = where[k], stops[upto - 1]
            self.hashes[k:upto] = Rolling(BYTES[data[first:last]], MULTIPLIERS[1])(where[k:upto] - first, stops[k:upto] - where[k:upto])
            k = upto
        self.limits = self.begins[1:][self.text]

    def __len__(self) -> int:
        return len(self.hashes)


class Rolling:
    """Hash of any run of words, from sums of hashes times powers of an odd number: the same wherever the run stands."""

    known: ClassVar[dict[int, tuple[np.ndarray, np.ndarray]]] = {}

    def __init__(self, hashes: np.ndarray, multiplier: int):
        up, self.down = self.powers(multiplier, len(hashes))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])))

    @classmethod
    def powers(cls, multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the number and of its inverse; as many as POWERS are kept."""
        if n > POWERS or multiplier not in cls.known:
            made = tuple(np.cumprod(np.full(max(n, POWERS), m, np.uint64)) for m in (multiplier, pow(multiplier, -1, 1 << 64)))
            if n > POWERS:
                return made
            cls.known[multiplier] = made
        return cls.known[multiplier]

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        """One hash for each start; sizes are at least 1."""
        with np.errstate(over="ignore"):
            run = (self.sums[start + size] - self.sums[start]) * self.down[start]
            return mix(run + np.asarray(size).astype(np.uint64) * np.uint64(MULTIPLIERS[0]))


def lowest(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours, in doubling steps."""
    have = 1
    while 2 * have <= size:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def picked(words: Words, rolling: Rolling, window: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of places that lie in one text, with ``room`` more words after each place, by their first place; and the
    place that each picks: the first whose gram has the least hash. That depends on the window's words alone."""
    n = len(words)
    if n < window + GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    grams[: n - GRAM + 1] = rolling(np.arange(n - GRAM + 1), GRAM)
    # 32 bits of the hash, then the place: a text has fewer words than that
    low = np.uint64((1 << 32) - 1)
    found = lowest((grams & ~low) | np.arange(n, dtype=np.uint64), window)
    starts = np.flatnonzero(np.arange(len(found)) + window - 1 + room <= words.limits[: len(found)])
    return starts, (found[starts] & low).astype(np.int64)


# ---- paragraphs


class Paragraphs:
    """Paragraphs of a block: their first and last words, number within the text, and sorted distinct shingle hashes, flat.
    Texts of fewer words than a window are one paragraph, and one of fewer words than a shingle has one shingle."""

    def __init__(self, words: Words, n: int):
        rolling = Rolling(words.hashes, MULTIPLIERS[0])
        _, cuts = picked(words, rolling, SPREAD, GRAM)
        self.first = distinct(np.concatenate((words.begins[:-1][np.diff(words.begins) > 0], cuts)))
        self.upto = np.append(self.first[1:], len(words))
        if not len(self.first):
            self.upto = self.first
        self.text = words.text[self.first] if len(self.first) else self.first
        self.begins = np.searchsorted(self.text, np.arange(len(words.begins)))
        self.number = np.arange(len(self.first)) - self.begins[self.text] if len(self.first) else self.first
        size = self.upto - self.first
        many = np.maximum(size - n + 1, 1)
        owner = np.repeat(np.arange(len(size)), many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + self.first[owner]
        grams = rolling(at, np.minimum(n, size)[owner]) >> np.uint64(64 - SHINGLE_BITS) if len(at) else np.empty(0, np.uint64)
        if len(size) < 1 << (64 - SHINGLE_BITS):
            # paragraph and shingle in one number sort fast
            both = np.sort((owner.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | grams)
            grams, owner = both & np.uint64((1 << SHINGLE_BITS) - 1), (both >> np.uint64(SHINGLE_BITS)).astype(np.int64)
        else:
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        self.flat = grams[new]
        self.offsets = np.searchsorted(owner[new], np.arange(len(size) + 1))

    def set(self, k: int) -> np.ndarray:
        return self.flat[self.offsets[k] : self.offsets[k + 1]]


PLACES = {"who": pa.int64(), "tag": pa.int64(), "number": pa.int32(), "w": pa.int32(), "upto": pa.int32(), "start": pa.int32(), "end": pa.int32()}
PLACE = "who bigint, tag bigint, number int, w int, upto int, start int, end int"


def owners(keys: list[tuple], text: np.ndarray, places: int = 2) -> list[np.ndarray]:
    """The first key columns (who, tag) of the texts with these numbers."""
    table = np.array([k[:places] for k in keys], np.int64).reshape(-1, places)
    return list(table[text].T)


def set_keys(digests: list[bytes]) -> np.ndarray:
    """A number for each set: half of its digest. Of 160 million sets, as 30 GB of text have, two share one with
    probability 7e-4."""
    return np.frombuffer(b"".join(digests), np.int64)[::2]


def sketches(texts: DataFrame, bands: Bands, n: int, limit: int = 2 << 20, known: int = KNOWN) -> DataFrame:
    """Places of all paragraphs, the keys of their sets and sketch columns. A set that a task has sketched comes again
    without: keys and marks are null, since copies would be most of a table's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for keys, said in blocks(batches, limit, 2):
            words = Words(said)
            cut = Paragraphs(words, n)
            if not len(cut.first):
                continue
            base = words.begins[cut.text]
            places = [*owners(keys, cut.text), cut.number, cut.first - base, cut.upto - base, words.starts[cut.first], words.ends[cut.upto - 1]]
            digests = [set_digest(cut.set(k)) for k in range(len(cut.first))]
            fresh = np.zeros(len(digests), bool)
            for k, digest in enumerate(digests):
                if digest not in seen:
                    seen.add(digest)
                    fresh[k] = True
            if len(seen) > known:
                seen.clear()
            sizes = np.diff(cut.offsets)
            for new in (True, False):
                these = np.flatnonzero(fresh == new)
                if not len(these):
                    continue
                said_once = [digests[k] for k in these]
                if new:
                    offsets = np.concatenate(([0], np.cumsum(sizes[these])))
                    columns = sketch_arrays(cut.flat[np.repeat(fresh, sizes)], offsets, bands, SKETCHED, said_once)
                else:
                    columns = [pa.array(sizes[these], pa.int64()), pa.array(said_once, pa.binary()), *(pa.nulls(len(these), SKETCH_TYPES[c]) for c in ("keys", "marks"))]
                at = [pa.array(c[these].astype(t.to_pandas_dtype()), t) for c, t in zip(places, PLACES.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*at, pa.array(set_keys(said_once)), *columns], [*PLACES, "key", *SKETCH_TYPES])

    return texts.mapInArrow(run, f"{PLACE}, key bigint, {SKETCH}")


def wanted_sets(texts: DataFrame, wanted: DataFrame, few: bool, n: int, limit: int = 2 << 20) -> DataFrame:
    """key, shingles of wanted paragraphs (key, who, tag, number): their texts are cut again."""
    lists = wanted.groupBy("who", "tag").agg(F.collect_list(F.struct("number", "key")).alias("pars"))
    rows = texts.join(F.broadcast(lists) if few else lists, ["who", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, said in blocks(batches, limit, 1):
            cut = Paragraphs(Words(said), n)
            found = [(p["key"], cut.set(cut.begins[k] + p["number"]).view(np.int64)) for k, pars in enumerate(keys) for p in pars]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], ["key", "shingles"])

    # rows that repeat an id and its text give a set twice
    return rows.select("pars", "text").mapInArrow(run, "key bigint, shingles array<bigint>").dropDuplicates(["key"])


HELD = "h1 bigint, h2 bigint, who bigint, tag bigint, w int, upto int, start int, end int"
HELD_TYPES = {c.split()[0]: pa.int64() if c.endswith("bigint") else pa.int32() for c in HELD.split(", ")}


def held_batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, HELD_TYPES.values(), strict=True)], [*HELD_TYPES])


def chains(places: DataFrame, least: int) -> DataFrame:
    """Rows HELD of neighbouring paragraphs with a component: for each the shortest chain of ``least`` words from it on,
    and one paragraph more, so that copies of a word more or less share one. h1, h2 stand for the chain's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in sorted_groups(batches, 2):
            who, tag, number, component, w, upto, start, end = (rows.column(k).to_numpy() for k in range(8))
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (tag[1:] != tag[:-1]) | (number[1:] != number[:-1] + 1)
            run, far = np.cumsum(new), np.int64(1 << 40)
            kinds = mix(component.astype(np.uint64))
            one, two = (Rolling(kinds, m) for m in MULTIPLIERS)
            shortest = np.searchsorted(upto + run * far, w + least + run * far)
            for more in (0, 1):
                last = shortest + more
                i = np.flatnonzero(last < len(who))
                i = i[run[last[i]] == run[i]]
                j, size = last[i], last[i] - i + 1
                if len(i):
                    yield held_batch([one(i, size), two(i, size), who[i], tag[i], w[i], upto[j], start[i], end[j]])

    columns = ("who", "tag", "number", "component", "w", "upto", "start", "end")
    # rows that repeat an id and its text have equal places
    return places.select(*columns).dropDuplicates(["who", "tag", "number"]).repartition("who", "tag").sortWithinPartitions("who", "tag", "number").mapInArrow(run, HELD)


def alike(scratch: Scratch, texts: DataFrame, bands: Bands, shingle: int, percent: int, least: int) -> DataFrame:
    """Chains (rows HELD) of paragraphs whose components several documents have."""
    table = scratch.save(sketches(texts, bands, shingle).drop("digest"), "paragraphs")

    def sets_for(needed: DataFrame) -> DataFrame:
        many = needed.count()
        places = table.select("key", "who", "tag", "number").join(F.broadcast(needed) if many * 16 <= BROADCAST_BYTES else needed, "key")
        wanted = places.groupBy("key").agg(F.min(F.struct("who", "tag", "number")).alias("place")).select("key", "place.*")
        return wanted_sets(texts, wanted, many * 64 <= BROADCAST_BYTES, shingle)

    links = near_links(scratch, table.where("keys is not null").select("key", "n_shingles", "keys", "marks"), sets_for, bands, percent)
    component = connect(scratch, links, "whole")
    owned = table.groupBy("key").agg(F.min("who").alias("first"), F.max("who").alias("last")).join(component, "key", "left")
    # a set that links with none is its document's own, or a component by itself
    owned = scratch.save(owned.where("component is not null or first < last").withColumn("component", F.coalesce("component", "key")), "owned")
    several = owned.groupBy("component").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").select("component")
    named = scratch.save(owned.select("key", "component").join(several, "component"), "named")
    few = named.count() * 32 <= BROADCAST_BYTES
    places = table.select(*PLACES, "key").join(F.broadcast(named) if few else named, "key")
    out = scratch.save(chains(places, least), "chains")
    scratch.drop("paragraphs", "owned", "named")
    return out


# ---- words


UNITS = {"unit": pa.int64(), "around": pa.int64(), "who": pa.int64(), "tag": pa.int64(), "w": pa.int32(), "upto": pa.int32(), "start": pa.int32(), "end": pa.int32()}


def units(texts: DataFrame, least: int, columns: tuple[str, ...], limit: int = 2 << 20) -> DataFrame:
    """Of each unit the wanted columns: its hash; that of all windows of ``least`` words that hold it (within the text)
    and of the unit's place in them; and the place of these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, said in blocks(batches, limit, 2):
            words = Words(said)
            rolling = Rolling(words.hashes, MULTIPLIERS[0])
            at = distinct(picked(words, rolling, least - UNIT + 1, UNIT)[1])
            if not len(at):
                continue
            text = words.text[at]
            base = words.begins[text]
            first, upto = np.maximum(at + UNIT - least, base), np.minimum(at + least, words.limits[at])
            around = mix(rolling(first, upto - first) + (at - first).astype(np.uint64))
            made = dict(zip(UNITS, [rolling(at, UNIT), around, *owners(keys, text), first - base, upto - base, words.starts[first], words.ends[upto - 1]], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(made[c].view(np.int64) if made[c].dtype == np.uint64 else made[c].astype(UNITS[c].to_pandas_dtype()), UNITS[c]) for c in columns], list(columns))

    return texts.mapInArrow(run, ", ".join(f"{c} {'int' if UNITS[c] == pa.int32() else 'bigint'}" for c in columns))


def windows(texts: DataFrame, asked: DataFrame, few: bool, least: int, limit: int = 2 << 20) -> DataFrame:
    """Rows HELD of all windows of ``least`` words that pick asked units. asked: who, tag, units."""
    rows = texts.join(F.broadcast(asked) if few else asked, ["who", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, said in blocks(batches, limit, 3):
            words = Words(said)
            rolling = [Rolling(words.hashes, m) for m in MULTIPLIERS]
            s, at = picked(words, rolling[0], least - UNIT + 1, UNIT)
            mine = np.unique(np.concatenate([np.asarray(k[2], np.int64) for k in keys]))
            s = s[np.isin(rolling[0](at, UNIT).view(np.int64), mine)]
            if len(s):
                base = words.begins[words.text[s]]
                yield held_batch([rolling[0](s, least), rolling[1](s, least), *owners(keys, words.text[s]), s - base, s - base + least, words.starts[s], words.ends[s + least - 1]])

    return rows.select("who", "tag", "units", "text").mapInArrow(run, HELD)


PIECE = ("who", "tag", "w", "upto", "start", "end", "first")


def verbatim(scratch: Scratch, texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Pieces that units settle by themselves, and rows HELD of the windows around other repeated units."""
    table = scratch.save(units(texts, least, tuple(UNITS)), "units")
    ends = [f(c).alias(f"{name}_{c}") for c in ("who", "around") for name, f in (("min", F.min), ("max", F.max))]
    known = table.groupBy("unit").agg(*ends).where("min_who < max_who")
    known = scratch.save(known.select("unit", F.col("min_who").alias("first"), F.expr("min_around = max_around").alias("settled")), "repeated-units")
    small = known.count() * 64 <= WIDE_BYTES
    placed = scratch.save(table.drop("around").join(F.broadcast(known) if small else known, "unit"), "placed")
    asked = placed.where("not settled").groupBy("who", "tag").agg(F.collect_set("unit").alias("units"))
    asked = scratch.save(asked, "asked")
    about = asked.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("units")), F.lit(0)).alias("units")).first()
    rows = scratch.save(windows(texts, asked, about["texts"] * 96 + about["units"] * 16 <= WIDE_BYTES, least), "windows")
    scratch.drop("units", "repeated-units", "asked")
    return placed.where("settled").select(*PIECE), rows


# ---- passages


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """who (doc_id, or a number from NAMELESS on that the text gives), tag (of the text) and text of rows with a text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.select(who_of(F.col("id"), F.col("text")).alias("who"), F.xxhash64("text").alias("tag"), "text")


def who_of(key: Column, text: Column) -> Column:
    return F.coalesce(key, F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(NAMELESS)))


def held(scratch: Scratch, settled: DataFrame, rows: DataFrame) -> DataFrame:
    """Pieces that several documents have: settled ones, and rows HELD whose h1, h2 more than one document has. who, tag,
    w, upto (words), start, end (code points), first (the least who that has it)."""
    known = rows.groupBy("h1", "h2").agg(F.min("who").alias("first"), F.max("who").alias("last")).where("first < last").select("h1", "h2", "first")
    # about as many as a tenth of the rows, whatever the corpus: not a side to broadcast
    known = scratch.save(known, "held")
    return settled.unionByName(rows.join(known, ["h1", "h2"]).select(*PIECE))


def pieces(spark: SparkSession, docs: DataFrame, bands: Bands, shingle: int, percent: int, least: int, id_col: str, text_col: str) -> DataFrame:
    scratch = Scratch(spark, "passages")
    texts = identified(docs, id_col, text_col)
    rows = alike(scratch, texts, bands, shingle, percent, least)
    settled, more = verbatim(scratch, texts, least)
    return held(scratch, settled, rows.unionByName(more))


def merged(found: DataFrame, least: int) -> DataFrame:
    """Pieces of a text that overlap or touch as one: who, tag, start, end, n_words, first, removed (all of its pieces
    are in an earlier document)."""
    near = found.repartition("who", "tag").groupBy("who", "tag", F.floor(F.col("w") / (least // 3)).alias("part"))
    # windows that start close to one another overlap
    near = near.agg(F.min("w").alias("w"), F.max("upto").alias("upto"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"), F.bool_and(F.col("first") < F.col("who")).alias("removed"))
    text = Window.partitionBy("who", "tag").orderBy("w", "upto")
    reach = F.max("upto").over(text.rowsBetween(Window.unboundedPreceding, -1))
    fresh = near.withColumn("fresh", F.when(F.col("w") <= reach, 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("fresh").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n_words = (F.max("upto") - F.min("w")).cast("bigint")
    return island.groupBy("who", "tag", "island").agg(F.min("start").cast("bigint").alias("start"), F.max("end").cast("bigint").alias("end"), n_words.alias("n_words"), F.min("first").alias("first"), F.bool_and("removed").alias("removed")).drop("island")


def named(who: str) -> Column:
    return F.when(F.col(who) < NAMELESS, F.col(who))


def shared_passages(spark: SparkSession, docs: DataFrame, bands: Bands = BANDS, shingle: int = SHINGLE, percent: int = PERCENT, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of a document: doc_id, start, end (code points, end exclusive), n_words, keep_doc_id, removed.

    A passage is a longest stretch of words (white space between; A-Z lower-cased) covered by runs of ``least`` words or
    more that another document has too, word for word, or as a chain of linked paragraphs: paragraphs link if 100 *
    intersection >= percent * union of their shingle sets, and chains of equal components count. The document with the
    least id that has a run keeps it; a passage is removed if all its runs are kept elsewhere; keep_doc_id is the least
    of the keepers. Repeats within one document are none. Null, empty and shorter texts have no passages. Rows that
    share a doc_id are one document: equal texts give one row, different ones each their own. Rows with a null doc_id
    come after all others, are one document for each distinct text, and are null in doc_id and keep_doc_id.
    """
    found = merged(pieces(spark, docs, bands, shingle, percent, least, id_col, text_col), least)
    return found.select(named("who").alias("doc_id"), "start", "end", "n_words", named("first").alias("keep_doc_id"), "removed")


def remove_shared(spark: SparkSession, docs: DataFrame, bands: Bands = BANDS, shingle: int = SHINGLE, percent: int = PERCENT, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words of runs that an earlier document keeps taken out of their texts, white space between them
    included; other columns and rows stay, whatever their names."""
    gone = merged(pieces(spark, docs, bands, shingle, percent, least, id_col, text_col).where("first < who"), least)
    key, tag, spans = free(docs, "__who", "__tag", "__cuts")
    cuts = gone.groupBy(F.col("who").alias(key), F.col("tag").alias(tag)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    text = F.col(text_col)
    joined = docs.join(cuts, (who_of(F.col(id_col).cast("bigint"), text) == F.col(key)) & (F.xxhash64(text) == F.col(tag)), "left")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.col(spans)["end"])
    ends = F.concat(F.col(spans)["start"], F.array(F.length(text).cast("bigint")))
    rest = F.array_join(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda p: F.substring(text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))), "")
    return joined.select(*[F.when(F.col(spans).isNull(), text).otherwise(rest).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])
